"""Principal axes and one-dimensional gaps of many point groups at once.

Every step is a mergeable aggregation; only the 3x3 eigen decomposition of one
small matrix per group runs in an Arrow UDF.  No group is ever collected.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudloom.functions import geometry as g

_AXES = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("ax", "ay", "az", "nx", "ny", "nz", "s0", "s1", "s2")]
)
_PAIRS = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]


def fix_sign(v: np.ndarray) -> np.ndarray:
    """Make the largest-magnitude component of each row positive."""
    lead = np.take_along_axis(v, np.abs(v).argmax(axis=1)[:, None], axis=1)
    return v * np.where(lead < 0, -1.0, 1.0)


@F.pandas_udf(_AXES)
def symmetric_axes(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
    """Leading and trailing unit eigenvector, and the root eigenvalues from large to small."""
    m = np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], axis=1).astype(float).reshape(-1, 3, 3)
    values, vectors = np.linalg.eigh(m)
    lead, trail = fix_sign(vectors[:, :, 2]), fix_sign(vectors[:, :, 0])
    s = np.sqrt(np.clip(values[:, ::-1], 0.0, None))
    return pd.DataFrame(dict(zip(("ax", "ay", "az", "nx", "ny", "nz", "s0", "s1", "s2"), [*lead.T, *trail.T, *s.T])))


def group_axes(points: DataFrame, keys: Sequence[str], coords=("x", "y", "z")) -> DataFrame:
    """Per group: n, centroid mx..mz, principal axis ax..az, normal nx..nz, spreads s0..s2."""
    name = dict(zip("xyz", coords))
    moments = [F.covar_pop(name[p], name[q]).alias(f"_{p}{q}") for p, q in _PAIRS]
    stats = points.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(name[a]).alias(f"m{a}") for a in "xyz"], *moments)
    out = stats.withColumn("_e", symmetric_axes(*[F.col(f"_{p}{q}") for p, q in _PAIRS]))
    return out.select(*keys, "n", "mx", "my", "mz", "_e.*")


def mean_tangent(points: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Unit mean of the tangents after turning each toward the group's first one.

    Adding v or -v by the sign of its product with the first vector is a plain
    sum, so two aggregations do it; zero for a vanishing mean.
    """
    unit = points.select(*keys, order, *[c.alias(f"u{a}") for a, c in zip("xyz", g.unit_floor(g.vec("t")))])
    first = unit.groupBy(*keys).agg(F.min_by(F.struct("ux", "uy", "uz"), order).alias("_r"))
    joined = unit.join(first, list(keys))
    sign = F.when(F.col("ux") * F.col("_r.ux") + F.col("uy") * F.col("_r.uy") + F.col("uz") * F.col("_r.uz") >= 0, 1.0).otherwise(-1.0)
    mean = joined.groupBy(*keys).agg(*[F.avg(sign * F.col(f"u{a}")).alias(f"_s{a}") for a in "xyz"])
    return mean.select(*keys, *[c.alias(f"mt{a}") for a, c in zip("xyz", g.unit_or_zero(g.vec("_s"), 1e-9))])


def largest_gap(values: DataFrame, keys: Sequence[str], t: str, threshold: Column) -> DataFrame:
    """The widest gap of ``t`` per group where it reaches ``threshold``: cut position and width.

    A gap at least ``threshold`` wide must cross an edge of buckets half that
    wide, so it lies between one bucket's minimum and the previous occupied
    bucket's maximum.  Rows are reduced to buckets before anything is ordered.
    """
    b = values.withColumn("_w", threshold / 2).withColumn("_b", F.floor(F.col(t) / F.col("_w")))
    slim = b.groupBy(*keys, "_b").agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"), F.max("_w").alias("_w"))
    prev = F.lag("_hi").over(Window.partitionBy(*keys).orderBy("_b"))
    gaps = slim.select(*keys, "_w", "_lo", prev.alias("_p")).where(F.col("_p").isNotNull())
    gaps = gaps.withColumn("gap", F.col("_lo") - F.col("_p")).where(F.col("gap") >= 2 * F.col("_w"))
    best = gaps.groupBy(*keys).agg(F.max_by(F.struct("_p", "_lo", "gap"), F.struct(F.col("gap"), (-F.col("_lo")).alias("first"))).alias("_g"))
    return best.select(*keys, ((F.col("_g._p") + F.col("_g._lo")) / 2).alias("cut"), F.col("_g.gap").alias("gap"))
