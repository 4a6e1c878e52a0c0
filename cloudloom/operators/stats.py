"""Summaries over per-chunk values, and the extent of point groups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudloom.operators.prefix import totals_above

_BLOCK = 1024


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Exact linearly interpolated quantiles per group as ``q0, q1, ...``; NULL values are left out.

    Groups are reduced to (value, count) and ranked with running totals over
    value ranges, so no task ever sees a whole group.
    """
    keys = list(keys)
    v = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")).withColumn("_key", F.lit(1))
    one = [*keys, "_key"]
    rows = totals_above(v.groupBy(*one, "_v").agg(F.count("*").alias("c")), one, "_v", ["c"])
    # the smallest value of a group sees all others above it
    size = rows.groupBy(*one).agg(F.max(F.col("c_above") + F.col("c")).alias("_n"))
    rows = rows.join(size, one)
    start = F.col("_n") - F.col("c_above") - F.col("c")
    aggs = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("_n") - 1)
        for tag, idx in (("l", F.floor(at)), ("h", F.ceil(at))):
            aggs.append(F.max(F.when((idx >= start) & (idx < start + F.col("c")), F.col("_v"))).alias(f"_{tag}{i}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"_f{i}"))
    return rows.groupBy(*one).agg(*aggs).select(
        *keys, *[(F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_f{i}")).alias(f"q{i}") for i in range(len(probs))]
    )


def median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    return quantiles(df, keys, value, [0.5]).withColumnRenamed("q0", out)


def summarise(df: DataFrame, keys: Sequence[str], value: str, low: float, high: float) -> DataFrame:
    """min, mean, median, max, population deviation and the share inside [low, high]."""
    v, one = F.col(value), [*keys, "_one"]
    df = df.withColumn("_one", F.lit(1))
    out = df.groupBy(*one).agg(
        F.min(v).alias("lo"), F.avg(v).alias("mean"), F.max(v).alias("hi"), F.stddev_pop(v).alias("std"),
        F.avg(F.when(v.between(low, high), 1.0).otherwise(0.0)).alias("in_window"),
    )
    return out.join(median(df, one, value, "med"), one).drop("_one")


def radius_pick(summary: DataFrame, centre: float = 10.0, share: float = 0.6) -> DataFrame:
    """The radius whose mean lies nearest ``centre`` among those with enough chunks in the window."""
    off = F.round(F.abs(F.col("mean") - F.lit(centre)), 9)
    return summary.where(F.col("in_window") >= share).agg(F.min_by("radius", F.struct(off.alias("o"), F.col("radius").alias("r"))).alias("radius"))


def over_runs(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and population deviation over repeated runs, NaN results left out."""
    v = F.when(~F.isnan(value), F.col(value))
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def pairwise_extent(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest distance between two points of each group, without forming the pairs as rows.

    The farthest pair is found among direction-extreme candidates.  For each of
    a fan of directions the projection range of the group bounds the extent from
    below; a point can only end a longer pair if its distance to the far corner
    of the group's box exceeds that bound, so all other points are dropped by an
    exact test.  What is left is compared in blocks of bounded size.
    """
    keys = list(keys)
    fan = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, -1, 0), (1, 0, 1), (1, 0, -1), (0, 1, 1), (0, 1, -1), (1, 1, 1), (1, 1, -1), (1, -1, 1), (1, -1, -1)]
    aggs = [F.min(a).alias(f"_{a}0") for a in "xyz"] + [F.max(a).alias(f"_{a}1") for a in "xyz"]
    for i, d in enumerate(fan):
        size = float(np.sqrt(sum(v * v for v in d)))
        t = sum((F.col(a) * F.lit(v / size) for a, v in zip("xyz", d)), F.lit(0.0))
        aggs.append((F.max(t) - F.min(t)).alias(f"_w{i}"))
    box = points.groupBy(*keys).agg(F.count("*").alias("n"), *aggs)
    box = box.withColumn("_bound", F.greatest(*[F.col(f"_w{i}") for i in range(len(fan))]) * F.lit(1 - 1e-9))
    near = points.select(*keys, "x", "y", "z").join(box.select(*keys, "_bound", *[f"_{a}{e}" for a in "xyz" for e in "01"]), keys)
    reach = sum((F.pow(F.greatest(F.col(a) - F.col(f"_{a}0"), F.col(f"_{a}1") - F.col(a)), F.lit(2)) for a in "xyz"), F.lit(0.0))
    cand = near.where(F.sqrt(reach) >= F.col("_bound")).select(*keys, "x", "y", "z").distinct()
    # block pairs: a task sees at most two blocks of candidates at a time
    blocks = F.greatest(F.ceil(F.col("_m") / F.lit(_BLOCK)).cast("int"), F.lit(1))
    size = cand.groupBy(*keys).agg(F.count("*").alias("_m")).withColumn("_k", blocks)
    cand = cand.join(size.select(*keys, "_k"), keys).withColumn("_b", F.pmod(F.xxhash64("x", "y", "z"), F.col("_k")).cast("int"))
    cand = cand.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    pair = F.struct(F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j"))
    shape = T.StructType([*[points.schema[k] for k in keys], T.StructField("extent", T.DoubleType())])

    def longest(key: tuple, table: pa.Table) -> pa.Table:
        pts = np.stack([table.column(a).to_numpy() for a in "xyz"], axis=1)
        best = 0.0
        for at in range(0, len(pts), 512):
            d = [pts[at : at + 512, None, i] - pts[None, :, i] for i in range(3)]
            best = max(best, float(np.sqrt((d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).max())))
        return pa.table({**{n: pa.array([key[i].as_py()]) for i, n in enumerate(keys)}, "extent": pa.array([best])}).cast(_arrow(shape))

    per_pair = cand.withColumn("_pair", pair).groupBy(*keys, "_pair.i", "_pair.j").applyInArrow(longest, shape)
    best = per_pair.groupBy(*keys).agg(F.max("extent").alias("extent"))
    return box.select(*keys, "n").join(best, keys)


def _arrow(shape: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(shape)
