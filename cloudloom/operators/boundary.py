"""Semantic boundary detection: radius mask, decay weights, cross ratio, boundary centres."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudloom.functions import geometry as g
from cloudloom.functions.weights import center_confidence, decay_weight
from cloudloom.operators.axes import fix_sign
from cloudloom.operators.neighbors import k_nearest

_TANGENT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x", "y", "z", "score")])
_MOMENTS = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]


def nearest_other_class(points: DataFrame, by: Sequence[str], rmax: float | None = None) -> DataFrame:
    """Adds ``other_dist``: distance to the nearest point of a different class, +inf if none."""
    hit = k_nearest(points, points, 1, by=by, differ="segment", rmax=rmax)
    key = [*by, "point_id"]
    out = points.join(hit.select(*key, F.col("distance").alias("other_dist")), key, "left")
    return out.withColumn("other_dist", F.coalesce("other_dist", F.lit(float("inf"))))


def radius_mask(points: DataFrame, radius: float, by: Sequence[str]) -> DataFrame:
    """Adds ``boundary_mask``: some point of a different class lies within ``radius``.

    Marking both ends of every mixed pair is the same as asking each point for
    its nearest point of another class, so no pair is ever produced.
    """
    out = nearest_other_class(points, by, rmax=radius)
    return out.withColumn("boundary_mask", F.col("other_dist") <= F.lit(radius)).drop("other_dist")


def support_weight(points: DataFrame, by: Sequence[str], core=0.06, outer=0.12, rate=3.0) -> DataFrame:
    near = nearest_other_class(points, by, rmax=outer)
    return near.withColumn("s_weight", decay_weight(F.col("other_dist"), core, outer, rate)).drop("other_dist")


def distance_bands(other_dist: Column, edges=(0.06, 0.12, 0.18)) -> Column:
    """1 in the core, 2 and 3 in the shells around it, 0 elsewhere."""
    core, mid, far = edges
    return F.when(other_dist <= core, 1).when(other_dist <= mid, 2).when(other_dist <= far, 3).otherwise(0)


def label_moments(points: DataFrame, k: int, by: Sequence[str], ignore: int = -1, normals: bool = False) -> DataFrame:
    """Neighbourhood of every point summarised per neighbour class.

    One row per point with ``moments``: class -> count, coordinate sums and
    second moments about the query point.  Everything later stages need from
    the neighbour lists is in here, so the lists are reduced map-side at once.
    """
    extra = ["nx", "ny", "nz"] if normals else []
    near = k_nearest(points, points, k, by=by, exclude_self=True, carry=["x", "y", "z", "segment", *extra],
                     keep=["x", "y", "z", "segment", *extra])
    d = [F.col(f"nbr_{a}") - F.col(a) for a in "xyz"]
    key = [*by, "point_id"]
    own = [F.first(c).alias(c) for c in ("x", "y", "z", "segment", *extra)]
    per_class = near.groupBy(*key, "nbr_segment").agg(
        F.count("*").alias("n"),
        *[F.sum(c).alias(f"d{i}") for i, c in enumerate(d)],
        *[F.sum(d[i] * d[j]).alias(f"m{i}{j}") for i, j in _MOMENTS],
        *[F.sum(f"nbr_{c}").alias(f"s{c}") for c in extra],
        *own,
    )
    names = ["n", "d0", "d1", "d2", *[f"m{i}{j}" for i, j in _MOMENTS], *[f"s{c}" for c in extra]]
    valid = F.col("nbr_segment") != ignore
    diff = valid & (F.col("nbr_segment") != F.col("segment"))
    return per_class.groupBy(*key).agg(
        *own,
        F.sum(F.when(valid, F.col("n")).otherwise(0)).alias("n_valid"),
        F.sum(F.when(diff, F.col("n")).otherwise(0)).alias("n_diff"),
        F.max_by(F.when(diff, F.col("nbr_segment")), F.when(diff, F.struct(F.col("n"), (-F.col("nbr_segment")).alias("s")))).alias("paired"),
        F.map_from_entries(F.collect_list(F.struct("nbr_segment", F.struct(*names)))).alias("moments"),
    )


def candidates(moments: DataFrame, min_cross_ratio: float = 0.15, ignore: int = -1) -> DataFrame:
    """Points whose share of differing, non-ignored neighbours reaches the threshold."""
    ratio = F.col("n_diff") / F.col("n_valid")
    keep = moments.where((F.col("segment") != ignore) & (F.col("n_diff") > 0))
    return keep.withColumn("cross_ratio", ratio).where(F.col("cross_ratio") >= min_cross_ratio).withColumns(
        {"label_a": F.least("segment", "paired"), "label_b": F.greatest("segment", "paired")}
    )


def knn_edge(moments: DataFrame, min_cross_ratio: float = 0.15, ignore: int = -1) -> DataFrame:
    """Boolean variant: denominators of at least one, ignored points are never edges."""
    ratio = F.col("n_diff") / F.greatest(F.col("n_valid"), F.lit(1))
    return moments.withColumn("knn_edge", (F.col("segment") != ignore) & (ratio >= min_cross_ratio))


def _side(label: str, normals: bool) -> dict[str, Column]:
    """Count and sums of one side, the query point itself included in its own class."""
    m = F.try_element_at("moments", F.col(label))
    own = F.when(F.col("segment") == F.col(label), 1).otherwise(0)
    out = {"n": F.coalesce(m["n"], F.lit(0)) + own}
    for name in ("d0", "d1", "d2", *[f"m{i}{j}" for i, j in _MOMENTS]):
        out[name] = F.coalesce(m[name], F.lit(0.0))
    if normals:
        for c in ("nx", "ny", "nz"):
            out[f"s{c}"] = F.coalesce(m[f"s{c}"], F.lit(0.0)) + F.when(own == 1, F.col(c)).otherwise(0.0)
    return out


def boundary_centers(cands: DataFrame, by: Sequence[str], min_side: int = 4, normals: bool = False, tangents: bool = True) -> DataFrame:
    """Midpoint, side normal, tangent and confidence of every candidate with two full sides."""
    key = [*by, "point_id"]
    base = [*key, "label_a", "label_b", "cross_ratio", "x", "y", "z"]
    cols = []
    for tag in "ab":
        cols += [c.alias(f"{tag}_{n}") for n, c in _side(f"label_{tag}", normals).items()]
    s = cands.select(*base, *cols).where((F.col("a_n") >= min_side) & (F.col("b_n") >= min_side))
    cen = {t: [F.col(a) + F.col(f"{t}_d{i}") / F.col(f"{t}_n") for i, a in enumerate("xyz")] for t in "ab"}
    s = s.select("*", *[c.alias(f"_{t}{i}") for t in "ab" for i, c in enumerate(cen[t])])
    gap = [F.col(f"_b{i}") - F.col(f"_a{i}") for i in range(3)]
    s = s.withColumn("separation", g.norm(tuple(gap))).where(F.col("separation") >= g.EPS)
    s = s.withColumns({f"c{a}": 0.5 * (F.col(f"_a{i}") + F.col(f"_b{i}")) for i, a in enumerate("xyz")})
    s = s.withColumns({f"n{a}": gap[i] / F.col("separation") for i, a in enumerate("xyz")})
    balance = 1.0 - F.abs(F.col("a_n") - F.col("b_n")) / (F.col("a_n") + F.col("b_n"))
    s = s.withColumn("balance", balance)
    head = [*key, "label_a", "label_b", "cross_ratio", "balance", "separation", "cx", "cy", "cz", "nx", "ny", "nz"]
    if not tangents:
        return s.select(*head)
    # scatter about the centre from the moments about the query point
    n = F.col("a_n") + F.col("b_n")
    off = [F.col(f"c{a}") - F.col(a) for a in "xyz"]
    tot = [F.col(f"a_d{i}") + F.col(f"b_d{i}") for i in range(3)]
    scatter = [
        (F.col(f"a_m{i}{j}") + F.col(f"b_m{i}{j}") - off[i] * tot[j] - off[j] * tot[i] + n * off[i] * off[j]).alias(f"w{i}{j}")
        for i, j in _MOMENTS
    ]
    surface = [(F.col(f"a_sn{a}") + F.col(f"b_sn{a}")) for a in "xyz"] if normals else [F.lit(0.0)] * 3
    s = s.select(*head, *scatter, *[c.alias(f"sn{a}") for a, c in zip("xyz", surface)])
    s = s.withColumn("_t", _plane_tangent(*[F.col(f"w{i}{j}") for i, j in _MOMENTS], "nx", "ny", "nz", "snx", "sny", "snz"))
    s = s.select(*head, *[F.col(f"_t.{a}").alias(f"t{a}") for a in "xyz"], F.col("_t.score").alias("tangent_score")).where("tangent_score > 0")
    conf = center_confidence(F.col("cross_ratio"), F.col("balance"), F.col("separation"), F.col("tangent_score"))
    return s.select(*head, "tx", "ty", "tz", "tangent_score", conf.alias("confidence"))


@F.pandas_udf(_TANGENT)
def _plane_tangent(
    w00: pd.Series, w01: pd.Series, w02: pd.Series, w11: pd.Series, w12: pd.Series, w22: pd.Series,
    nx: pd.Series, ny: pd.Series, nz: pd.Series, sx: pd.Series, sy: pd.Series, sz: pd.Series,
) -> pd.DataFrame:
    """Leading direction of a scatter matrix inside the plane across a normal.

    Where the scatter vanishes: mean surface normal x side normal, score 0.3.
    A score of 0 means that neither gives a direction.
    """
    w = np.stack([w00, w01, w02, w01, w11, w12, w02, w12, w22], axis=1).astype(float).reshape(-1, 3, 3)
    n = np.stack([nx, ny, nz], axis=1).astype(float)
    flat = np.eye(3)[None] - n[:, :, None] * n[:, None, :]
    values, vectors = np.linalg.eigh(flat @ w @ flat)
    s = np.sqrt(np.clip(values, 0.0, None))
    lead = fix_sign(vectors[:, :, 2])
    score = np.clip(s[:, 2] / (s.sum(axis=1) + 1e-8), 0.0, 1.0)
    surface = np.stack([sx, sy, sz], axis=1).astype(float)
    surface = surface / np.maximum(np.linalg.norm(surface, axis=1, keepdims=True), 1e-8)
    other = np.cross(surface, n)
    size = np.linalg.norm(other, axis=1)
    solid, spare = s[:, 2] > 1e-8, size >= 1e-8
    other = other / np.maximum(size, 1e-8)[:, None]
    lead = np.where(solid[:, None], lead, other)
    score = np.where(solid, score, np.where(spare, 0.3, 0.0))
    return pd.DataFrame({"x": lead[:, 0], "y": lead[:, 1], "z": lead[:, 2], "score": score})


def fallback_tangents(cands: DataFrame, by: Sequence[str], min_side: int = 4) -> DataFrame:
    """Tangent from mean surface normal x side normal, for candidates with two full sides."""
    key = [*by, "point_id"]
    a, b = _side("label_a", True), _side("label_b", True)
    cols = [c.alias(f"{t}_{n}") for t, side in (("a", a), ("b", b)) for n, c in side.items() if n in ("n", "d0", "d1", "d2", "snx", "sny", "snz")]
    s = cands.select(*key, *cols).where((F.col("a_n") >= min_side) & (F.col("b_n") >= min_side))
    gap = tuple(F.col(f"b_d{i}") / F.col("b_n") - F.col(f"a_d{i}") / F.col("a_n") for i in range(3))
    s = s.withColumn("separation", g.norm(gap)).where(F.col("separation") >= g.EPS)
    surface = g.unit_or_zero(tuple(F.col(f"a_sn{c}") + F.col(f"b_sn{c}") for c in "xyz"))
    s = s.select(*key, *[c.alias(f"_n{x}") for x, c in zip("xyz", g.scale(gap, 1 / F.col("separation")))], *[c.alias(f"_s{x}") for x, c in zip("xyz", surface)])
    s = s.select(*key, *[c.alias(f"_k{x}") for x, c in zip("xyz", g.cross(g.vec("_s"), g.vec("_n")))])
    tangent = g.unit_or_zero(g.vec("_k"))
    return s.select(*key, *[c.alias(f"t{x}") for x, c in zip("xyz", tangent)], F.lit(0.3).alias("tangent_score"))
