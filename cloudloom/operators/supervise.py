"""Nearest-support supervision of every point, and the detection of bad supports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions import geometry as g
from cloudloom.functions.weights import gaussian_support
from cloudloom.operators.pairs import nearest_segment


def label_index(supports: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(label, support_id) for both labels of each support, once when they are equal."""
    return supports.select(*by, F.explode(F.array_distinct(F.array("label_a", "label_b"))).alias("segment"), "support_id")


def segments_of(supports: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Explodes ``segments`` (array of struct ax..bz) keeping their order as ``seg``."""
    return supports.select(*by, "support_id", F.posexplode("segments").alias("seg", "_s")).select(*by, "support_id", "seg", "_s.*")


def supervise(
    points: DataFrame, supports: DataFrame, segments: DataFrame, radius: float = 0.08, sigma: float = 0.02,
    ignore: int = -1, skip: DataFrame | None = None, by: Sequence[str] = (),
) -> DataFrame:
    """Every point with its nearest compatible support segment within ``radius``.

    Adds dist (+inf), dir, valid, support_id (-1), vec and support weight.
    """
    usable = supports if skip is None else supports.join(skip, [*by, "support_id"], "left_anti")
    typed = label_index(usable, by).join(segments, [*by, "support_id"])
    asked = points.where(F.col("segment") != ignore)
    best = nearest_segment(asked, typed, radius, [*by, "segment"], "point_id", ["support_id", "seg"])
    out = points.join(best.drop("segment", "seg"), [*by, "point_id"], "left")
    valid = F.col("support_id").isNotNull()
    out = out.withColumns({f"vec_{a}": F.coalesce(F.col(f"q{a}") - F.col(a), F.lit(0.0)) for a in "xyz"})
    unit = g.unit_floor(g.vec("vec_"))
    out = out.withColumns({f"dir_{a}": c for a, c in zip("xyz", unit)})
    support = gaussian_support(F.coalesce("dist", F.lit(0.0)), valid, sigma)
    return out.withColumns({
        "support": support, "valid": valid, "support_id": F.coalesce("support_id", F.lit(-1)),
        "dist": F.coalesce("dist", F.lit(float("inf"))),
    }).drop("qx", "qy", "qz")


def with_arc_length(segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds segment length, arc length before the segment and total length of its support.

    A support has at most a few dozen segments, so its window is small.
    """
    key = [*by, "support_id"]
    run = Window.partitionBy(*key).orderBy("seg").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*key)
    out = segments.withColumn("len", g.norm(g.sub(g.vec("b"), g.vec("a"))))
    return out.withColumn("arc_end", F.sum("len").over(run)).withColumn("arc_start", F.col("arc_end") - F.col("len")).withColumn(
        "total_len", F.sum("len").over(whole)
    )


def bad_supports(
    supports: DataFrame, segments: DataFrame, members: DataFrame, by: Sequence[str] = (), min_length: float = 0.05,
    middle: tuple[float, float] = (0.2, 0.8), max_middle: float = 0.15, min_alignment: float = 0.5,
) -> DataFrame:
    """(support_id, problem): ``hollow`` or, for the others, ``diagonal``.

    ``members`` has cluster_id, center_id, x, y, z and the tangent tx, ty, tz.
    """
    key = [*by, "support_id"]
    arcs = with_arc_length(segments, by)
    ends = arcs.groupBy(*key).agg(
        F.max("total_len").alias("total_len"),
        *[F.min_by(f"a{c}", "seg").alias(f"s{c}") for c in "xyz"], *[F.max_by(f"b{c}", "seg").alias(f"e{c}") for c in "xyz"],
    )
    owned = supports.select(*key, "cluster_id").join(members, [*by, "cluster_id"])
    hit = owned.join(arcs.drop("total_len"), key)
    t, _ = g.on_segment(g.vec(""), g.vec("a"), g.vec("b"))
    hit = hit.withColumn("_t", t)
    q = tuple(F.col(f"a{c}") + F.col("_t") * (F.col(f"b{c}") - F.col(f"a{c}")) for c in "xyz")
    hit = hit.withColumn("_d", g.norm(g.sub(g.vec(""), q))).withColumn("_arc", F.col("arc_start") + F.col("_t") * F.col("len"))
    per_member = hit.groupBy(*key, "center_id").agg(
        F.min(F.struct("_d", "seg", "_arc")).alias("_b"), *[F.first(c).alias(c) for c in ("tx", "ty", "tz")]
    )
    placed = per_member.join(ends, key)
    lo, hi = middle
    where = F.when(F.col("total_len") < g.EPS, F.lit(0.0)).otherwise(F.col("_b._arc") / F.greatest("total_len", F.lit(g.EPS)))
    span = g.sub(g.vec("e"), g.vec("s"))
    cos = F.abs(g.dot(g.unit_floor(g.vec("t"), 1e-9), g.unit_floor(span)))
    stats = placed.groupBy(*key).agg(
        F.count("*").alias("n"), F.max("total_len").alias("total_len"), F.avg(F.when(where.between(lo, hi), 1.0).otherwise(0.0)).alias("middle"),
        F.avg(cos).alias("alignment"), F.max(g.norm(span)).alias("span"),
    ).where(F.col("n") >= 2)
    hollow = (F.col("total_len") >= min_length) & (F.col("middle") <= max_middle)
    diagonal = (F.col("span") >= g.EPS) & (F.col("alignment") < min_alignment)
    problem = F.when(hollow, "hollow").when(diagonal, "diagonal")
    return stats.withColumn("problem", problem).where(F.col("problem").isNotNull()).select(*key, "problem", "n", "middle", "alignment", "total_len")
