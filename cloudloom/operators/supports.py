"""Line and polyline supports fitted to boundary clusters, all clusters at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions import geometry as g
from cloudloom.operators.axes import group_axes, largest_gap
from cloudloom.operators.neighbors import k_nearest
from cloudloom.operators.splits import split_recursively
from cloudloom.operators.stats import median, pairwise_extent
from cloudloom.session import cut

LINE, POLYLINE = 0, 2


@dataclass(frozen=True)
class SupportConfig:
    """Default thresholds of the fit."""

    line_residual: float = 0.01
    polyline_residual: float = 0.04
    min_size: int = 4
    max_vertices: int = 32
    min_density: float = 15.0
    gap_ratio: float = 8.0


def sample_segments(segments: DataFrame, step: float) -> DataFrame:
    """Evenly spaced samples along each (a, b) segment, both ends included."""
    a, b = g.vec("a"), g.vec("b")
    length = g.norm(g.sub(b, a))
    n = F.greatest(F.ceil(length / F.lit(step)).cast("int") + 1, F.lit(2))
    out = segments.withColumn("_n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    t = F.col("i") / (F.col("_n") - 1)
    for axis, p, q in zip("xyz", a, b):
        out = out.withColumn(f"s{axis}", p + t * (q - p))
    return out.drop("_n")


def group_spacing(points: DataFrame, keys: Sequence[str], ident: str = "center_id", k: int = 6) -> DataFrame:
    """Median neighbour distance inside each group; 0.01 for a single point."""
    near = k_nearest(points, points, k, by=keys, query_id=ident, base_id=ident, exclude_self=True)
    med = median(near, keys, "distance", "spacing")
    out = points.select(*keys).distinct().join(med, list(keys), "left")
    return out.withColumn("spacing", F.greatest(F.coalesce("spacing", F.lit(0.01)), F.lit(1e-6)))


def projected(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points with their group's axis, centroid and the coordinate ``t`` along the axis."""
    axes = group_axes(points, keys).select(*keys, "n", "mx", "my", "mz", "ax", "ay", "az")
    rows = points.join(axes, list(keys))
    return rows.withColumn("t", g.dot(g.sub(g.vec(""), g.vec("m")), g.vec("a")))


def gap_split(points: DataFrame, keys: Sequence[str], ratio: float = 8.0, min_size: int = 4, ident: str = "center_id") -> DataFrame:
    """Adds ``path``: turns of splitting each cluster at wide gaps along its axis; small fragments are dropped."""
    def distributed(rows: DataFrame, key: list[str]) -> DataFrame:
        rows = cut(projected(rows, key).select(*key, ident, "x", "y", "z", "t"))
        rows = rows.join(group_spacing(rows, key, ident), key)
        cuts = largest_gap(rows, key, "t", F.col("spacing") * ratio)
        return rows.join(cuts, key).select(*key, ident, (F.col("t") < F.col("cut")).alias("_left"))

    out = split_recursively(points, keys, ident, min_size, distributed)
    return out.where(F.col("path").isNotNull())


def fit_lines(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Main-axis line per group: end points, midpoint origin, direction, residual, coverage, length."""
    keys = list(keys)
    rows = projected(points, keys).where("n >= 2")
    ends = rows.groupBy(*keys).agg(
        F.max("n").alias("n"), *[F.max(c).alias(c) for c in ("mx", "my", "mz", "ax", "ay", "az")], F.min("t").alias("_t0"), F.max("t").alias("_t1")
    ).where(F.col("_t1") - F.col("_t0") >= g.EPS)
    ends = ends.select(
        *keys, "n", *[F.col(f"a{c}").alias(f"d{c}") for c in "xyz"],
        *[(F.col(f"m{c}") + F.col("_t0") * F.col(f"a{c}")).alias(f"s{c}") for c in "xyz"],
        *[(F.col(f"m{c}") + F.col("_t1") * F.col(f"a{c}")).alias(f"e{c}") for c in "xyz"],
        *[(F.col(f"m{c}") + (F.col("_t0") + F.col("_t1")) / 2 * F.col(f"a{c}")).alias(f"o{c}") for c in "xyz"],
        (F.col("_t1") - F.col("_t0")).alias("length"),
    )
    back = points.join(ends.select(*keys, "dx", "dy", "dz", "ox", "oy", "oz"), keys)
    stats = back.groupBy(*keys).agg(
        F.avg(g.line_distance(g.vec(""), g.vec("o"), g.vec("d"))).alias("residual"), F.max(g.norm(g.sub(g.vec(""), g.vec("o")))).alias("coverage")
    )
    return ends.join(stats, keys)


def polyline_bins(extent: Column, spacing: Column, n: Column, max_vertices: int = 32) -> Column:
    """One vertex per five spacings of extent, 2..max_vertices, never more than points.

    Halves round to even.
    """
    want = F.rint(extent / (5.0 * spacing))
    return F.least(F.greatest(F.least(want, F.lit(float(max_vertices))), F.lit(2.0)), n.cast("double")).cast("int")


def fit_polylines(points: DataFrame, keys: Sequence[str], max_vertices: int = 32, ident: str = "center_id") -> tuple[DataFrame, DataFrame]:
    """(vertices in order, per-group residual, coverage and direction)."""
    keys = list(keys)
    rows = cut(projected(points, keys).join(group_spacing(points, keys, ident), keys))
    span = rows.groupBy(*keys).agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"), F.max("spacing").alias("_s"), F.max("n").alias("_k"))
    span = span.withColumn("_bins", F.when(F.col("_t1") - F.col("_t0") < 1e-12, 1).otherwise(polyline_bins(F.col("_t1") - F.col("_t0"), F.col("_s"), F.col("_k"), max_vertices)))
    placed = rows.join(span.drop("_s"), keys)
    step = (F.col("_t1") - F.col("_t0")) / F.col("_bins")
    slot = F.when(F.col("_bins") == 1, 0).otherwise(F.least(F.floor((F.col("t") - F.col("_t0")) / step), F.col("_bins") - 1))
    # with as many bins as points (at most max_vertices) every point is its own vertex
    own = F.row_number().over(Window.partitionBy(*keys).orderBy("t", ident)) - 1
    alone = placed.where((F.col("_bins") == F.col("_k")) & (F.col("_bins") > 1)).withColumn("_slot", own)
    shared = placed.where((F.col("_bins") != F.col("_k")) | (F.col("_bins") == 1)).withColumn("_slot", slot)
    binned = shared.unionByName(alone).groupBy(*keys, "_slot").agg(*[F.avg(a).alias(f"v{a}") for a in "xyz"])
    order = Window.partitionBy(*keys).orderBy("_slot")  # at most max_vertices rows
    vertices = cut(binned.withColumn("vertex", F.row_number().over(order) - 1).drop("_slot"))
    segs = segments_between(vertices, keys)
    d = points.join(segs, keys, "left")
    single = F.col("seg").isNull()
    lone = vertices.where("vertex = 0").select(*keys, *[F.col(f"v{a}").alias(f"f{a}") for a in "xyz"])
    d = d.join(lone, keys)
    dist = F.when(single, g.norm(g.sub(g.vec(""), g.vec("f")))).otherwise(g.segment_distance(g.vec(""), g.vec("a"), g.vec("b")))
    per_point = d.groupBy(*keys, ident).agg(F.min(dist).alias("_d"))
    residual = per_point.groupBy(*keys).agg(F.avg("_d").alias("residual"))
    far = rows.groupBy(*keys).agg(
        F.max(g.norm(g.sub(g.vec(""), g.vec("m")))).alias("coverage"), F.count("*").alias("n"), *[F.max(f"m{a}").alias(f"o{a}") for a in "xyz"]
    )
    ends = vertices.groupBy(*keys).agg(
        *[(F.max_by(f"v{a}", "vertex") - F.min_by(f"v{a}", "vertex")).alias(f"_e{a}") for a in "xyz"], F.count("*").alias("vertices")
    )
    ends = ends.select(*keys, "vertices", *[c.alias(f"d{a}") for a, c in zip("xyz", g.unit_or_zero(g.vec("_e")))])
    return vertices, residual.join(far, keys).join(ends, keys)


def segments_between(vertices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Consecutive vertices as (seg, ax..az, bx..bz)."""
    nxt = vertices.select(*keys, (F.col("vertex") - 1).alias("vertex"), *[F.col(f"v{a}").alias(f"b{a}") for a in "xyz"])
    out = vertices.select(*keys, "vertex", *[F.col(f"v{a}").alias(f"a{a}") for a in "xyz"]).join(nxt, [*keys, "vertex"])
    return out.withColumnRenamed("vertex", "seg")


def dense_enough(members: DataFrame, keys: Sequence[str], cfg: SupportConfig) -> DataFrame:
    """Clusters with enough points, and enough points per metre unless tiny."""
    ext = pairwise_extent(members, keys)
    thin = (F.col("extent") > 0.01) & (F.col("n") / F.col("extent") < cfg.min_density)
    return ext.where((F.col("n") >= cfg.min_size) & ~thin).select(*keys)


def fit_supports(members: DataFrame, keys: Sequence[str], cfg: SupportConfig = SupportConfig()) -> DataFrame:
    """One row per support with its segments as an ordered array.

    ``members``: keys..., center_id, x, y, z, confidence.  Clusters are gated by
    size and density, split at gaps, fitted by a line and, where that is too
    coarse, by a polyline.
    """
    keys = list(keys)
    conf = members.groupBy(*keys).agg(F.avg("confidence").alias("confidence"))
    pts = members.join(dense_enough(members, keys, cfg), keys).select(*keys, "center_id", "x", "y", "z")
    frag = cut(gap_split(pts, keys, cfg.gap_ratio, cfg.min_size))
    key = [*keys, "path"]
    lines = cut(fit_lines(frag, key))
    good = lines.where(F.col("residual") <= cfg.line_residual)
    one = F.array(F.struct(F.lit(0).alias("seg"), *[F.col(f"s{c}").alias(f"a{c}") for c in "xyz"], *[F.col(f"e{c}").alias(f"b{c}") for c in "xyz"]))
    shape = ["support_type", "n", "residual", "coverage", "ox", "oy", "oz", "dx", "dy", "dz", "segments"]
    line_rows = good.withColumn("support_type", F.lit(LINE)).withColumn("segments", one).select(*key, *shape)
    rest = frag.join(good.select(*key), key, "left_anti")
    vertices, stats = fit_polylines(rest, key, cfg.max_vertices)
    segs = segments_between(vertices, key).groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("seg", *[f"{p}{c}" for p in "ab" for c in "xyz"]))).alias("segments")  # at most 31
    )
    poly = stats.where(F.col("residual") <= cfg.polyline_residual).join(segs, key, "left")
    poly_rows = poly.withColumn("support_type", F.lit(POLYLINE)).select(*key, *shape)
    both = line_rows.unionByName(poly_rows).join(conf, keys)
    snapped = g.axis_snap(both, g.vec("d"), ("_sx", "_sy", "_sz"), "orientation_score")
    return snapped.drop("dx", "dy", "dz").withColumnsRenamed({"_sx": "dx", "_sy": "dy", "_sz": "dz"})
