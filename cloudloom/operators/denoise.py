"""Outlier removal and smoothing as DataFrame -> DataFrame steps, plus surface normals.

Conventions fixed here: SOR compares a point's mean distance to its ``k`` other
nearest points with mean + ratio * sample deviation of the scene; the radius
filter keeps points with at least ``nb`` other points within the radius.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.functions import geometry as g
from cloudloom.operators.axes import symmetric_axes
from cloudloom.operators.neighbors import k_nearest
from cloudloom.session import cut

XYZ = ["x", "y", "z"]


def statistical(points: DataFrame, by: Sequence[str], nb: int = 30, ratio: float = 2.0) -> DataFrame:
    by = list(by)
    near = k_nearest(points, points, nb, by=by, exclude_self=True)
    mean = cut(near.groupBy(*by, "point_id").agg(F.avg("distance").alias("_d")))
    limit = mean.groupBy(*by).agg((F.avg("_d") + ratio * F.coalesce(F.stddev_samp("_d"), F.lit(0.0))).alias("_limit"))
    keep = mean.join(limit, by).where(F.col("_d") <= F.col("_limit")).select(*by, "point_id")
    return points.join(keep, [*by, "point_id"], "left_semi")


def radius(points: DataFrame, by: Sequence[str], nb: int = 8, reach: float = 0.05) -> DataFrame:
    """Asking for the ``nb``-th neighbour within reach decides without counting a whole ball."""
    by = list(by)
    near = k_nearest(points, points, nb, by=by, exclude_self=True, rmax=reach)
    keep = near.where(F.col("rank") == nb).select(*by, "point_id")
    return points.join(keep, [*by, "point_id"], "left_semi")


def moving_average(points: DataFrame, by: Sequence[str], k: int = 20) -> DataFrame:
    """Replaces each position by the mean of its ``k`` nearest points, itself included."""
    by = list(by)
    near = k_nearest(points, points, k, by=by, carry=XYZ)
    mean = near.groupBy(*by, "point_id").agg(*[F.avg(f"nbr_{a}").alias(a) for a in XYZ])
    return points.drop(*XYZ).join(mean, [*by, "point_id"])


def plane(points: DataFrame, by: Sequence[str], threshold: float = 0.02, iterations: int = 1000, seed: int = 42) -> DataFrame:
    """Keeps the inliers of the best of ``iterations`` planes through seeded point triplets.

    Triplets come from the 3 * iterations points that lead a seeded hash order,
    a bounded draw pruned map-side.  Counting inliers is one pass over the
    points; the trial planes (a fixed, small number per scene) ride along as an
    array, so nothing is paired in a shuffle.
    """
    from pyspark.sql import Window

    by = list(by)
    order = F.xxhash64(F.col("point_id"), F.lit(seed))
    w = Window.partitionBy(*by).orderBy(order, "point_id")
    drawn = points.select(*by, "point_id", *XYZ).withColumn("_r", F.row_number().over(w) - 1).where(F.col("_r") < 3 * iterations)
    drawn = drawn.withColumn("_plane", F.floor(F.col("_r") / 3)).withColumn("_corner", F.col("_r") % 3)
    corners = [F.max(F.when(F.col("_corner") == i, F.struct(*XYZ))).alias(f"p{i}") for i in range(3)]
    trial = drawn.groupBy(*by, "_plane").agg(*corners).where(F.col("p2").isNotNull())
    p = [tuple(F.col(f"p{i}")[a] for a in XYZ) for i in range(3)]
    normal = g.unit_or_zero(g.cross(g.sub(p[1], p[0]), g.sub(p[2], p[0])))
    trial = trial.select(*by, "_plane", *[c.alias(f"n{a}") for a, c in zip("xyz", normal)], *[c.alias(f"q{a}") for a, c in zip("xyz", p[0])])
    trial = cut(trial.where(g.norm(g.vec("n")) > 0.5).withColumn("_off", g.dot(g.vec("n"), g.vec("q"))))
    fan = trial.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_plane", "nx", "ny", "nz", "_off"))).alias("_t"))

    def hit(t):
        return F.when(F.abs(t["nx"] * F.col("x") + t["ny"] * F.col("y") + t["nz"] * F.col("z") - t["_off"]) <= threshold, t["_plane"])

    near = points.join(fan, by)
    votes = near.select(*by, F.explode(F.filter(F.transform("_t", hit), lambda v: v.isNotNull())).alias("_plane"))
    score = votes.groupBy(*by, "_plane").agg(F.count("*").alias("_k"))
    best = score.groupBy(*by).agg(F.max_by("_plane", F.struct("_k", (-F.col("_plane")).alias("f"))).alias("_plane"))
    chosen = trial.join(best, [*by, "_plane"]).select(*by, "nx", "ny", "nz", "_off")
    chosen = chosen.withColumnsRenamed({f"n{a}": f"_b{a}" for a in "xyz"})
    kept = points.join(chosen, by)
    inlier = F.abs(F.col("_bx") * F.col("x") + F.col("_by") * F.col("y") + F.col("_bz") * F.col("z") - F.col("_off")) <= threshold
    return kept.where(inlier).drop("_bx", "_by", "_bz", "_off")


METHODS: dict[str, Callable[..., DataFrame]] = {"sor": statistical, "radius": radius, "mls": moving_average, "ransac_plane": plane}


def denoise(points: DataFrame, steps: Sequence[tuple[str, dict]], by: Sequence[str], cap: float = 0.10) -> DataFrame:
    """Runs the steps in order; fails when a scene loses more than ``cap`` of its points overall."""
    if not steps or [s[0] for s in steps] == ["none"]:
        return points
    out = points
    for name, options in steps:
        if name not in METHODS:
            raise ValueError(f"unknown denoise method: {name}")
        out = cut(METHODS[name](out, by, **options))
    worst = drop_fraction(points, out, by).agg(F.max("dropped")).first()[0]
    if worst is not None and worst > cap:
        raise ValueError(f"denoise dropped {worst:.1%} of a scene, more than {cap:.0%}")
    return out


def drop_fraction(before: DataFrame, after: DataFrame, by: Sequence[str]) -> DataFrame:
    b = before.groupBy(*by).agg(F.count("*").alias("n_before"))
    a = after.groupBy(*by).agg(F.count("*").alias("n_after"))
    out = b.join(a, list(by), "left").fillna(0, ["n_after"])
    return out.withColumn("dropped", 1.0 - F.col("n_after") / F.col("n_before"))


def normals(points: DataFrame, by: Sequence[str], k: int = 30) -> DataFrame:
    """Unit normal of each point from the covariance of its ``k`` nearest points, itself included.

    A scene with fewer than ``k`` points fails the job.  Signs are fixed by the
    largest component, not oriented toward a viewpoint.
    """
    by = list(by)
    sizes = points.groupBy(*by).agg(F.count("*").alias("_n"))
    small = sizes.where(F.col("_n") < k)
    if not small.isEmpty():
        raise ValueError(f"a scene has fewer than {k} points")
    near = k_nearest(points, points, k, by=by, carry=XYZ)
    pairs = [(p, q) for i, p in enumerate(XYZ) for q in XYZ[i:]]
    cov = near.groupBy(*by, "point_id").agg(*[F.covar_pop(f"nbr_{p}", f"nbr_{q}").alias(f"_{p}{q}") for p, q in pairs])
    out = cov.withColumn("_e", symmetric_axes(*[F.col(f"_{p}{q}") for p, q in pairs]))
    flat = F.col("_e.s1") <= 1e-9 * F.greatest(F.col("_e.s0"), F.lit(1e-30))
    ok = F.when(flat, F.raise_error(F.lit("neighbourhood is a line: no normal"))).otherwise(F.lit(True))
    out = out.where(F.coalesce(ok.cast("boolean"), F.lit(False)))
    return points.drop("nx", "ny", "nz").join(out.select(*by, "point_id", *[F.col(f"_e.n{a}").alias(f"n{a}") for a in "xyz"]), [*by, "point_id"])

