"""Test-time work: shifted and rotated copies, voxel fragments that cover a scene, the vote over them, sphere crops."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.operators.prefix import numbered
from cloudloom.session import cut

#: Fixed value: the four turns about z, in units of pi.
TURNS = (0.0, 0.5, 1.0, 1.5)
BINS = 1024


def center_shift(points: DataFrame, by: Sequence[str], apply_z: bool = True) -> DataFrame:
    """Moves each scene to the middle of its box in x and y, and to its floor in z if asked."""
    box = points.groupBy(*by).agg(*[F.min(a).alias(f"_lo{a}") for a in "xyz"], *[F.max(a).alias(f"_hi{a}") for a in "xyz"])
    to = {a: F.col(a) - (F.col(f"_lo{a}") + F.col(f"_hi{a}")) / 2 for a in "xy"}
    if apply_z:
        to["z"] = F.col("z") - F.col("_loz")
    return points.join(box, list(by)).withColumns(to).drop(*[f"_{e}{a}" for e in ("lo", "hi") for a in "xyz"])


def _turn(turns: float) -> tuple[float, float]:
    """cos and sin of ``turns`` times pi; quarter turns exactly."""
    quarter = turns * 2
    if quarter == int(quarter):
        return ((1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0))[int(quarter) % 4]
    return math.cos(turns * math.pi), math.sin(turns * math.pi)


def rotated(points: DataFrame, turns: Sequence[float] = TURNS, normal: bool = False) -> DataFrame:
    """One copy of the points for each turn about the z axis through the origin; adds ``rotation`` (0, 1, ...)."""
    turn = F.explode(F.array(*[F.struct(F.lit(i).alias("rotation"), F.lit(c).alias("c"), F.lit(s).alias("s")) for i, (c, s) in enumerate(map(_turn, turns))])).alias("_t")
    out = points.select("*", turn)
    for p in ("", "n") if normal else ("",):
        x, y = F.col(f"{p}x"), F.col(f"{p}y")
        out = out.withColumns({f"{p}x": F.col("_t.c") * x - F.col("_t.s") * y, f"{p}y": F.col("_t.s") * x + F.col("_t.c") * y})
    return out.withColumn("rotation", F.col("_t.rotation")).drop("_t")


def cyclic_cover(points: DataFrame, by: Sequence[str], grid: float, ident: str = "point_id") -> DataFrame:
    """Points with their voxel (vx, vy, vz), their place ``r`` in it, its size ``n`` and the scene's number of ``fragments``.

    Fragment i holds row i mod n of every voxel, for i below the largest n of the scene, so each fragment has one point of
    each voxel and each point stands in some fragment.  Memberships are never spelt out: they would be voxels times
    fragments, the square of a crowded voxel.  ``fragment`` and ``repeats`` read them off (r, n, fragments).  Places come
    from range-partitioned totals, so a voxel with a third of all points is no single task.
    """
    by = list(by)
    cell = [F.floor(F.col(a) / F.lit(grid)).alias(f"v{a}") for a in "xyz"]
    voxel = [*by, "vx", "vy", "vz"]
    placed = numbered(points.select("*", *cell), voxel, [ident], "r")
    sizes = cut(points.select(*by, *cell).groupBy(*voxel).agg(F.count("*").alias("n")))
    most = sizes.groupBy(*by).agg(F.max("n").alias("fragments"))
    return placed.join(sizes, voxel).join(most, by)


def fragment(cover: DataFrame, i: int | Column) -> DataFrame:
    """The points of fragment ``i``: one a voxel, none of scenes with fewer fragments."""
    i = F.lit(i) if isinstance(i, int) else i
    return cover.where((F.col("fragments") > i) & (F.col("r") == F.pmod(i, F.col("n"))))


def repeats() -> Column:
    """In how many fragments of a cover a point stands."""
    return F.floor((F.col("fragments") - 1 - F.col("r")) / F.col("n")) + 1


def softmax(logits: str) -> Column:
    """Probabilities of an array of logits."""
    shifted = F.transform(logits, lambda v: F.exp(v - F.array_max(F.col(logits))))
    return F.transform(shifted, lambda v: v / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def vote(rows: DataFrame, keys: Sequence[str], classes: int, logits: str = "logits", weight: Column | None = None) -> DataFrame:
    """(keys..., pred, prob, votes): the class of the largest sum of softmax over all fragments and turns of a point.

    ``weight`` counts a row several times, as for fragments that a point enters with the same logits.  Sums are kept
    per class in one aggregation row, ties go to the smaller class.
    """
    weight = F.lit(1) if weight is None else weight
    one = rows.select(*keys, softmax(logits).alias("_p"), weight.cast("double").alias("_w"))
    sums = one.groupBy(*keys).agg(F.sum("_w").alias("votes"), *[F.sum(F.col("_p")[c] * F.col("_w")).alias(f"_c{c}") for c in range(classes)])
    best = F.greatest(*[F.struct(F.round(f"_c{c}", 9).alias("p"), F.lit(-c).alias("c")) for c in range(classes)])
    return sums.select(*keys, (-best["c"]).cast("int").alias("pred"), best["p"].alias("prob"), "votes")


# -- crops --------------------------------------------------------------------
def seeded_center(points: DataFrame, by: Sequence[str], seed: str, ident: str = "point_id") -> DataFrame:
    """(by..., cx, cy, cz): the point whose md5 of seed and id is smallest, of equal ids the one with the smallest coordinates."""
    mark = F.struct(F.md5(F.concat(F.lit(f"{seed}|"), F.col(ident).cast("string")).cast("binary")), F.col(ident), "x", "y", "z")
    return points.groupBy(*by).agg(F.min_by(F.struct("x", "y", "z"), mark).alias("_c")).select(*by, *[F.col(f"_c.{a}").alias(f"c{a}") for a in "xyz"])


def smallest_edge(values: DataFrame, by: Sequence[str], value: str, need: DataFrame) -> DataFrame:
    """(by..., edge, below): the ``need``-th smallest value of each group and how many values lie below it.

    Histograms of ``BINS`` bins between the group's bounds, refined inside the bin that holds the wanted value, with the
    bounds drawn in to the values that occur, until one value is left.  Only histograms are ordered, never the rows.
    ``need``: (by..., need), from 1 to the group's size.
    """
    by = list(by)
    state = values.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi")).join(need, by).withColumn("below", F.lit(0).cast("long"))
    state = cut(state.withColumn("need", F.col("need").cast("long")))
    while not state.where("lo < hi").isEmpty():
        wide = state.where("lo < hi")
        rows = values.join(wide, by).where((F.col(value) >= F.col("lo")) & (F.col(value) <= F.col("hi")))
        # halves first, then the difference: the span of two doubles or longs may exceed their type
        share = (F.col(value).cast("double") / 2 - F.col("lo").cast("double") / 2) / (F.col("hi").cast("double") / 2 - F.col("lo").cast("double") / 2)
        slot = F.when(F.col(value) == F.col("hi"), F.lit(BINS)).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1)))
        hist = rows.groupBy(*by, slot.alias("_slot")).agg(F.count("*").alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        up = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("_before", F.coalesce(F.sum("_n").over(up), F.lit(0)))
        hit = hist.join(wide.select(*by, "need", "below"), by).where((F.col("_before") < F.col("need")) & (F.col("_before") + F.col("_n") >= F.col("need")))
        narrow = hit.select(*by, F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), (F.col("need") - F.col("_before")).alias("need"), (F.col("below") + F.col("_before")).alias("below"))
        state = cut(state.where("lo = hi").unionByName(narrow))
    return state.select(*by, F.col("lo").alias("edge"), "below")


def sphere_crop(points: DataFrame, by: Sequence[str], point_max: int | None = None, sample_rate: float | None = None, seed: str = "crop", ident: str = "point_id") -> DataFrame:
    """The points nearest to a seeded centre: ``point_max`` of each scene, or the ``sample_rate`` share of its points.

    Ties at the border go to the smaller id, those of one id to the smaller coordinates.  Scenes that are small enough stay
    whole.  The border distance and, among its ties, the border id are found by refined histograms; points are then kept by
    comparison.  Only rows that share distance and id with the border are numbered, so ids need not be unique.
    """
    if (point_max is None) == (sample_rate is None):
        raise ValueError("give point_max or sample_rate")
    by = list(by)
    c = seeded_center(points, by, seed, ident)
    far = points.join(c, by)
    d = [F.col(a) - F.col(f"c{a}") for a in "xyz"]
    far = cut(far.withColumn("_d", d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).drop("cx", "cy", "cz"))
    size = far.groupBy(*by).agg(F.count("*").alias("_size"))
    take = F.lit(int(point_max)) if point_max is not None else F.floor(F.col("_size") * F.lit(float(sample_rate)))
    need = cut(size.select(*by, F.least(take, F.col("_size")).cast("long").alias("need")).where("need > 0"))
    edge = smallest_edge(far.select(*by, "_d"), by, "_d", need)
    edge = cut(edge.join(need, by).select(*by, "edge", (F.col("need") - F.col("below")).alias("need")))
    tied = far.join(edge, by).where(F.col("_d") == F.col("edge")).select(*by, F.col(ident).alias("_id"))
    last = smallest_edge(tied, by, "_id", edge.select(*by, "need")).withColumnRenamed("edge", "_last")
    last = cut(edge.join(last, by).select(*by, "edge", "_last", (F.col("need") - F.col("below")).alias("_left")))
    out = far.join(last, by)
    inside = (F.col("_d") < F.col("edge")) | ((F.col("_d") == F.col("edge")) & (F.col(ident) < F.col("_last")))
    border = out.where((F.col("_d") == F.col("edge")) & (F.col(ident) == F.col("_last")))
    border = border.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("x", "y", "z"))).where(F.col("_r") <= F.col("_left")).drop("_r")
    return out.where(inside).unionByName(border).drop("_d", "edge", "_last", "_left")
