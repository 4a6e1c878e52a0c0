"""Voxel aggregation: majority vote, histograms, boxes, density, roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.functions.grid import class_clip, remap_after_void, voxel_key

RAW_CLASSES = 17  # class 0 is VOID
KEPT_CLASSES = 16


def majority_vote(points: DataFrame, grid: float, keys: Sequence[str] = ("sample",), hist: bool = False) -> DataFrame:
    """One row per voxel: key, centroid, count, winning class (ties: smallest id).

    Two chained hash aggregations.  The first, keyed by voxel and class, shrinks
    the cloud before the shuffle; the second merges at most 17 rows per voxel,
    so a voxel with a third of all points is no hot spot.
    """
    pre = points.select(
        *keys, voxel_key(F.col("x"), F.col("y"), F.col("z"), grid).alias("key"), "x", "y", "z", class_clip(F.col("c")).alias("c")
    )
    per_class = pre.groupBy(*keys, "key", "c").agg(
        F.count("*").alias("nc"), *[F.sum(a).alias(f"s{a}") for a in "xyz"]
    )
    extra = [F.map_from_entries(F.sort_array(F.collect_list(F.struct("c", "nc")))).alias("hist")] if hist else []
    return per_class.groupBy(*keys, "key").agg(
        *[(F.sum(f"s{a}") / F.sum("nc")).alias(f"c{a}") for a in "xyz"],
        F.sum("nc").alias("n"),
        F.max_by("c", F.struct(F.col("nc"), (-F.col("c")).alias("small_first"))).alias("winner"),
        *extra,
    )


def drop_void(voxels: DataFrame) -> DataFrame:
    """VOID voxels go after the vote; the remaining classes shift down by one."""
    return voxels.where(F.col("winner") != 0).withColumn("segment", remap_after_void(F.col("winner")))


def zero_filled_histogram(df: DataFrame, cls: Column, classes: int, keys: Sequence[str]) -> DataFrame:
    """Counts per key and class including classes that never occur, in one aggregation."""
    bins = [F.count_if(cls == i).alias(f"b{i}") for i in range(classes)]
    wide = df.groupBy(*keys).agg(*bins)
    packed = F.array(*[F.col(f"b{i}") for i in range(classes)])
    return wide.select(*keys, F.posexplode(packed).alias("class_id", "n"))


def roll_up(hist: DataFrame, sample: str, cls: str, count: str) -> DataFrame:
    """Class counts per sample and over all samples (``all_samples`` = 1)."""
    sets = hist.groupingSets([[sample, cls], [cls]], sample, cls)
    return sets.agg(F.sum(count).alias("n"), F.grouping(sample).cast("bigint").alias("all_samples"))


def bounding_box(df: DataFrame, keys: Sequence[str], coords=("x", "y", "z")) -> DataFrame:
    aggs = [F.min(c).alias(f"{c}_min") for c in coords] + [F.max(c).alias(f"{c}_max") for c in coords]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *aggs)


def xy_density(df: DataFrame, keys: Sequence[str], budget: int) -> DataFrame:
    """Points per square metre of the XY box, and the tile edge that would hold ``budget``."""
    box = bounding_box(df, keys, ("x", "y"))
    area = (F.col("x_max") - F.col("x_min")) * (F.col("y_max") - F.col("y_min"))
    density = F.when(area > 0, F.col("n") / area)
    return box.select(
        *keys, "n", area.alias("area"), density.alias("density"), F.sqrt(F.lit(float(budget)) / density).alias("tile")
    )


def global_tile(per_sample: DataFrame, sample: str = "sample") -> DataFrame:
    """The smallest suggested tile, floored to one decimal, and the sample that asks for it."""
    return per_sample.where("tile IS NOT NULL").agg(
        F.min_by(sample, F.struct("tile", sample)).alias("densest"),
        (F.floor(F.min("tile") * 10) / 10).alias("tile_floor"),
    )


def colour_average(df: DataFrame, grid: float, keys: Sequence[str], colours=("r", "g", "b")) -> DataFrame:
    """Mean position and colour per voxel, cells counted from the minimum corner."""
    low = df.groupBy(*keys).agg(*[F.min(a).alias(f"_m{a}") for a in "xyz"])
    placed = df.join(low, list(keys))
    for a in "xyz":
        placed = placed.withColumn(f"v{a}", F.floor((F.col(a) - F.col(f"_m{a}")) / F.lit(grid)))
    return placed.groupBy(*keys, "vx", "vy", "vz").agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"avg_{c}") for c in ("x", "y", "z", *colours)]
    )


def dominant_colours(df: DataFrame, keys: Sequence[str], share: float = 0.005, colours=("r", "g", "b")) -> DataFrame:
    """Colour counts per scene with their percentage, only colours of at least ``share``."""
    counts = df.groupBy(*keys, *colours).agg(F.count("*").alias("n"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
    pct = F.col("n") * 100.0 / F.col("_total")
    return counts.join(total, list(keys)).where(F.col("n") >= F.lit(share) * F.col("_total")).select(*keys, *colours, "n", pct.alias("pct"))


def colour_scenes(dominant: DataFrame, scene: str, colours=("r", "g", "b")) -> DataFrame:
    """In how many scenes, and which, each dominant colour occurs."""
    return dominant.groupBy(*colours).agg(
        F.count("*").alias("scenes"), F.sum("n").alias("n"), F.array_sort(F.collect_set(scene)).alias("scene_list")
    )
