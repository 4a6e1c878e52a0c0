"""Chunked reading of point files: the voxel state of an append-only file source.

Counts and coordinate sums per (voxel, class) are mergeable, so files can be
folded in as they arrive; the vote itself is taken from the finished state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.functions.grid import class_clip, voxel_key
from cloudloom.sources.points import is_data_line, parse_body


def point_stream(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.pcd").text(path)
    sample = F.regexp_extract(F.input_file_name(), r"([^/]+)\.pcd$", 1)
    named = lines.select(sample.alias("sample"), "value")
    return parse_body(named.where(is_data_line(F.col("value"))))


def voxel_state(points: DataFrame, grid: float) -> DataFrame:
    """Running count and sums per (sample, voxel, class); works on streams and tables."""
    keyed = points.select("sample", voxel_key(F.col("x"), F.col("y"), F.col("z"), grid).alias("key"), "x", "y", "z", class_clip(F.col("c")).alias("c"))
    return keyed.groupBy("sample", "key", "c").agg(F.count("*").alias("nc"), *[F.sum(a).alias(f"s{a}") for a in "xyz"])


def vote(state: DataFrame) -> DataFrame:
    return state.groupBy("sample", "key").agg(
        *[(F.sum(f"s{a}") / F.sum("nc")).alias(f"c{a}") for a in "xyz"], F.sum("nc").alias("n"),
        F.max_by("c", F.struct(F.col("nc"), (-F.col("c")).alias("small_first"))).alias("winner"),
    )
