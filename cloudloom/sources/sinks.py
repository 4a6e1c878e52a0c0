"""Sinks: chunks, manifest, text exports, caches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.functions.weights import class_colour
from cloudloom.operators.validation import check_chunk, content_digest


def write_chunks(points: DataFrame, path: str) -> None:
    """Validated chunks as parquet, one folder per split and chunk."""
    bad = check_chunk(points).where("bad > 0").collect()  # at most three rows
    if bad:
        raise ValueError("; ".join(f"{r['bad']} rows fail {r['check']}" for r in bad))
    points.write.mode("overwrite").partitionBy("split", "chunk").parquet(path)


def chunk_digests(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    row = F.concat_ws(" ", *[F.format_string("%.6f", F.col(a)) for a in "xyz"], F.col("segment").cast("string"))
    return content_digest(points, keys, "point_id", row)


def manifest(chunks: DataFrame) -> DataFrame:
    """One JSON document per sample: totals and its chunks in order (chunks per sample are few)."""
    entry = F.struct("chunk_idx", "n", "digest")
    rows = chunks.groupBy("sample").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(entry)).alias("chunks"))
    return rows.select("sample", F.to_json(F.struct("sample", "n", "chunks")).alias("value"))


def write_manifest(chunks: DataFrame, path: str) -> None:
    manifest(chunks).select("value").write.mode("overwrite").text(path)


def xyz_line(floats: Sequence[Column], wholes: Sequence[Column]) -> Column:
    """Space-separated fields, six decimals for floats, none for whole numbers."""
    return F.concat_ws(" ", *[F.format_string("%.6f", c.cast("double")) for c in floats], *[F.format_string("%.0f", c.cast("double")) for c in wholes])


def write_xyz(df: DataFrame, line: Column, path: str) -> None:
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, columns: Sequence[str], path: str) -> None:
    csv_frame(df, columns).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def csv_frame(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly ``columns``: extra ones are left out, missing ones and NULLs are blank."""
    return df.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in columns])


def coloured_lines(points: DataFrame, classes: int) -> DataFrame:
    """x y z r g b lines, out-of-range classes black."""
    rgb = class_colour(F.col("segment"), classes)
    return points.select("point_id", xyz_line([F.col(a) for a in "xyz"], rgb).alias("value"))


def missing_predictions(scenes: DataFrame, cached: DataFrame, key: str = "scene_id") -> DataFrame:
    """Scenes whose prediction is not cached yet."""
    return scenes.join(cached.select(key).distinct(), key, "left_anti")
