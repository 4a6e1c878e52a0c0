"""Point, scene and log sources."""

from __future__ import annotations

import io
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER_LINES = 64

# What a point file's header must say.
FIELDS, SIZES, TYPES = ["x", "y", "z", "classification"], ["4", "4", "4", "1"], ["F", "F", "F", "U"]


class PointFormatError(ValueError):
    pass


def parse_header(lines: Sequence[str]) -> dict[str, int]:
    """Checks the header of an ASCII point file; returns the point count and the body's first line."""
    seen: dict[str, list[str]] = {}
    for number, raw in enumerate(lines):
        words = raw.lstrip("﻿").strip().split()
        if not words or words[0].startswith("#"):
            continue
        seen[words[0].upper()] = words[1:]
        if words[0].upper() == "DATA":
            _check_header(seen)
            return {"points": int(seen["POINTS"][0]), "body": number + 1}
    raise PointFormatError("no DATA line in the header")


def _check_header(seen: dict[str, list[str]]) -> None:
    def need(ok: bool, message: str) -> None:
        if not ok:
            raise PointFormatError(message)

    need(seen["DATA"] == ["ascii"], "only ASCII data is read")
    need(seen.get("FIELDS", [])[:4] == FIELDS, f"FIELDS must start with {FIELDS}")
    need(seen.get("SIZE", [])[:4] == SIZES, f"SIZE must start with {SIZES}")
    need(seen.get("TYPE", [])[:4] == TYPES, f"TYPE must start with {TYPES}")
    need(set(seen.get("COUNT", [])) == {"1"}, "COUNT must be 1 everywhere")
    need(seen.get("HEIGHT") == ["1"], "HEIGHT must be 1")
    need(bool(seen.get("POINTS")), "POINTS is missing")


def read_header(spark: SparkSession, path: str) -> dict[str, int]:
    """Reads the first lines of one file only."""
    lines = [r[0] for r in spark.read.text(path).limit(HEADER_LINES).collect()]
    return parse_header(lines)


def parse_body(lines: DataFrame, value: str = "value") -> DataFrame:
    """x, y, z, c of each data line; further columns are never parsed."""
    words = F.split(F.trim(F.col(value)), r"\s+", 5)
    return lines.withColumn("_w", words).select(
        *[c for c in lines.columns if c != value], *[F.col("_w")[i].cast("double").alias(a) for i, a in enumerate("xyz")], F.col("_w")[3].cast("int").alias("c")
    )


def is_data_line(value: Column) -> Column:
    """Data lines start with a number, header lines with a word or '#'."""
    return F.trim(value).rlike(r"^[-+.\d]")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """All ASCII point files under ``path``: sample, x, y, z, c.

    Files are split across tasks; header lines are told by their first
    character, so no line has to be counted.  ``check_counts`` compares with
    the POINTS lines.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.pcd").text(path).select("value", F.input_file_name().alias("file"))
    sample = F.regexp_extract("file", r"([^/]+)\.pcd$", 1)
    return parse_body(lines.where(is_data_line(F.col("value"))).select(sample.alias("sample"), "value"))


def check_counts(spark: SparkSession, path: str) -> DataFrame:
    """Files whose number of data lines differs from their POINTS line."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.pcd").text(path).select("value", F.input_file_name().alias("file"))
    said = F.max(F.when(F.trim("value").startswith("POINTS"), F.regexp_extract("value", r"(\d+)", 1).cast("bigint")))
    got = lines.groupBy("file").agg(said.alias("points"), F.count_if(is_data_line(F.col("value"))).alias("rows"))
    return got.where(~F.equal_null(F.col("points"), F.col("rows")))


def discover(files: DataFrame, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(split, sample, path) of point files under training/validation/test, and wanted samples not found."""
    hit = files.select(
        F.regexp_extract("path", r"/(training|validation|test)/", 1).alias("split"), F.regexp_extract("path", r"([^/]+)\.pcd$", 1).alias("sample"), "path"
    ).where("split <> '' AND sample <> '' AND NOT startswith(sample, '.')")
    if wanted is None:
        return hit, hit.select("sample").limit(0)
    return hit.join(wanted, "sample", "left_semi"), wanted.join(hit, "sample", "left_anti")


def scene_dirs(files: DataFrame, required: Sequence[str]) -> DataFrame:
    """Directories that hold every required file."""
    parts = files.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("dir"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    have = parts.where(F.col("name").isin(list(required))).groupBy("dir").agg(F.count_distinct("name").alias("_k"))
    return have.where(F.col("_k") == len(required)).select("dir")


def paired(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Scenes complete on both sides."""
    return source.join(target, key)


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """Scene folders of row-aligned .npy arrays -> scene, point_id, x, y, z, segment."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(path)
    files = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("scene"), F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("field"), "content")
    return decode_scenes(files)


def encode_scenes(points: DataFrame, scene: str) -> DataFrame:
    """(scene, field, content): the .npy bytes of coord and segment, rows in id order.

    A file is one group, so scenes have to be of file size (chunks, blocks).
    """
    def pack(arr: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.save(out, arr, allow_pickle=False)
        return out.getvalue()

    def encode(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id")
        coord = pack(pdf[["x", "y", "z"]].to_numpy("float32"))
        return pd.DataFrame({"scene": [str(key[0])] * 2, "field": ["coord", "segment"], "content": [coord, pack(pdf["segment"].to_numpy("int32"))]})

    return points.groupBy(scene).applyInPandas(encode, "scene string, field string, content binary")


def decode_scenes(files: DataFrame) -> DataFrame:
    """Decodes (scene, field, content) rows and joins the arrays of a scene on position.

    Each task decodes whole files, so the file size bounds its memory.
    """
    def decode(names: list[str], width: int, field: str):
        def run(batches):
            for pdf in batches:
                for scene, content in zip(pdf["scene"], pdf["content"]):
                    arr = np.load(io.BytesIO(content), allow_pickle=False)
                    arr = arr.reshape(len(arr), -1)
                    if arr.shape[1] != width:
                        raise ValueError(f"{scene}/{field}: {arr.shape[1]} columns instead of {width}")
                    cols = {n: arr[:, i] for i, n in enumerate(names)}
                    yield pd.DataFrame({"scene": scene, "point_id": np.arange(len(arr)), **cols})

        return run

    coord = files.where("field = 'coord'").mapInPandas(decode(["x", "y", "z"], 3, "coord"), "scene string, point_id bigint, x float, y float, z float")
    seg = files.where("field = 'segment'").mapInPandas(decode(["segment"], 1, "segment"), "scene string, point_id bigint, segment int")
    joined = coord.join(seg, ["scene", "point_id"], "full")
    bad = F.col("x").isNull() | F.col("segment").isNull()
    return joined.withColumn("segment", F.when(bad, F.raise_error(F.concat(F.lit("row counts differ in scene "), F.col("scene"))).cast("int")).otherwise(F.col("segment")))


def with_optional(points: DataFrame, fields: dict[str, DataFrame], keys: Sequence[str] = ("scene_id", "point_id")) -> DataFrame:
    """Left-joins each optional per-point field; absent scenes stay NULL."""
    out = points
    for df in fields.values():
        out = out.join(df, list(keys), "left")
    return out


def restructure(rooms: DataFrame) -> DataFrame:
    """Area 5 becomes validation, every other area training."""
    split = F.when(F.col("area") == 5, "validation").otherwise("training")
    return rooms.select("*", split.alias("split"), F.format_string("Area_%d_%s", "area", "room").alias("dest"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """log, line_no, value.  A log file is one unsplit record, so line numbers need no sort."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("log"), "value")
    return files.select("log", F.posexplode(F.split("value", "\n")).alias("line_no", "value")).where("value <> ''")


def denoise_steps(markdown: str) -> tuple[list[tuple[str, dict]], float]:
    """Denoise steps and drop cap from the fenced YAML after ``## Final Decision``."""
    import yaml

    _, _, tail = markdown.partition("## Final Decision")
    _, _, block = tail.partition("```yaml")
    body, fence, _ = block.partition("```")
    if not fence:
        raise ValueError("no fenced YAML after '## Final Decision'")
    config = yaml.safe_load(body) or {}
    method = config.get("method", "none")
    names = method if isinstance(method, list) else [method]
    params = config.get("params", {}) or {}
    return [(n, dict(params.get(n, {}))) for n in names], float(config.get("max_drop_frac", 0.10))
