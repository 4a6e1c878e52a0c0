"""Point files and the chunk store, written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cloudloom.plans.registry import q6, query, r6
from cloudloom.session import shared_dir
from cloudloom.sources import chunkstore, pointfile
from cloudloom.sources.tables import lattice_points, scan_points

_SUMS = f"count(*) AS n, {q6('sum(x)', 3)} AS sx, {q6('sum(y)', 3)} AS sy, {q6('sum(z)', 3)} AS sz"


def _folder(spark, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _written(spark, root, kind: str) -> str:
    """The lattice cloud as point files, two folders of splits, eight files a sample."""
    folder = _folder(spark, kind)
    pts = lattice_points(spark, root)
    part = F.pmod(F.xxhash64("x", "y", "z", "c"), F.lit(8))
    split = F.when(F.col("sample") == 4, "validation").otherwise("training")
    pts = pts.withColumn("file", F.concat(split, F.lit("/S"), F.col("sample").cast("string"), F.lit("/p"), part.cast("string")))
    pointfile.write_points(pts, folder, kind)
    return folder


def _sums(df, *keys):
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[r6(F.sum(a), 3).alias(f"s{a}") for a in "xyz"])


@query("src_points_pcd", f"SELECT CASE WHEN sample = 4 THEN 'validation' ELSE 'training' END AS split, c, {_SUMS} FROM lat GROUP BY 1, 2", "lat")
def src_points_pcd(spark, root):
    """ASCII files read in ranges of 20 kB, headers parsed, rows counted in the same job."""
    return _sums(pointfile.read_points(spark, _written(spark, root, "pcd"), 20_000), "split", "c")


@query("src_points_ply", f"SELECT CASE WHEN sample = 4 THEN 'validation' ELSE 'training' END AS split, c, {_SUMS} FROM lat GROUP BY 1, 2", "lat")
def src_points_ply(spark, root):
    """Binary files of fixed-width records, read in ranges of 20 kB."""
    return _sums(pointfile.read_points(spark, _written(spark, root, "ply"), 20_000), "split", "c")


@query("src_points_counts", "SELECT CASE WHEN sample = 4 THEN 'validation' ELSE 'training' END AS split, count(*) AS points, count(*) AS n FROM lat GROUP BY 1", "lat")
def src_points_counts(spark, root):
    """What the headers say next to the records found."""
    return pointfile.counts(spark, _written(spark, root, "pcd"), 20_000).groupBy("split").agg(F.sum("points").alias("points"), F.sum("n").alias("n"))


def _chunk_rows(spark, root):
    """The scan as samples (its scenes) of four chunks each, normals of unit length."""
    p = scan_points(spark, root)
    size = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    return p.select(
        F.lit("training").alias("split"), F.concat(F.lit("s"), F.col("scene_id").cast("string")).alias("sample"), F.concat(F.lit("h"), F.col("scene_id").cast("string")).alias("source_hash"),
        F.pmod(F.floor(F.col("point_id") / 4), F.lit(4)).cast("int").alias("chunk_idx"), "point_id", "x", "y", "z", "segment", *[(F.col(f"n{a}") / size).alias(f"n{a}") for a in "xyz"],
    )


_CHUNKED = "ck AS (SELECT 's' || scene_id AS sample, CAST((point_id // 4) % 4 AS INTEGER) AS chunk_idx, point_id, x, y, z, segment FROM pts)"


@query("snk_chunk_store", f"WITH {_CHUNKED} SELECT sample, chunk_idx, count(*) AS n, CAST(sum(segment) AS BIGINT) AS classes, {q6('sum(CAST(x AS FLOAT)::DOUBLE)', 3)} AS sx, {q6('sum(CAST(z AS FLOAT)::DOUBLE)', 3)} AS sz FROM ck GROUP BY 1, 2", "pts")
def snk_chunk_store(spark, root):
    """Chunks written in two phases and read back through the commit log, every array checked against its digest."""
    folder = _folder(spark, "chunks")
    chunkstore.write(_chunk_rows(spark, root), folder)
    got = chunkstore.points(spark, folder)
    return got.groupBy("sample", "chunk_idx").agg(F.count("*").alias("n"), F.sum("segment").alias("classes"), r6(F.sum(F.col("x").cast("double")), 3).alias("sx"), r6(F.sum(F.col("z").cast("double")), 3).alias("sz"))


@query("snk_chunk_resume", f"WITH {_CHUNKED} SELECT sample, CASE WHEN sample IN ('s0', 's1') THEN 0 ELSE 1 END AS job, 'done' AS status, count(DISTINCT chunk_idx) AS chunks FROM ck GROUP BY 1", "pts")
def snk_chunk_resume(spark, root):
    """Two samples are written first; the run over all writes only the open ones."""
    folder = _folder(spark, "chunks")
    rows = _chunk_rows(spark, root)
    chunkstore.write(rows.where("sample IN ('s0', 's1')"), folder)
    chunkstore.write(rows, folder)
    done = chunkstore.state(spark, folder).select("sample", "status")
    return chunkstore.chunks(spark, folder).groupBy("sample", "job").agg(F.count("*").alias("chunks")).join(done, "sample")
