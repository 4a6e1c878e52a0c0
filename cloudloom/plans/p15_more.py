"""Digest trees, table functions in SQL text, and the epoch table as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cloudloom.operators import digest, tablefn
from cloudloom.plans.p12_io import LOG_SQL, _log_lines
from cloudloom.plans.registry import q6, query, r6
from cloudloom.session import shared_dir
from cloudloom.sources.tables import scan_points, table

_ROW = "printf('%.6f %.6f %.6f ', x, y, z) || segment"
_TREE = f"""rw AS (SELECT scene_id, point_id, {_ROW} AS t FROM pts),
 l0 AS (SELECT scene_id, point_id // 16 AS node, count(*) AS rows, sha256(string_agg(t, '|' ORDER BY point_id)) AS d FROM rw GROUP BY 1, 2),
 l1 AS (SELECT scene_id, node // 16 AS node, sum(rows) AS rows, sha256(string_agg(d, '|' ORDER BY node)) AS d FROM l0 GROUP BY 1, 2),
 l2 AS (SELECT scene_id, node // 16 AS node, sum(rows) AS rows, sha256(string_agg(d, '|' ORDER BY node)) AS d FROM l1 GROUP BY 1, 2)"""


def _row():
    return F.concat_ws(" ", *[F.format_string("%.6f", F.col(a)) for a in "xyz"], F.col("segment").cast("string"))


def _tree(points):
    return digest.digest_tree(points, ["scene_id"], "point_id", _row(), 16)


@query("val_digest_tree", f"WITH {_TREE} SELECT scene_id, 3 AS levels, d AS digest, CAST(rows AS BIGINT) AS rows FROM l2", "pts")
def val_digest_tree(spark, root):
    """Roots of trees of fan-out 16."""
    return digest.roots(_tree(scan_points(spark, root)), ["scene_id"])


@query("val_digest_changes", "SELECT scene_id, point_id // 16 AS node, CASE WHEN max(k) = 2 AND min(k) = 2 THEN 'removed' ELSE 'changed' END AS change FROM (SELECT *, CASE WHEN point_id // 16 = 3 THEN 2 WHEN point_id % 97 = 5 THEN 1 ELSE 0 END AS k FROM pts) GROUP BY 1, 2 HAVING max(k) > 0", "pts")
def val_digest_changes(spark, root):
    """Blocks that differ after one block went and some points moved."""
    pts = scan_points(spark, root)
    moved = pts.where(F.floor(F.col("point_id") / 16) != 3).withColumn("z", F.when(F.col("point_id") % 97 == 5, F.col("z") + 1).otherwise(F.col("z")))
    return digest.changed_nodes(_tree(pts), _tree(moved), ["scene_id"], 16)


_SEG = "sg AS (SELECT a.point_id AS seg, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz FROM pts a JOIN pts b ON b.point_id = a.point_id + 4)"


@query("udtf_segment_samples", f"""WITH {_SEG}, n AS (SELECT *, greatest(CAST(ceil(sqrt((bx-ax)*(bx-ax) + (by_-ay)*(by_-ay) + (bz-az)*(bz-az)) / 0.05::DOUBLE) AS INTEGER) + 1, 2) AS n FROM sg),
    s AS (SELECT *, unnest(range(n))::INTEGER AS i FROM n)
    SELECT seg, i, {q6('ax + (i / (n - 1)) * (bx - ax)')} AS x, {q6('ay + (i / (n - 1)) * (by_ - ay)')} AS y, {q6('az + (i / (n - 1)) * (bz - az)')} AS z FROM s""", "pts")
def udtf_segment_samples(spark, root):
    """Samples along segments, asked for by LATERAL in SQL text."""
    tablefn.register(spark)
    name = f"segments_{uuid.uuid4().hex}"
    a, b = scan_points(spark, root).select("point_id", "x", "y", "z"), scan_points(spark, root)
    b = b.select((F.col("point_id") - 4).alias("point_id"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    a.join(b, "point_id").createOrReplaceTempView(name)
    out = spark.sql(f"SELECT s.point_id AS seg, t.* FROM {name} s, LATERAL segment_samples(s.x, s.y, s.z, s.bx, s.by, s.bz, 0.05D) t")
    return out.select("seg", "i", *[r6(c).alias(c) for c in "xyz"])


@query("udtf_padded_bounds", f"SELECT scene_id, count(*) AS n, {', '.join(f'{q6(f'min({a}) - 0.25')} AS {a}_min, {q6(f'max({a}) + 0.25')} AS {a}_max' for a in 'xyz')} FROM pts GROUP BY 1", "pts")
def udtf_padded_bounds(spark, root):
    """Padded bounds of each scene, the table handed over as an argument that the function partitions."""
    tablefn.register(spark)
    name = f"scans_{uuid.uuid4().hex}"
    scan_points(spark, root).createOrReplaceTempView(name)
    out = spark.sql(f"SELECT * FROM padded_bounds(TABLE({name}), 'scene_id', 0.25D)")
    return out.select("scene_id", "n", *[r6(f"{a}_{e}").alias(f"{a}_{e}") for a in "xyz" for e in ("min", "max")])


@query("log_epoch_stream", f"WITH {LOG_SQL} SELECT log, epoch, miou AS val_miou, loss AS train_loss, b AS boundary_miou, CASE WHEN loss IS NOT NULL THEN '' END AS train_focus FROM ep")
def log_epoch_stream(spark, root):
    """The epoch table from a stream of log lines in three steps, state carried between them."""
    from cloudloom.streaming import epochs

    folder = f"{shared_dir(spark).rstrip('/')}/epochs-{uuid.uuid4().hex}"
    lines = _log_lines(spark, root)
    ends = lines.agg(F.percentile_approx("line_no", F.array(F.lit(0.4), F.lit(0.7))).alias("e")).first()["e"] or [0, 0]
    kept = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(kept)
    spark.conf.set(kept, epochs.ROCKS)
    try:
        parts = [F.col("line_no") <= ends[0], (F.col("line_no") > ends[0]) & (F.col("line_no") <= ends[1]), F.col("line_no") > ends[1]]
        for part in parts:
            lines.where(part).write.mode("append").parquet(f"{folder}/lines")
            stream = spark.readStream.schema("log long, line_no long, value string").parquet(f"{folder}/lines")
            job = epochs.epoch_stream(stream, "focus").writeStream.format("parquet").outputMode("append")
            job.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/epochs").awaitTermination()
    finally:
        spark.conf.set(kept, before)
    t = epochs.settled(spark.read.parquet(f"{folder}/epochs"), "focus")
    return t.select("log", "epoch", F.col("val_mIoU").alias("val_miou"), "train_loss", F.col("val_boundary_mIoU").alias("boundary_miou"), F.col("train_loss_focus").alias("train_focus"))
