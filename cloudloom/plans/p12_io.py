"""Sources, sinks and log analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.functions import geometry as g
from cloudloom.functions.weights import pack_edge
from cloudloom.operators import logs
from cloudloom.plans.registry import q6, query, r6
from cloudloom.sources import points as src
from cloudloom.sources import sinks
from cloudloom.sources.tables import lattice_points, predictions, scan_points, table


def _point_lines(spark, root):
    """The lattice cloud as ASCII file lines, header and body, per sample."""
    lat = lattice_points(spark, root)
    body = lat.select("sample", F.format_string("%.3f %.3f  %.3f %d 13033652", "x", "y", "z", "c").alias("value"))
    counts = lat.groupBy("sample").agg(F.count("*").alias("n"))
    text = ["# cloud", "VERSION 0.7", "FIELDS x y z classification rgb", "SIZE 4 4 4 1 4", "TYPE F F F U F", "COUNT 1 1 1 1 1", "WIDTH @", "HEIGHT 1", "POINTS @", "DATA ascii"]
    head = counts.select("sample", F.explode(F.array(*[F.replace(F.lit(t), F.lit("@"), F.col("n").cast("string")) for t in text])).alias("value"))
    return head.unionByName(body)


@query("src_pcd_header", "SELECT sample, count(*) AS points, count(*) AS rows_found FROM lat GROUP BY 1", "lat")
def src_pcd_header(spark, root):
    lines = _point_lines(spark, root)
    said = F.max(F.when(F.col("value").startswith("POINTS"), F.regexp_extract("value", r"(\d+)", 1).cast("bigint")))
    return lines.groupBy("sample").agg(said.alias("points"), F.count_if(src.is_data_line(F.col("value"))).alias("rows_found"))


@query("src_pcd_stream", f"SELECT sample, c, count(*) AS n, {q6('sum(x)', 3)} AS sx, {q6('sum(y)', 3)} AS sy, {q6('sum(z)', 3)} AS sz FROM lat GROUP BY 1, 2", "lat")
def src_pcd_stream(spark, root):
    lines = _point_lines(spark, root)
    pts = src.parse_body(lines.where(src.is_data_line(F.col("value"))))
    return pts.groupBy("sample", "c").agg(F.count("*").alias("n"), *[r6(F.sum(a), 3).alias(f"s{a}") for a in "xyz"])


@query("src_dataset", "SELECT concat_ws('-', CASE WHEN p.scene_id = 1 THEN 'validation' ELSE 'training' END, 's' || p.scene_id) AS name, p.point_id, e.support AS s_weight, CASE WHEN p.point_id % 2 = 0 THEN e.valid END AS mask FROM pts p LEFT JOIN pred e ON e.point_id = p.point_id AND e.scene_id <> 3 WHERE p.scene_id <> 2", "pts pred")
def src_dataset(spark, root):
    pts = scan_points(spark, root).withColumn("sample", F.when(F.col("scene_id") == 2, ".hidden").otherwise(F.concat(F.lit("s"), F.col("scene_id").cast("string"))))
    pts = pts.where(~F.startswith(F.col("sample"), F.lit(".")))
    e = predictions(spark, root).where("scene_id <> 3")
    fields = {
        "s_weight": e.select("scene_id", "point_id", F.col("support").alias("s_weight")),
        "mask": e.where("point_id % 2 = 0").select("scene_id", "point_id", F.col("valid").alias("mask")),
    }
    out = src.with_optional(pts.select("scene_id", "point_id", "sample"), fields)
    split = F.when(F.col("scene_id") == 1, "validation").otherwise("training")
    return out.select(F.concat_ws("-", split, "sample").alias("name"), "point_id", "s_weight", "mask")


def _paths(spark, root):
    o = table(spark, root, "orders")
    split = F.element_at(F.array(*[F.lit(s) for s in ("training", "validation", "test", "misc")]), (F.col("o_custkey") % 4 + 1).cast("int"))
    return o.select(F.concat(F.lit("/data/"), split, F.lit("/S"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, ".txt").otherwise(".pcd")).alias("path"))


_PATH_SQL = "paths AS (SELECT o_orderkey, ['training','validation','test','misc'][o_custkey % 4 + 1] AS split FROM orders WHERE o_orderkey % 3 <> 0)"


@query("src_discover", f"WITH {_PATH_SQL}, w AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') SELECT 'S' || o_orderkey AS sample, coalesce(split, 'missing') AS state FROM w LEFT JOIN (SELECT * FROM paths WHERE split <> 'misc') USING (o_orderkey)")
def src_discover(spark, root):
    wanted = table(spark, root, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("S"), F.col("o_orderkey").cast("string")).alias("sample"))
    hit, missing = src.discover(_paths(spark, root), wanted)
    return hit.select("sample", F.col("split").alias("state")).unionByName(missing.select("sample", F.lit("missing").alias("state")))


@query("src_tasks", "SELECT '/data/o' || l_orderkey AS dir FROM lineitem WHERE l_linenumber IN (1, 2) GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) = 2")
def src_tasks(spark, root):
    name = F.element_at(F.create_map(F.lit(1), F.lit("coord.npy"), F.lit(2), F.lit("segment.npy")), F.col("l_linenumber"))
    files = table(spark, root, "lineitem").select(F.concat(F.lit("/data/o"), F.col("l_orderkey").cast("string"), F.lit("/"), F.coalesce(name, F.lit("other.npy"))).alias("path"))
    return src.scene_dirs(files, ["coord.npy", "segment.npy"])


@query("src_paired", "WITH a AS (SELECT l_orderkey AS scene FROM lineitem WHERE l_linenumber IN (1, 2) GROUP BY 1 HAVING count(DISTINCT l_linenumber) = 2), b AS (SELECT l_orderkey AS scene FROM lineitem WHERE l_linenumber IN (3, 4) GROUP BY 1 HAVING count(DISTINCT l_linenumber) = 2) SELECT scene FROM a JOIN b USING (scene)")
def src_paired(spark, root):
    li = table(spark, root, "lineitem")

    def complete(lines):
        return li.where(F.col("l_linenumber").isin(lines)).groupBy(F.col("l_orderkey").alias("scene")).agg(F.count_distinct("l_linenumber").alias("k")).where("k = 2").select("scene")

    return src.paired(complete([1, 2]), complete([3, 4]), "scene")


@query("src_restructure", "SELECT c_custkey, CASE WHEN c_nationkey % 6 + 1 = 5 THEN 'validation' ELSE 'training' END AS split, 'Area_' || (c_nationkey % 6 + 1) || '_' || c_mktsegment AS dest FROM customer")
def src_restructure(spark, root):
    rooms = table(spark, root, "customer").select("c_custkey", (F.col("c_nationkey") % 6 + 1).alias("area"), F.col("c_mktsegment").alias("room"))
    return src.restructure(rooms).select("c_custkey", "split", "dest")


def _log_lines(spark, root):
    e = table(spark, root, "events").select("event_id", "event_type", F.format_string("%.4f", "value").alias("v"), (F.col("user_id") % 5).alias("log"))
    v, kind = F.col("v"), F.col("event_type")
    cls = F.element_at(F.array(*[F.lit(c) for c in logs.CLASS_NAMES]), (F.col("event_id") % 8 + 1).cast("int"))
    line = (
        F.when(kind == "click", F.concat(F.lit("[x] Val/Test: [3/9] val_boundary_mIoU: "), v, F.lit(" support_bce: "), v, F.lit(" mIoU: 0.1")))
        .when(kind == "signup", F.concat(F.lit("[x] Val result: mIoU/mAcc/allAcc "), v, F.lit("/0.5000/0.6000")))
        .when(kind == "purchase", F.concat(F.lit("[x] Train result: loss="), v, F.lit(" loss_semantic=0.25 loss_support="), v, F.lit(" loss_focus=-1.5")))
        .when(kind == "view", F.concat(cls, F.lit(" Result: iou/accuracy "), v, F.lit("/0.9")))
        .otherwise(F.lit("noise line a=1 b=2.5"))
    )
    return e.select("log", F.col("event_id").alias("line_no"), line.alias("value"))


LOG_SQL = """lg AS (SELECT user_id % 5 AS log, event_id AS line_no, event_type AS k, printf('%.4f', value) AS v,
   CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS INTEGER) AS epoch FROM events),
 vl AS (SELECT log, epoch, v AS miou FROM lg WHERE k = 'signup'),
 tr AS (SELECT log, epoch, arg_max(v, line_no) AS loss FROM lg WHERE k = 'purchase' AND epoch > 0 GROUP BY 1, 2),
 bt AS (SELECT log, epoch + 1 AS epoch, arg_max(v, line_no) AS b FROM lg WHERE k = 'click' GROUP BY 1, 2),
 ep AS (SELECT log, epoch, miou, loss, b FROM vl LEFT JOIN tr USING (log, epoch) LEFT JOIN bt USING (log, epoch))"""


@query("win_log_backfill", f"WITH {LOG_SQL} SELECT log, epoch, miou AS val_miou, loss AS train_loss, b AS boundary_miou, CASE WHEN loss IS NOT NULL THEN '' END AS train_focus FROM ep")
def win_log_backfill(spark, root):
    t = logs.epoch_table(_log_lines(spark, root), "focus")
    return t.select("log", "epoch", F.col("val_mIoU").alias("val_miou"), "train_loss", F.col("val_boundary_mIoU").alias("boundary_miou"), F.col("train_loss_focus").alias("train_focus"))


@query("src_log", f"WITH {LOG_SQL} SELECT log, epoch, count(*) AS lines FROM lg GROUP BY 1, 2")
def src_log(spark, root):
    return logs.numbered(_log_lines(spark, root)).groupBy("log", "epoch").agg(F.count("*").alias("lines"))


@query("fn_regex_kv", f"WITH {LOG_SQL} SELECT log, line_no, CASE WHEN k = 'purchase' THEN v END AS loss, CASE WHEN k = 'purchase' THEN 3 WHEN k = 'error' THEN 2 ELSE 0 END AS pairs FROM lg")
def fn_regex_kv(spark, root):
    kv = _log_lines(spark, root).withColumn("m", logs.key_values(F.col("value")))
    return kv.select("log", "line_no", F.try_element_at("m", F.lit("loss")).alias("loss"), F.size("m").alias("pairs"))


_CLS = ", ".join(f"""arg_max(printf('%.4f', value + {i}), event_id) FILTER (WHERE event_type = 'view') AS "{c}\"""" for i, c in enumerate(logs.CLASS_NAMES))


@query(
    "log_per_class",
    f"""WITH e AS (SELECT *, user_id % 5 AS log, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS INTEGER) AS epoch FROM events WHERE event_type IN ('signup', 'view'))
        SELECT log, epoch, {_CLS} FROM e GROUP BY 1, 2 HAVING count_if(event_type = 'view') > 0""",
)
def log_per_class(spark, root):
    """Every ``view`` event reports all eight classes on eight lines."""
    e = table(spark, root, "events").where("event_type IN ('signup', 'view')").select("event_type", "event_id", "value", (F.col("user_id") % 5).alias("log"))
    names = F.array(*[F.lit(c) for c in logs.CLASS_NAMES])
    val = e.where("event_type = 'signup'").select("log", (F.col("event_id") * 8).alias("line_no"), F.concat(F.lit("Val result: mIoU/mAcc/allAcc "), F.format_string("%.4f", "value"), F.lit("/0.5/0.6")).alias("value"))
    cls = e.where("event_type = 'view'").select("log", "event_id", F.col("value").alias("v"), F.posexplode(names).alias("i", "name"))
    cls = cls.select("log", (F.col("event_id") * 8 + F.col("i")).alias("line_no"), F.concat("name", F.lit(" Result: iou/accuracy "), F.format_string("%.4f", F.col("v") + F.col("i")), F.lit("/0.9")).alias("value"))
    return logs.class_table(val.unionByName(cls))


@query("log_run_type", f"SELECT DISTINCT user_id % 5 AS log, 'focus' AS run_type FROM events WHERE event_type = 'purchase'")
def log_run_type(spark, root):
    return logs.run_type(_log_lines(spark, root))


@query("log_best_epoch", f"WITH {LOG_SQL} SELECT log, CAST(coalesce(arg_max(CASE WHEN miou::DOUBLE > 0 THEN epoch END, (miou::DOUBLE, -epoch)), 0) AS INTEGER) AS best_epoch, max(miou::DOUBLE) AS best_miou, count(*) AS epochs FROM ep GROUP BY 1")
def log_best_epoch(spark, root):
    return logs.best_epoch(logs.epoch_table(_log_lines(spark, root), "focus"))


@query("snk_edge", f"SELECT point_id, {q6('CAST(vx AS FLOAT)')} AS e0, {q6('CAST(vy AS FLOAT)')} AS e1, {q6('CAST(vz AS FLOAT)')} AS e2, {q6('CAST(support AS FLOAT)')} AS e3, {q6('CAST(valid AS FLOAT)')} AS e4 FROM pred", "pred")
def snk_edge(spark, root):
    e = predictions(spark, root).select("point_id", pack_edge(g.vec("v"), F.col("support"), F.col("valid")).alias("e"))
    return e.select("point_id", *[r6(F.col("e")[i]).alias(f"e{i}") for i in range(5)])


@query("snk_xyz", "SELECT point_id, printf('%.6f %.6f %.6f %.6f %.0f %.0f', x, y, z, support, valid, point_id::DOUBLE) AS line FROM pred WHERE valid > 0.5", "pred")
def snk_xyz(spark, root):
    rows = predictions(spark, root).where("valid > 0.5")
    return rows.select("point_id", sinks.xyz_line([F.col(c) for c in ("x", "y", "z", "support")], [F.col("valid"), F.col("point_id")]).alias("line"))


@query("snk_csv", f"WITH {LOG_SQL} SELECT CAST(log AS VARCHAR) AS log, CAST(epoch AS VARCHAR) AS epoch, miou AS \"val_mIoU\", coalesce(loss, '') AS train_loss, '' AS train_loss_edge FROM ep")
def snk_csv(spark, root):
    return sinks.csv_frame(logs.epoch_table(_log_lines(spark, root), "focus"), ["log", "epoch", "val_mIoU", "train_loss", "train_loss_edge"])


@query("snk_gt_xyz", "SELECT point_id, printf('%.6f %.6f %.6f', x, y, z) || CASE segment WHEN 0 THEN ' 230 25 75' WHEN 1 THEN ' 60 180 75' WHEN 2 THEN ' 255 225 25' ELSE ' 0 0 0' END AS value FROM pts", "pts")
def snk_gt_xyz(spark, root):
    return sinks.coloured_lines(scan_points(spark, root), 3)


@query("snk_pred", "SELECT DISTINCT o_custkey AS scene_id FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def snk_pred(spark, root):
    o = table(spark, root, "orders").select(F.col("o_custkey").alias("scene_id"), "o_orderstatus")
    return sinks.missing_predictions(o.select("scene_id").distinct(), o.where("o_orderstatus = 'F'"))


_DIG = """rw AS (SELECT scene_id, point_id, printf('%.6f %.6f %.6f ', x, y, z) || segment AS t FROM pts), bl AS (SELECT scene_id, point_id // 4096 AS b, sha256(string_agg(t, '|' ORDER BY point_id)) AS d FROM rw GROUP BY 1, 2),
 dg AS (SELECT scene_id, sha256(string_agg(d, '|' ORDER BY b)) AS digest FROM bl GROUP BY 1)"""


@query("snk_chunk", f"WITH {_DIG} SELECT * FROM dg", "pts")
def snk_chunk(spark, root):
    return sinks.chunk_digests(scan_points(spark, root), ["scene_id"])


@query("snk_manifest", """SELECT sample, '{"sample":' || sample || ',"n":' || sum(n) || ',"chunks":[' || string_agg('{"chunk_idx":' || c || ',"n":' || n || ',"digest":"d' || c || '"}', ',' ORDER BY c) || ']}' AS value
   FROM (SELECT sample, CAST(floor(x / 10) AS BIGINT) AS c, count(*) AS n FROM lat GROUP BY 1, 2) GROUP BY 1""", "lat")
def snk_manifest(spark, root):
    chunks = lattice_points(spark, root).groupBy("sample", F.floor(F.col("x") / 10).alias("chunk_idx")).agg(F.count("*").alias("n"))
    return sinks.manifest(chunks.withColumn("digest", F.concat(F.lit("d"), F.col("chunk_idx").cast("string"))))


@query("snk_state", "SELECT o_orderkey AS sample, 'done' AS status FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'partial' FROM orders WHERE o_orderstatus <> 'F'")
def snk_state(spark, root):
    from cloudloom.operators.validation import merge_state

    o = table(spark, root, "orders").select(F.col("o_orderkey").alias("sample"), "o_orderstatus")
    return merge_state(o.select("sample", F.lit("partial").alias("status")), o.where("o_orderstatus = 'F'").select("sample", F.lit("done").alias("status")))


@query("src_scene_npy", f"SELECT CAST(point_id // 4096 AS VARCHAR) AS scene, point_id % 4096 AS point_id, {q6('CAST(x AS FLOAT)', 5)} AS x, {q6('CAST(z AS FLOAT)', 5)} AS z, segment FROM pts", "pts")
def src_scene_npy(spark, root):
    """The scan written as array files of 4096 points each and read back."""
    blocks = scan_points(spark, root).withColumn("block", F.floor(F.col("point_id") / 4096))
    out = src.decode_scenes(src.encode_scenes(blocks.select("block", "point_id", "x", "y", "z", "segment"), "block"))
    return out.select("scene", "point_id", r6("x", 5).alias("x"), r6("z", 5).alias("z"), "segment")
