"""Windows, ordering, limits and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cloudloom.functions import grid
from cloudloom.operators import boundary, chunking, supervise
from cloudloom.operators.axes import largest_gap
from cloudloom.operators.neighbors import k_nearest
from cloudloom.operators.pairs import seeded_sample
from cloudloom.plans.derived import SIZE, SUP_SQL, cluster_members, support_tables
from cloudloom.plans.p03_joins import OTHER_SQL, knn_sql
from cloudloom.plans.registry import q6, query, r6
from cloudloom.sources.tables import lattice_points, scan_points, table


@query("win_topk", f"WITH {knn_sql(3)} SELECT point_id, rank, nbr_id FROM knn", "pts")
def win_topk(spark, root):
    pts = scan_points(spark, root)
    return k_nearest(pts, pts, 3, by=["scene_id"], exclude_self=True).select("point_id", "rank", "nbr_id")


@query(
    "win_max_gap",
    f"""WITH s AS (SELECT point_id // {SIZE} AS cluster_id, x, lead(x) OVER (PARTITION BY point_id // {SIZE} ORDER BY x) AS nx FROM pts),
        g AS (SELECT cluster_id, arg_max((x + nx) / 2, (nx - x, -x)) AS cut, max(nx - x) AS gap FROM s WHERE nx IS NOT NULL GROUP BY 1)
        SELECT cluster_id, {q6('cut')} AS cut, {q6('gap')} AS gap FROM g WHERE gap >= 0.05""",
    "pts",
)
def win_max_gap(spark, root):
    out = largest_gap(cluster_members(spark, root), ["cluster_id"], "x", F.lit(0.05))
    return out.select("cluster_id", r6("cut").alias("cut"), r6("gap").alias("gap"))


@query("win_gap_split")
def win_gap_split(spark, root):
    from cloudloom.operators.supports import gap_split

    out = gap_split(cluster_members(spark, root), ["cluster_id"], ratio=0.4)
    return out.groupBy("cluster_id", "path").agg(F.count("*").alias("n"))


@query(
    "win_cumlen",
    f"""WITH {SUP_SQL}, l AS (SELECT support_id, seg, sqrt((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)+(bz-az)*(bz-az)) AS len FROM seg)
        SELECT support_id, seg, {q6('sum(len) OVER (PARTITION BY support_id ORDER BY seg)')} AS arc_end, {q6('sum(len) OVER (PARTITION BY support_id)')} AS total_len FROM l""",
    "pts",
)
def win_cumlen(spark, root):
    _, segs = support_tables(spark, root)
    return supervise.with_arc_length(segs).select("support_id", "seg", r6("arc_end").alias("arc_end"), r6("total_len").alias("total_len"))


@query(
    "win_rep_pick",
    "SELECT CAST(floor(x/0.1::DOUBLE) AS BIGINT) AS gx, CAST(floor(y/0.1::DOUBLE) AS BIGINT) AS gy, CAST(floor(z/0.1::DOUBLE) AS BIGINT) AS gz, min(point_id) AS first_id, arg_min(point_id, ((point_id + 7) * 2654435761 % 4294967296, point_id)) AS drawn_id FROM pts GROUP BY 1, 2, 3",
    "pts",
)
def win_rep_pick(spark, root):
    from cloudloom.operators.pairs import seeded_order

    cells = [grid.grid_index(F.col(a), 0.1).alias(f"g{a}") for a in "xyz"]
    draw = F.struct(seeded_order(F.col("point_id"), 7).alias("o"), F.col("point_id").alias("i"))
    return scan_points(spark, root).groupBy(*cells).agg(F.min("point_id").alias("first_id"), F.min_by("point_id", draw).alias("drawn_id"))


@query("win_reid", f"SELECT point_id // {SIZE} AS cluster_id, segment, CAST(dense_rank() OVER (PARTITION BY point_id // {SIZE} ORDER BY segment) - 1 AS INTEGER) AS new_id FROM pts GROUP BY 1, 2", "pts")
def win_reid(spark, root):
    groups = cluster_members(spark, root).select("cluster_id", "segment").distinct()
    return groups.withColumn("new_id", F.dense_rank().over(Window.partitionBy("cluster_id").orderBy("segment")) - 1)


@query("win_scene_min", "WITH m AS (SELECT scene_id, min(x) AS mx, min(y) AS my FROM pts GROUP BY 1) SELECT point_id, x - mx AS dx, y - my AS dy FROM pts JOIN m USING (scene_id)", "pts")
def win_scene_min(spark, root):
    pts = scan_points(spark, root)
    low = pts.groupBy("scene_id").agg(F.min("x").alias("mx"), F.min("y").alias("my"))
    return pts.join(low, "scene_id").select("point_id", (F.col("x") - F.col("mx")).alias("dx"), (F.col("y") - F.col("my")).alias("dy"))


@query("srt_chunks", f"WITH c AS (SELECT scene_id, point_id // {SIZE} AS cluster_id, avg(x) AS cx FROM pts GROUP BY 1, 2) SELECT scene_id, cluster_id, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY cx, cluster_id) - 1 AS INTEGER) AS chunk_idx FROM c", "pts")
def srt_chunks(spark, root):
    pts = scan_points(spark, root).withColumn("cluster_id", F.floor(F.col("point_id") / SIZE))
    stats = pts.groupBy("scene_id", "cluster_id").agg(F.avg("x").alias("_cx"))
    return chunking.order_chunks(stats, ["scene_id"], ["scene_id", "cluster_id"])


@query("srt_packed", "SELECT key, count(*) AS n, min(point_id) AS head FROM (SELECT point_id, CAST(floor(x/0.1::DOUBLE) AS BIGINT) AS key FROM pts) GROUP BY 1 ORDER BY 1", "pts")
def srt_packed(spark, root):
    keyed = scan_points(spark, root).select("point_id", grid.grid_index(F.col("x"), 0.1).alias("key"))
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("point_id").alias("head")).orderBy("key")


@query("lim_budget", "WITH c AS (SELECT sample, count(*) AS n FROM lat GROUP BY 1) SELECT sample, CAST(floor(x / 5) AS BIGINT) AS piece, count(*) AS n FROM lat GROUP BY 1, 2 HAVING count(*) >= 1000", "lat")
def lim_budget(spark, root):
    pieces = lattice_points(spark, root).groupBy("sample", F.floor(F.col("x") / 5).alias("piece")).agg(F.count("*").alias("n"))
    return pieces.where("n >= 1000")


@query("lim_best", "SELECT user_id, arg_max(event_id, (value, -event_id)) AS best_event, max(value) AS best FROM events WHERE value > 0 GROUP BY 1")
def lim_best(spark, root):
    first = F.struct(F.col("value").alias("v"), (-F.col("event_id")).alias("e"))
    return table(spark, root, "events").where("value > 0").groupBy("user_id").agg(F.max_by("event_id", first).alias("best_event"), F.max("value").alias("best"))


@query("lim_sample", "SELECT scene_id, point_id FROM pts QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY (point_id + 11) * 2654435761 % 4294967296, point_id) <= 20", "pts")
def lim_sample(spark, root):
    return seeded_sample(scan_points(spark, root), 20, ["scene_id"], "point_id", seed=11).select("scene_id", "point_id")


@query("set_unique_pairs", "SELECT DISTINCT least(segment, (segment * 3 + point_id) % 10) AS a, greatest(segment, (segment * 3 + point_id) % 10) AS b FROM pts", "pts")
def set_unique_pairs(spark, root):
    other = (F.col("segment") * 3 + F.col("point_id")) % 10
    return scan_points(spark, root).select(F.least("segment", other).alias("a"), F.greatest("segment", other).alias("b")).distinct()


@query("set_dedupe_index", f"WITH {knn_sql(4)} SELECT point_id, nbr_id AS member FROM knn UNION SELECT point_id, point_id FROM pts", "pts")
def set_dedupe_index(spark, root):
    pts = scan_points(spark, root)
    near = k_nearest(pts, pts, 4, by=["scene_id"], exclude_self=True).select("point_id", F.col("nbr_id").alias("member"))
    return near.unionByName(pts.select("point_id", F.col("point_id").alias("member"))).distinct()


@query("set_mask_algebra", f"WITH {OTHER_SQL} SELECT point_id, CASE WHEN other_dist <= 0.06 THEN 1 WHEN other_dist <= 0.12 THEN 2 WHEN other_dist <= 0.18 THEN 3 ELSE 0 END AS band FROM oth", "pts")
def set_mask_algebra(spark, root):
    near = boundary.nearest_other_class(scan_points(spark, root), ["scene_id"], rmax=0.18)
    return near.select("point_id", boundary.distance_bands(F.col("other_dist")).alias("band"))
