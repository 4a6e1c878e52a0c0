"""Voxel aggregation and its statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.operators import voxel
from cloudloom.plans.p01_scalar import KEY_SQL
from cloudloom.plans.registry import q6, query, r6
from cloudloom.sources.tables import lattice_points, scan_points, table

GRID = 5.0
KEY5 = KEY_SQL.format(g="5.0")

VOX_SQL = f"""k AS (SELECT sample, {KEY5} AS key, x, y, z, c FROM lat),
 pc AS (SELECT sample, key, c, count(*) AS nc, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz FROM k GROUP BY 1, 2, 3),
 vox AS (SELECT sample, key, sum(sx)/sum(nc) AS cx, sum(sy)/sum(nc) AS cy, sum(sz)/sum(nc) AS cz, CAST(sum(nc) AS BIGINT) AS n,
   arg_max(c, (nc, -c)) AS winner FROM pc GROUP BY 1, 2)"""


def voxels(spark, root):
    return voxel.majority_vote(lattice_points(spark, root), GRID)


@query("agg_voxel", f"WITH {VOX_SQL} SELECT sample, key, {q6('cx')} AS cx, {q6('cy')} AS cy, {q6('cz')} AS cz, n, winner - 1 AS segment FROM vox WHERE winner <> 0", "lat")
def agg_voxel(spark, root):
    v = voxel.drop_void(voxels(spark, root))
    return v.select("sample", "key", *[r6(f"c{a}").alias(f"c{a}") for a in "xyz"], "n", "segment")


@query(
    "agg_voxel_ext",
    f"""WITH k AS (SELECT {KEY_SQL.format(g="0.25")} AS key, x, y, z, segment AS c FROM pts), pc AS (SELECT key, c, count(*) AS nc, sum(x) AS sx FROM k GROUP BY 1, 2)
        SELECT key % 16 AS bin, key, {q6("sum(sx)/sum(nc)")} AS cx, CAST(sum(nc) AS BIGINT) AS n, arg_max(c, (nc, -c)) AS winner,
        string_agg(c || ':' || nc, ',' ORDER BY c) AS hist FROM pc GROUP BY 2""",
    "pts",
)
def agg_voxel_ext(spark, root):
    from cloudloom.functions.grid import hash_bin

    pts = scan_points(spark, root).withColumnRenamed("segment", "c")
    v = voxel.majority_vote(pts, 0.25, keys=(), hist=True)
    text = F.array_join(F.transform(F.map_entries("hist"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ",")
    return v.select(hash_bin(F.col("key")).alias("bin"), "key", r6("cx").alias("cx"), "n", "winner", text.alias("hist"))


@query("flt_void", f"WITH {VOX_SQL} SELECT sample, count(*) AS pre_drop, CAST(count_if(winner <> 0) AS BIGINT) AS post_drop FROM vox GROUP BY 1", "lat")
def flt_void(spark, root):
    return voxels(spark, root).groupBy("sample").agg(F.count("*").alias("pre_drop"), F.count_if(F.col("winner") != 0).alias("post_drop"))


@query(
    "agg_hist_raw",
    "SELECT s.sample, CAST(r.i AS INTEGER) AS class_id, count(l.c) AS n FROM (SELECT DISTINCT sample FROM lat) s CROSS JOIN range(17) r(i) LEFT JOIN lat l ON l.sample = s.sample AND l.c = r.i GROUP BY 1, 2",
    "lat",
)
def agg_hist_raw(spark, root):
    return voxel.zero_filled_histogram(lattice_points(spark, root), F.col("c"), 17, ["sample"])


@query(
    "agg_hist_final",
    f"WITH {VOX_SQL} SELECT s.sample, CAST(r.i AS INTEGER) AS class_id, count(v.winner) AS n FROM (SELECT DISTINCT sample FROM vox WHERE winner <> 0) s CROSS JOIN range(16) r(i) LEFT JOIN vox v ON v.sample = s.sample AND v.winner = r.i + 1 GROUP BY 1, 2",
    "lat",
)
def agg_hist_final(spark, root):
    return voxel.zero_filled_histogram(voxel.drop_void(voxels(spark, root)), F.col("segment"), 16, ["sample"])


@query("agg_bbox", "SELECT scene_id, count(*) AS n, min(x) AS x_min, min(y) AS y_min, min(z) AS z_min, max(x) AS x_max, max(y) AS y_max, max(z) AS z_max FROM pts GROUP BY 1", "pts")
def agg_bbox(spark, root):
    return voxel.bounding_box(scan_points(spark, root), ["scene_id"])


_DENS = f"""{VOX_SQL}, d AS (SELECT sample, count(*) AS n, (max(cx)-min(cx))*(max(cy)-min(cy)) AS area FROM vox WHERE winner <> 0 GROUP BY 1),
  e AS (SELECT *, n / area AS density, sqrt(20 / (n / area)) AS tile FROM d)"""


def _density(spark, root):
    v = voxel.drop_void(voxels(spark, root)).select("sample", F.col("cx").alias("x"), F.col("cy").alias("y"))
    return voxel.xy_density(v, ["sample"], 20)


@query("agg_density", f"WITH {_DENS} SELECT sample, n, {q6('area', 4)} AS area, {q6('density')} AS density, {q6('tile')} AS tile FROM e", "lat")
def agg_density(spark, root):
    return _density(spark, root).select("sample", "n", r6("area", 4).alias("area"), r6("density").alias("density"), r6("tile").alias("tile"))


@query("agg_density_global", f"WITH {_DENS} SELECT arg_min(sample, (tile, sample)) AS densest, floor(min(tile) * 10) / 10 AS tile_floor FROM e", "lat")
def agg_density_global(spark, root):
    return voxel.global_tile(_density(spark, root))


@query(
    "agg_dataset_stats",
    "SELECT sample, c, count(*) AS n, GROUPING(sample) AS all_samples FROM lat GROUP BY GROUPING SETS ((sample, c), (c))",
    "lat",
)
def agg_dataset_stats(spark, root):
    per_sample = lattice_points(spark, root).groupBy("sample", "c").agg(F.count("*").alias("m"))
    return voxel.roll_up(per_sample, "sample", "c", "m")


@query(
    "agg_chunk_stats",
    "SELECT sample, CAST(floor(x / 10) AS BIGINT) AS chunk, count(*) AS n, CAST(count_if(c = 3) AS BIGINT) AS class_3, min(x) AS x_min, max(x) AS x_max FROM lat GROUP BY 1, 2",
    "lat",
)
def agg_chunk_stats(spark, root):
    return lattice_points(spark, root).groupBy("sample", F.floor(F.col("x") / 10).alias("chunk")).agg(
        F.count("*").alias("n"), F.count_if(F.col("c") == 3).alias("class_3"), F.min("x").alias("x_min"), F.max("x").alias("x_max")
    )


def _coloured(spark, root):
    return table(spark, root, "lineitem").select(
        (F.col("l_suppkey") % 5).alias("scene"),
        (F.col("l_linenumber") * 30).alias("r"),
        F.round(F.col("l_discount") * 100).cast("int").alias("g"),
        F.when(F.col("l_returnflag") == "R", 255).otherwise(0).alias("b"),
        F.col("l_quantity").alias("x"), F.round(F.col("l_tax") * 100).alias("y"), F.col("l_linenumber").cast("double").alias("z"),
    )


_COL = """col AS (SELECT l_suppkey % 5 AS scene, l_linenumber * 30 AS r, CAST(round(l_discount * 100) AS INTEGER) AS g, CASE WHEN l_returnflag = 'R' THEN 255 ELSE 0 END AS b,
  l_quantity AS x, round(l_tax * 100) AS y, CAST(l_linenumber AS DOUBLE) AS z FROM lineitem),
 cnt AS (SELECT scene, r, g, b, count(*) AS n FROM col GROUP BY ALL), dom AS (SELECT *, n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY scene) AS pct FROM cnt QUALIFY n >= 0.005::DOUBLE * sum(n) OVER (PARTITION BY scene))"""


@query("agg_colors", f"WITH {_COL} SELECT scene, r, g, b, n, {q6('pct')} AS pct FROM dom")
def agg_colors(spark, root):
    return voxel.dominant_colours(_coloured(spark, root), ["scene"]).withColumn("pct", r6("pct"))


@query(
    "agg_color_scenes",
    f"WITH {_COL} SELECT r, g, b, count(*) AS scenes, CAST(sum(n) AS BIGINT) AS n, string_agg(CAST(scene AS VARCHAR), ',' ORDER BY scene) AS scene_list FROM dom GROUP BY 1, 2, 3",
)
def agg_color_scenes(spark, root):
    out = voxel.colour_scenes(voxel.dominant_colours(_coloured(spark, root), ["scene"]), "scene")
    return out.withColumn("scene_list", F.array_join("scene_list", ","))


@query(
    "agg_avg_color_voxel",
    f"""WITH {_COL}, m AS (SELECT *, min(x) OVER (PARTITION BY scene) AS mx, min(y) OVER (PARTITION BY scene) AS my, min(z) OVER (PARTITION BY scene) AS mz FROM col)
        SELECT scene, CAST(floor((x-mx)/2) AS BIGINT) AS vx, CAST(floor((y-my)/2) AS BIGINT) AS vy, CAST(floor((z-mz)/2) AS BIGINT) AS vz, count(*) AS n,
        {q6("avg(x)")} AS avg_x, {q6("avg(r)")} AS avg_r, {q6("avg(g)")} AS avg_g FROM m GROUP BY 1, 2, 3, 4""",
)
def agg_avg_color_voxel(spark, root):
    out = voxel.colour_average(_coloured(spark, root), 2.0, ["scene"])
    return out.select("scene", "vx", "vy", "vz", "n", *[r6(c).alias(c) for c in ("avg_x", "avg_r", "avg_g")])


@query("set_union_bins", f"WITH {VOX_SQL} SELECT key % 16 AS bin, count(*) AS voxels, CAST(sum(n) AS BIGINT) AS points FROM vox GROUP BY 1", "lat")
def set_union_bins(spark, root):
    from cloudloom.functions.grid import hash_bin

    return voxels(spark, root).groupBy(hash_bin(F.col("key")).alias("bin")).agg(F.count("*").alias("voxels"), F.sum("n").alias("points"))


@query(
    "agg_meter",
    f"SELECT event_type, {q6('sum(value * (event_id % 3)) / greatest(sum(event_id % 3), 1)')} AS mean, CAST(sum(event_id % 3) AS BIGINT) AS count FROM events GROUP BY 1",
)
def agg_meter(spark, root):
    from cloudloom.operators.metrics import weighted_mean

    ev = table(spark, root, "events").withColumn("w", F.col("event_id") % 3)
    return weighted_mean(ev, ["event_type"], "value", "w").select("event_type", r6("mean").alias("mean"), "count")
