"""Neighbourhood aggregates, density diagnostics and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.operators import boundary, density
from cloudloom.operators.stats import median, pairwise_extent, quantiles, radius_pick, summarise
from cloudloom.plans.derived import SIZE, cluster_members
from cloudloom.plans.p03_joins import D2, OTHER_SQL, knn_sql
from cloudloom.plans.registry import q6, query, r6
from cloudloom.sources.tables import predictions, scan_points, table

SCENE = ["scene_id"]

# class 9 plays the ignored label
CROSS_SQL = f"""{knn_sql(32)}, kl AS (SELECT *, CASE WHEN nbr_segment = 9 THEN NULL ELSE nbr_segment END AS nl FROM knn),
 kc AS (SELECT point_id, any_value(segment) AS segment, count(nl) AS n_valid, count(CASE WHEN nl <> segment THEN 1 END) AS n_diff FROM kl GROUP BY 1),
 km AS (SELECT point_id, arg_max(nl, (n, -nl)) AS paired FROM (SELECT point_id, nl, count(*) AS n FROM kl WHERE nl <> segment GROUP BY 1, 2) GROUP BY 1),
 cand AS (SELECT point_id, segment, n_diff / n_valid AS cross_ratio, least(segment, paired) AS label_a, greatest(segment, paired) AS label_b
   FROM kc JOIN km USING (point_id) WHERE segment <> 9 AND n_diff / n_valid >= 0.15)"""


def moments(spark, root, normals=False, k=32):
    return boundary.label_moments(scan_points(spark, root), k, SCENE, ignore=9, normals=normals)


@query("agg_cross_ratio", f"WITH {CROSS_SQL} SELECT point_id, label_a, label_b, {q6('cross_ratio')} AS cross_ratio FROM cand", "pts")
def agg_cross_ratio(spark, root):
    c = boundary.candidates(moments(spark, root), 0.15, ignore=9)
    return c.select("point_id", "label_a", "label_b", r6("cross_ratio").alias("cross_ratio"))


@query("agg_knn_edge", f"WITH {CROSS_SQL} SELECT point_id, segment <> 9 AND n_diff / greatest(n_valid, 1) >= 0.15 AS knn_edge FROM kc", "pts")
def agg_knn_edge(spark, root):
    return boundary.knn_edge(moments(spark, root), 0.15, ignore=9).select("point_id", "knn_edge")


CENTER_SQL = f"""{CROSS_SQL}, loc AS (SELECT c.point_id, c.label_a, c.label_b, c.cross_ratio, k.nbr_segment AS l, k.bx AS x, k.by_ AS y, k.bz AS z, k.bnx AS nx, k.bny AS ny, k.bnz AS nz FROM cand c JOIN knn k USING (point_id)
   UNION ALL SELECT c.point_id, c.label_a, c.label_b, c.cross_ratio, p.segment, p.x, p.y, p.z, p.nx, p.ny, p.nz FROM cand c JOIN pts p USING (point_id)),
 side AS (SELECT point_id, label_a, label_b, any_value(cross_ratio) AS cross_ratio, count_if(l = label_a) AS na, count_if(l = label_b) AS nb,
   avg(CASE WHEN l = label_a THEN x END) AS ax, avg(CASE WHEN l = label_a THEN y END) AS ay, avg(CASE WHEN l = label_a THEN z END) AS az,
   avg(CASE WHEN l = label_b THEN x END) AS bx, avg(CASE WHEN l = label_b THEN y END) AS by_, avg(CASE WHEN l = label_b THEN z END) AS bz,
   avg(CASE WHEN l IN (label_a, label_b) THEN nx END) AS mx, avg(CASE WHEN l IN (label_a, label_b) THEN ny END) AS my, avg(CASE WHEN l IN (label_a, label_b) THEN nz END) AS mz
   FROM loc GROUP BY 1, 2, 3),
 cent AS (SELECT *, sqrt((bx-ax)*(bx-ax) + (by_-ay)*(by_-ay) + (bz-az)*(bz-az)) AS sep FROM side WHERE na >= 4 AND nb >= 4)"""


@query(
    "agg_boundary_center",
    f"""WITH {CENTER_SQL} SELECT point_id, label_a, label_b, {q6('0.5*(ax+bx)')} AS cx, {q6('0.5*(ay+by_)')} AS cy, {q6('0.5*(az+bz)')} AS cz,
        {q6('(bx-ax)/sep', 5)} AS nx, {q6('(by_-ay)/sep', 5)} AS ny, {q6('sep')} AS separation, {q6('1 - abs(na-nb)/(na+nb)')} AS balance FROM cent WHERE sep >= 1e-8""",
    "pts",
)
def agg_boundary_center(spark, root):
    c = boundary.boundary_centers(boundary.candidates(moments(spark, root), 0.15, ignore=9), SCENE, tangents=False)
    return c.select(
        "point_id", "label_a", "label_b", *[r6(f"c{a}").alias(f"c{a}") for a in "xyz"], r6("nx", 5).alias("nx"), r6("ny", 5).alias("ny"),
        r6("separation").alias("separation"), r6("balance").alias("balance"),
    )


@query("agg_knn_density", f"WITH {knn_sql(10)} SELECT scene_id, point_id, {q6('avg(dist)')} AS density FROM knn GROUP BY 1, 2", "pts")
def agg_knn_density(spark, root):
    return density.knn_density(scan_points(spark, root), SCENE, 10).select("scene_id", "point_id", r6("density").alias("density"))


@query("agg_spacing", f"WITH {knn_sql(6)} SELECT scene_id, {q6('median(dist)')} AS spacing FROM knn GROUP BY 1", "pts")
def agg_spacing(spark, root):
    return density.spacing(scan_points(spark, root), SCENE, 6).select("scene_id", r6("spacing").alias("spacing"))


@query("agg_spacing_global", f"WITH {knn_sql(1)} SELECT {q6('median(dist)')} AS spacing FROM knn", "pts")
def agg_spacing_global(spark, root):
    from cloudloom.operators.neighbors import k_nearest

    pts = scan_points(spark, root)
    near = k_nearest(pts, pts, 1, by=SCENE, exclude_self=True)
    return median(near, [], "distance", "spacing").select(r6("spacing").alias("spacing"))


BUCKET_SQL = f"""{knn_sql(10)}, den AS (SELECT scene_id, point_id, avg(dist) AS density FROM knn GROUP BY 1, 2),
 cuts AS (SELECT scene_id, quantile_cont(density, 0.25) AS p25, quantile_cont(density, 0.75) AS p75 FROM den GROUP BY 1),
 bk AS (SELECT d.*, CASE WHEN density >= p75 THEN 'sparse' WHEN density <= p25 THEN 'dense' ELSE 'mid' END AS bucket FROM den d JOIN cuts USING (scene_id))"""


def buckets(spark, root):
    return density.bucketed(density.knn_density(scan_points(spark, root), SCENE, 10), SCENE)


@query("fn_density_bucket", f"WITH {BUCKET_SQL} SELECT scene_id, point_id, bucket FROM bk", "pts")
def fn_density_bucket(spark, root):
    return buckets(spark, root).select("scene_id", "point_id", "bucket")


@query("agg_quantiles", f"SELECT event_type, {q6('quantile_cont(value, 0.25)')} AS p25, {q6('quantile_cont(value, 0.5)')} AS p50, {q6('quantile_cont(value, 0.9)')} AS p90, {q6('quantile_cont(value, 0.99)')} AS p99 FROM events GROUP BY 1")
def agg_quantiles(spark, root):
    q = quantiles(table(spark, root, "events"), ["event_type"], "value", [0.25, 0.5, 0.9, 0.99])
    return q.select("event_type", *[r6(f"q{i}").alias(n) for i, n in enumerate(("p25", "p50", "p90", "p99"))])


_SHARE = f"{OTHER_SQL}, share AS (SELECT r.r AS radius, scene_id, avg(CASE WHEN other_dist <= r.r THEN 100.0 ELSE 0.0 END) AS pct FROM oth, (VALUES (0.03::DOUBLE), (0.04), (0.05), (0.06)) r(r) GROUP BY 1, 2)"
RADII = (0.03, 0.04, 0.05, 0.06)


def _shares(spark, root):
    near = boundary.nearest_other_class(scan_points(spark, root), SCENE)
    hit = [F.avg(F.when(F.col("other_dist") <= r, 100.0).otherwise(0.0)) for r in RADII]
    wide = near.groupBy("scene_id").agg(*[c.alias(f"r{i}") for i, c in enumerate(hit)])
    rows = F.array(*[F.struct(F.lit(r).alias("radius"), F.col(f"r{i}").alias("pct")) for i, r in enumerate(RADII)])
    return wide.select("scene_id", F.inline(rows))


@query("agg_summary", f"WITH {_SHARE} SELECT radius, {q6('min(pct)')} AS lo, {q6('avg(pct)')} AS mean, {q6('median(pct)')} AS med, {q6('max(pct)')} AS hi, {q6('stddev_pop(pct)')} AS std, {q6('avg(CASE WHEN pct BETWEEN 5 AND 15 THEN 1.0 ELSE 0.0 END)')} AS in_window FROM share GROUP BY 1", "pts")
def agg_summary(spark, root):
    s = summarise(_shares(spark, root), ["radius"], "pct", 5.0, 15.0)
    return s.select("radius", *[r6(c).alias(c) for c in ("lo", "mean", "med", "hi", "std", "in_window")])


@query(
    "agg_radius_pick",
    f"WITH {_SHARE}, s AS (SELECT radius, avg(pct) AS mean, avg(CASE WHEN pct BETWEEN 5 AND 95 THEN 1.0 ELSE 0.0 END) AS w FROM share GROUP BY 1) SELECT arg_min(radius, (round(abs(mean - 10), 9), radius)) AS radius FROM s WHERE w >= 0.6",
    "pts",
)
def agg_radius_pick(spark, root):
    return radius_pick(summarise(_shares(spark, root), ["radius"], "pct", 5.0, 95.0))


SURV_SQL = f"""{BUCKET_SQL}, mem AS (SELECT scene_id, point_id, point_id // {SIZE} AS cluster_id FROM pts WHERE segment < 6),
 sz AS (SELECT scene_id, cluster_id, count(*) AS size FROM mem GROUP BY 1, 2), ms AS (SELECT m.scene_id, m.point_id, size FROM mem m JOIN sz USING (scene_id, cluster_id)),
 sv0 AS (SELECT b.scene_id, b.bucket, count(*) AS total, count(size) AS survived, avg(size) AS mean_size FROM bk b LEFT JOIN ms USING (scene_id, point_id) GROUP BY 1, 2),
 sv AS (SELECT s.scene_id, t.b AS bucket, coalesce(total, 0) AS total, coalesce(survived, 0) AS survived, coalesce(mean_size, 0) AS mean_size FROM (SELECT DISTINCT scene_id FROM pts) s CROSS JOIN (VALUES ('dense'), ('mid'), ('sparse')) t(b) LEFT JOIN sv0 ON sv0.scene_id = s.scene_id AND sv0.bucket = t.b)"""


def _survival(spark, root):
    members = scan_points(spark, root).where("segment < 6").select("scene_id", "point_id", F.floor(F.col("point_id") / SIZE).alias("cluster_id"))
    return density.survival(buckets(spark, root), members, SCENE)


@query("agg_survival", f"WITH {SURV_SQL} SELECT scene_id, bucket, total, survived, total - survived AS noise, {q6('survived / greatest(total, 1)')} AS rate, {q6('mean_size')} AS mean_size FROM sv", "pts")
def agg_survival(spark, root):
    return _survival(spark, root).select("scene_id", "bucket", "total", "survived", "noise", r6("rate").alias("rate"), r6("mean_size").alias("mean_size"))


YIELD_SQL = f"""{BUCKET_SQL}, yl AS (SELECT b.scene_id, bucket, count(*) AS total, avg(CASE WHEN valid > 0.5 THEN 1.0 ELSE 0.0 END) AS valid_rate, coalesce(avg(CASE WHEN valid > 0.5 THEN support END), 0) AS mean_weight,
  avg(CASE WHEN valid > 0.5 AND support >= 0.5 THEN 1.0 ELSE 0.0 END) AS high_rate FROM bk b JOIN pred p ON b.point_id = p.point_id GROUP BY 1, 2)"""


def _yield(spark, root):
    return density.edge_yield(buckets(spark, root), predictions(spark, root).select("scene_id", "point_id", "valid", "support"), SCENE)


@query("agg_yield", f"WITH {YIELD_SQL} SELECT scene_id, bucket, total, {q6('valid_rate')} AS valid_rate, {q6('mean_weight')} AS mean_weight, {q6('high_rate')} AS high_rate FROM yl", "pts pred")
def agg_yield(spark, root):
    return _yield(spark, root).select("scene_id", "bucket", "total", *[r6(c).alias(c) for c in ("valid_rate", "mean_weight", "high_rate")])


@query("agg_gap", f"WITH {YIELD_SQL} SELECT scene_id, {q6('''max(CASE WHEN bucket = 'dense' THEN valid_rate END) - max(CASE WHEN bucket = 'sparse' THEN valid_rate END)''')} AS valid_rate_gap, {q6('''max(CASE WHEN bucket = 'dense' THEN mean_weight END) - max(CASE WHEN bucket = 'sparse' THEN mean_weight END)''')} AS mean_weight_gap FROM yl GROUP BY 1", "pts pred")
def agg_gap(spark, root):
    gap = density.dense_sparse_gap(_yield(spark, root), SCENE, ["valid_rate", "mean_weight"])
    return gap.select("scene_id", r6("valid_rate_gap").alias("valid_rate_gap"), r6("mean_weight_gap").alias("mean_weight_gap"))


_AGREE = """m AS (SELECT *, point_id % 3 = 0 AS knn_edge FROM pred), a AS (SELECT t.t AS threshold, {g} count_if(support > t.t) AS proxy, count_if(knn_edge) AS mask, count_if(knn_edge AND support > t.t) AS bt FROM m, (VALUES {v}) t(t) GROUP BY ALL)"""


@query(
    "agg_agreement",
    f"""WITH {_AGREE.format(g='', v='(0.1::DOUBLE), (0.3), (0.5)')} SELECT threshold, CAST(proxy AS BIGINT) AS proxy, CAST(mask AS BIGINT) AS mask, CAST(bt AS BIGINT) AS both_n, {q6('bt / greatest(mask + proxy - bt, 1)')} AS iou,
        {q6('bt / greatest(proxy, 1)')} AS recall_proxy, {q6('bt / greatest(mask, 1)')} AS recall_mask FROM a""",
    "pred",
)
def agg_agreement(spark, root):
    out = density.agreement(predictions(spark, root).withColumn("knn_edge", F.col("point_id") % 3 == 0), (0.1, 0.3, 0.5))
    return out.select("threshold", "proxy", "mask", F.col("both").alias("both_n"), *[r6(c).alias(c) for c in ("iou", "recall_proxy", "recall_mask")])


@query("agg_agreement_class", f"WITH {_AGREE.format(g='truth,', v='(0.5::DOUBLE)')} SELECT truth, CAST(proxy AS BIGINT) AS proxy, CAST(mask AS BIGINT) AS mask, {q6('bt / greatest(mask + proxy - bt, 1)')} AS iou FROM a WHERE truth >= 0", "pred")
def agg_agreement_class(spark, root):
    rows = predictions(spark, root).where("truth >= 0").withColumn("knn_edge", F.col("point_id") % 3 == 0)
    return density.agreement(rows, (0.5,), by=["truth"]).select("truth", "proxy", "mask", r6("iou").alias("iou"))


@query("agg_cluster_record", f"SELECT point_id // {SIZE} AS cluster_id, count(*) AS size, {q6('avg(x)')} AS cx, {q6('avg(y)')} AS cy, {q6('avg(z)')} AS cz, {q6('avg(abs(nx))')} AS confidence FROM pts GROUP BY 1", "pts")
def agg_cluster_record(spark, root):
    from cloudloom.operators.clustering import cluster_records

    rec = cluster_records(cluster_members(spark, root).withColumn("confidence", F.abs("tx")), ["cluster_id"])
    return rec.select("cluster_id", "size", *[r6(f"c{a}").alias(f"c{a}") for a in "xyz"], r6("confidence").alias("confidence"))


@query("agg_pairwise_max", f"WITH a AS (SELECT point_id // {SIZE} AS cluster_id, * FROM pts) SELECT a.cluster_id, {q6(f'max(sqrt({D2}))')} AS extent, {q6(f'count(DISTINCT a.point_id) / max(sqrt({D2}))')} AS density FROM a JOIN a b ON a.cluster_id = b.cluster_id GROUP BY 1", "pts")
def agg_pairwise_max(spark, root):
    out = pairwise_extent(cluster_members(spark, root), ["cluster_id"])
    return out.select("cluster_id", r6("extent").alias("extent"), r6(F.col("n") / F.col("extent")).alias("density"))


@query("agg_mc", f"SELECT user_id % 5 AS run_group, {q6('avg(CASE WHEN value > 5 THEN value END)')} AS mean, {q6('stddev_pop(CASE WHEN value > 5 THEN value END)')} AS std FROM events GROUP BY 1")
def agg_mc(spark, root):
    from cloudloom.operators.stats import over_runs

    runs = table(spark, root, "events").select((F.col("user_id") % 5).alias("run_group"), F.when(F.col("value") > 5, F.col("value")).otherwise(F.lit(float("nan"))).alias("v"))
    return over_runs(runs, ["run_group"], "v").select("run_group", r6("mean").alias("mean"), r6("std").alias("std"))
