"""Evaluator and tester metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.operators import metrics
from cloudloom.plans.registry import q6, query, r6
from cloudloom.sources.tables import predictions

CLASSES = 8

IUT_SQL = """iut AS (SELECT scene_id, batch_id, c.c AS class_id, count_if(truth = c.c AND pred = c.c) AS i, count_if(truth = c.c OR pred = c.c) AS u, count_if(truth = c.c) AS t,
  count_if(truth <> -1 AND (truth = c.c OR pred = c.c)) AS ui FROM pred, range(8) c(c) GROUP BY 1, 2, 3)"""


@query("met_iou_eval", f"WITH {IUT_SQL} SELECT scene_id, CAST(class_id AS INTEGER) AS class_id, CAST(sum(i) AS BIGINT) AS intersection, CAST(sum(u) AS BIGINT) AS union_n, CAST(sum(t) AS BIGINT) AS target FROM iut GROUP BY 1, 2", "pred")
def met_iou_eval(spark, root):
    return metrics.class_counts(metrics.confusion(predictions(spark, root), ["scene_id"]), ["scene_id"], CLASSES)


_SUM = """s AS (SELECT {k}, class_id, sum(i) AS i, sum(u) AS u, sum(t) AS t, sum(ui) AS ui FROM iut GROUP BY ALL)"""


@query("met_summary", f"WITH {IUT_SQL}, {_SUM.format(k='scene_id')} SELECT scene_id, {q6('avg(CASE WHEN u > 0 THEN i/u END)')} AS miou, {q6('avg(CASE WHEN t > 0 THEN i/t END)')} AS macc, {q6('sum(i)/sum(t)')} AS allacc FROM s GROUP BY 1", "pred")
def met_summary(spark, root):
    out = metrics.registry(CLASSES)["semantic"](predictions(spark, root), ["scene_id"])
    return out.select("scene_id", *[r6(c).alias(c) for c in ("miou", "macc", "allacc")])


@query(
    "met_iou_test",
    f"""WITH {IUT_SQL}, a AS (SELECT 0 AS pooled, scene_id, class_id, sum(i) AS i, sum(ui) AS u, sum(t) AS t FROM iut GROUP BY ALL UNION ALL SELECT 1, NULL, class_id, sum(i), sum(ui), sum(t) FROM iut GROUP BY ALL)
        SELECT pooled, scene_id, {q6('avg(CASE WHEN u > 0 THEN i/(u+1e-10) END)')} AS miou, {q6('avg(CASE WHEN t > 0 THEN i/(t+1e-10) END)')} AS macc, {q6('sum(i)/(sum(t)+1e-10)')} AS allacc FROM a GROUP BY 1, 2""",
    "pred",
)
def met_iou_test(spark, root):
    out = metrics.scene_and_pooled(predictions(spark, root), CLASSES)
    return out.select("pooled", "scene_id", *[r6(c).alias(c) for c in ("miou", "macc", "allacc")])


@query("met_val_batchmean", f"WITH {IUT_SQL}, {_SUM.format(k='batch_id')}, m AS (SELECT batch_id, avg(CASE WHEN u > 0 THEN i/u END) AS miou FROM s GROUP BY 1), p AS (SELECT class_id, sum(i) AS i, sum(u) AS u FROM s GROUP BY 1) SELECT {q6('(SELECT avg(miou) FROM m)')} AS mean_of_batches, {q6('(SELECT avg(CASE WHEN u > 0 THEN i/u END) FROM p)')} AS pooled", "pred")
def met_val_batchmean(spark, root):
    out = metrics.batch_mean(predictions(spark, root), CLASSES)
    return out.select(r6("mean_of_batches").alias("mean_of_batches"), r6("pooled").alias("pooled"))


@query("met_boundary", f"WITH nr AS (SELECT scene_id, avg(CASE WHEN support >= 0.2 THEN 1.0 ELSE 0.0 END) AS r FROM pred GROUP BY 1), b AS (SELECT scene_id, c.c AS class_id, count_if(truth = c.c AND pred = c.c) AS i, count_if(truth = c.c OR pred = c.c) AS u, count_if(truth = c.c) AS t FROM pred, range(8) c(c) WHERE support >= 0.2 GROUP BY 1, 2) SELECT scene_id, {q6('any_value(r)')} AS boundary_ratio, {q6('avg(CASE WHEN u > 0 THEN i/u END)')} AS miou, {q6('avg(CASE WHEN t > 0 THEN i/t END)')} AS macc FROM b JOIN nr USING (scene_id) GROUP BY 1", "pred")
def met_boundary(spark, root):
    out = metrics.boundary_metrics(predictions(spark, root), ["scene_id"], CLASSES, 0.2)
    return out.select("scene_id", *[r6(c).alias(c) for c in ("boundary_ratio", "miou", "macc")])


SUPPORT_SQL = """sp AS (SELECT *, 1/(1+exp(-support_logit)) AS p, support*valid AS tg FROM pred)"""


def _support(spark, root):
    return metrics.support_regression(predictions(spark, root), ["scene_id"])


@query("met_support_reg", f"WITH {SUPPORT_SQL} SELECT scene_id, {q6('sum(valid * CASE WHEN abs(p-tg) < 1 THEN 0.5*(p-tg)*(p-tg) ELSE abs(p-tg)-0.5 END)/sum(valid)')} AS support_reg_error, {q6('sum(valid*(p-tg)*(p-tg))/(sum(valid)+1e-6)')} AS support_error FROM sp GROUP BY 1", "pred")
def met_support_reg(spark, root):
    return _support(spark, root).select("scene_id", r6("support_reg_error").alias("support_reg_error"), r6("support_error").alias("support_error"))


@query("met_support_bce", f"WITH {SUPPORT_SQL} SELECT scene_id, {q6('sum(valid * -(tg*ln(p) + (1-tg)*ln(1-p)))/sum(valid)')} AS support_bce FROM sp GROUP BY 1", "pred")
def met_support_bce(spark, root):
    return _support(spark, root).select("scene_id", r6("support_bce").alias("support_bce"))


@query("met_tversky", f"WITH {SUPPORT_SQL} SELECT scene_id, {q6('sum(p*valid)/(sum(p*valid) + 0.3::DOUBLE*sum(p*(1-valid)) + 0.7::DOUBLE*sum((1-p)*valid) + 1e-6)')} AS support_cover FROM sp GROUP BY 1", "pred")
def met_tversky(spark, root):
    return _support(spark, root).select("scene_id", r6("support_cover").alias("support_cover"))


EDGE_SQL = """ed AS (SELECT *, sqrt(vx*vx+vy*vy+vz*vz) AS gt, (px*vx+py*vy+pz*vz)/(sqrt(px*px+py*py+pz*pz)*sqrt(vx*vx+vy*vy+vz*vz)) AS cos,
  CASE WHEN abs(vx) >= abs(vy) AND abs(vx) >= abs(vz) THEN vx > 0 WHEN abs(vy) >= abs(vz) THEN vy > 0 ELSE vz > 0 END AS side FROM pred WHERE valid > 0.5)"""


def _edge(spark, root):
    return metrics.edge_errors(predictions(spark, root), ["scene_id"])


@query("met_edge", f"WITH {EDGE_SQL} SELECT scene_id, {q6('avg(CASE WHEN gt > 0.001 THEN cos END)')} AS dir_cosine, {q6('avg(abs(dist_pred-gt))')} AS dist_error, {q6('avg(abs(dist_pred-gt)/0.08)')} AS dist_error_scaled FROM ed GROUP BY 1", "pred")
def met_edge(spark, root):
    return _edge(spark, root).select("scene_id", *[r6(c).alias(c) for c in ("dir_cosine", "dist_error", "dist_error_scaled")])


@query("met_axis_side", f"WITH {EDGE_SQL} SELECT scene_id, {q6('avg(CASE WHEN gt > 0.001 THEN abs(cos) END)')} AS axis_cosine, {q6('avg(CASE WHEN gt > 0.001 THEN CASE WHEN (side_logit > 0) = side THEN 1.0 ELSE 0.0 END END)')} AS side_accuracy FROM ed GROUP BY 1", "pred")
def met_axis_side(spark, root):
    return _edge(spark, root).select("scene_id", r6("axis_cosine").alias("axis_cosine"), r6("side_accuracy").alias("side_accuracy"))


def _near_sql(name, threshold):
    return f"""{name}n AS (SELECT scene_id, avg(CASE WHEN support >= {threshold} THEN 1.0 ELSE 0.0 END) AS boundary_ratio FROM pred GROUP BY 1),
 {name}c AS (SELECT scene_id, c.c AS class_id, count_if(truth = c.c AND pred = c.c) AS i, count_if(truth = c.c OR pred = c.c) AS u, count_if(truth = c.c) AS t FROM pred, range(8) c(c) WHERE support >= {threshold} GROUP BY 1, 2),
 {name} AS (SELECT scene_id, any_value(boundary_ratio) AS boundary_ratio, avg(CASE WHEN u > 0 THEN i/u END) AS boundary_miou, avg(CASE WHEN t > 0 THEN i/t END) AS boundary_macc FROM {name}c JOIN {name}n USING (scene_id) GROUP BY 1)"""


_SMOOTH = "CASE WHEN abs(p-{t}) < 1 THEN 0.5*(p-{t})*(p-{t}) ELSE abs(p-{t})-0.5 END"
_COVER = "sum(p*{b})/(sum(p*{b}) + 0.3::DOUBLE*sum(p*(1-{b})) + 0.7::DOUBLE*sum((1-p)*{b}) + 1e-6)"
_HOT = "(CASE WHEN support > 0.5 THEN 1.0::DOUBLE ELSE 0.0 END)"
REGISTRY_SQL = f"""{IUT_SQL}, {_SUM.format(k='scene_id')}, sem AS (SELECT scene_id, avg(CASE WHEN u > 0 THEN i/u END) AS miou, avg(CASE WHEN t > 0 THEN i/t END) AS macc, sum(i)/sum(t) AS allacc FROM s GROUP BY 1),
 {_near_sql('edge', 0.2)}, {_near_sql('mask', 0.5)}, {SUPPORT_SQL}, {EDGE_SQL},
 sup AS (SELECT scene_id, sum(valid * {_SMOOTH.format(t='tg')})/sum(valid) AS support_reg_error, sum(valid*(p-tg)*(p-tg))/(sum(valid)+1e-6) AS support_error,
   sum(valid * -(tg*ln(p) + (1-tg)*ln(1-p)))/sum(valid) AS support_bce, {_COVER.format(b='valid')} AS support_cover FROM sp GROUP BY 1),
 soft AS (SELECT scene_id, avg({_SMOOTH.format(t='support')}) AS support_reg_error, {_COVER.format(b=_HOT)} AS support_cover, avg({_HOT}) AS support_positive_ratio FROM sp GROUP BY 1),
 err AS (SELECT scene_id, avg(CASE WHEN gt > 0.001 THEN cos END) AS dir_cosine, avg(CASE WHEN gt > 0.001 THEN abs(cos) END) AS axis_cosine, avg(CASE WHEN gt > 0.001 THEN CASE WHEN (side_logit > 0) = side THEN 1.0 ELSE 0.0 END END) AS side_accuracy,
   avg(abs(dist_pred-gt)) AS dist_error, avg(abs(dist_pred-gt)/0.08) AS dist_error_scaled FROM ed GROUP BY 1),
 rat AS (SELECT scene_id, avg(valid) AS valid_ratio, avg(CASE WHEN support > 0.001 THEN 1.0 ELSE 0.0 END) AS support_positive_ratio,
   avg(CASE WHEN valid > 0.5 AND sqrt(vx*vx+vy*vy+vz*vz) > 0.001 THEN 1.0 ELSE 0.0 END) AS dir_valid_ratio FROM pred GROUP BY 1)"""


def _long_sql(name, columns, *tables):
    """One evaluator's metrics in long form; a name of the form a=b shows column b as a."""
    pairs = [c.split("=") if "=" in c else (c, c) for c in ("miou macc allacc " + columns).split()]
    joins = "".join(f" JOIN {t} USING (scene_id)" for t in tables)
    return f"SELECT scene_id, '{name}' AS evaluator, unnest([{', '.join(repr(a) for a, _ in pairs)}]) AS metric, unnest([{', '.join(q6(b) for _, b in pairs)}]) AS value FROM sem{joins}"


_NEAR, _SHARES = "boundary_ratio boundary_miou boundary_macc", "valid_ratio support_positive_ratio"
_EVALUATORS = [
    ("semantic", ""),
    ("semantic_boundary", f"support_cover support_error dir_cosine dist_error dist_error_scaled {_SHARES} dir_valid_ratio", "sup", "err", "rat"),
    ("axis_side", f"support_cover support_error axis_cosine side_accuracy dir_cosine {_SHARES} axis_valid_ratio=dir_valid_ratio", "sup", "err", "rat"),
    ("support_guided_focus", f"{_NEAR} support_bce support_cover {_SHARES}", "edge", "sup", "rat"),
    ("redesigned_support_focus", f"{_NEAR} support_reg_error support_cover {_SHARES}", "edge", "sup", "rat"),
    ("mask_support_focus", f"{_NEAR} support_reg_error support_cover support_positive_ratio", "mask", "soft"),
]


@query("met_registry", f"WITH {REGISTRY_SQL} " + " UNION ALL ".join(_long_sql(*e) for e in _EVALUATORS), "pred")
def met_registry(spark, root):
    """Every evaluator over the same predictions, long form."""
    out = None
    for name, fn in metrics.registry(CLASSES).items():
        m = fn(predictions(spark, root), ["scene_id"])
        cols = [c for c in m.columns if c != "scene_id"]
        rows = F.array(*[F.struct(F.lit(c).alias("metric"), r6(c).alias("value")) for c in cols])
        part = m.select("scene_id", F.lit(name).alias("evaluator"), F.inline(rows))
        out = part if out is None else out.unionByName(part)
    return out
