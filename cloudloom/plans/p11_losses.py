"""Loss reductions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.operators import losses
from cloudloom.plans.p03_joins import BASIN_NN, ORDINAL_SQL, PATCH_SQL
from cloudloom.plans.registry import q6, query, r6
from cloudloom.sources.tables import predictions

KEY = ["scene_id"]

LOSS_SQL = """ls0 AS (SELECT *, 1/(1+exp(-support_logit)) AS prob, sqrt(vx*vx+vy*vy+vz*vz) AS gt, CASE WHEN support > 0.5 THEN 1.0::DOUBLE ELSE 0.0 END AS hot, CASE WHEN support > 0.3 THEN 1.0::DOUBLE ELSE 0.0 END AS mask, support*valid AS sv,
   CASE WHEN truth <> -1 THEN 1.0::DOUBLE ELSE 0.0 END AS lab, (px*vx+py*vy+pz*vz)/(greatest(sqrt(px*px+py*py+pz*pz),1e-6)*greatest(sqrt(vx*vx+vy*vy+vz*vz),1e-6)) AS cos,
   CASE WHEN truth >= 0 THEN ln(list_sum([exp(v) FOR v IN logits])) - logits[truth + 1] ELSE 0 END AS ce,
   CASE WHEN abs(vx) >= abs(vy) AND abs(vx) >= abs(vz) THEN (vx > 0)::INT WHEN abs(vy) >= abs(vz) THEN (vy > 0)::INT ELSE (vz > 0)::INT END AS side FROM pred),
 ls AS (SELECT *, ln(1+exp(support_logit)) AS sp1, ln(1+exp(-support_logit)) AS sp0, ln(1+exp(side_logit)) AS sd1, ln(1+exp(-side_logit)) AS sd0 FROM ls0)"""


def _rows(spark, root):
    """Predictions with a continuous weight and, unlike the support rule, a mask of support > 0.3."""
    return predictions(spark, root).withColumns({"s_weight": F.col("support"), "boundary_mask": F.col("support") > 0.3})


def _terms(name, spark, root, cols, **options):
    out = losses.loss_terms(name, _rows(spark, root), KEY, **options)
    return out.select("scene_id", *[r6(c).alias(c) for c in cols])


def _sql(**terms):
    return f"WITH {LOSS_SQL} SELECT scene_id, " + ", ".join(f"{q6(t)} AS {n}" for n, t in terms.items()) + " FROM ls GROUP BY 1"


CE = "sum(ce)/sum(lab)"
DICE = "1 - (2*sum(prob*mask)+1)/(sum(prob)+sum(mask)+1)"
TVERSKY = "1 - (sum(prob*valid)+1e-6)/(sum(prob*valid) + 0.3::DOUBLE*sum(prob*(1-valid)) + 0.7::DOUBLE*sum((1-prob)*valid) + 1e-6)"
REG = "sum(valid * CASE WHEN abs(prob-sv) < 1 THEN 0.5*(prob-sv)*(prob-sv) ELSE abs(prob-sv)-0.5 END)/(sum(valid)+1e-6)"
BCE_MASK = "avg(mask*sp0 + (1-mask)*sp1)"


@query("ls_ce", _sql(loss_ce=CE), "pred")
def ls_ce(spark, root):
    return _terms("semantic_only", spark, root, ["loss_ce"])


LOVASZ_SQL = """{p}sm AS (SELECT scene_id, truth, point_id, unnest([exp(v) / list_sum([exp(w) FOR w IN logits]) FOR v IN logits]) AS p, unnest(range(8)) AS c FROM pred WHERE truth >= 0 {w}),
 {p}er AS (SELECT scene_id, c, point_id, CASE WHEN truth = c THEN 1 ELSE 0 END AS fg, abs(CASE WHEN truth = c THEN 1 ELSE 0 END - p) AS err FROM {p}sm),
 {p}rk AS (SELECT *, sum(fg) OVER (PARTITION BY scene_id, c) AS g, sum(fg) OVER w AS f, row_number() OVER w AS n FROM {p}er WINDOW w AS (PARTITION BY scene_id, c ORDER BY err DESC, point_id ROWS UNBOUNDED PRECEDING)),
 {p}pc AS (SELECT scene_id, c, sum(err * (1 - (g - f)/(g + n - f) - CASE WHEN n = 1 THEN 0 ELSE 1 - (g - f + fg)/(g + (n - 1) - (f - fg)) END)) AS loss FROM {p}rk WHERE g > 0 GROUP BY 1, 2)"""


@query("ls_lovasz", f"WITH {LOVASZ_SQL.format(p='', w='')} SELECT scene_id, {q6('avg(loss)')} AS lovasz FROM pc GROUP BY 1", "pred")
def ls_lovasz(spark, root):
    return losses.lovasz(predictions(spark, root), KEY, 8).withColumn("lovasz", r6("lovasz"))


@query("ls_weighted_mean", _sql(weighted_ce="CASE WHEN sum(sv) > 0 THEN sum(ce*sv)/(sum(sv)+1e-6) ELSE 0 END"), "pred")
def ls_weighted_mean(spark, root):
    rows = losses.prepare(predictions(spark, root))
    return rows.groupBy(*KEY).agg(r6(losses.weighted(F.col("ce0"), F.col("sv"))).alias("weighted_ce"))


@query("ls_tversky", _sql(loss_support_cover=TVERSKY, loss_support_reg=REG), "pred")
def ls_tversky(spark, root):
    return _terms("semantic_boundary", spark, root, ["loss_support_cover", "loss_support_reg"])


@query("ls_dice", _sql(loss_dice=DICE, local_dice="1 - (2*sum(CASE WHEN support > 0 THEN prob*hot ELSE 0 END)+1)/(sum(CASE WHEN support > 0 THEN prob+hot ELSE 0 END)+1)"), "pred")
def ls_dice(spark, root):
    whole = _terms("hard_mask", spark, root, ["loss_dice"])
    local = _terms("boundary_binary", spark, root, ["loss_dice"]).withColumnRenamed("loss_dice", "local_dice")
    return whole.join(local, KEY)


@query("ls_bce_logits", _sql(loss_bce=BCE_MASK, sampled="avg((1+9*support)*(3*hot*sp0 + (1-hot)*sp1))"), "pred")
def ls_bce_logits(spark, root):
    plain = _terms("hard_mask", spark, root, ["loss_bce"])
    sampled = _terms("boundary_binary", spark, root, ["loss_bce"], pos_weight=3.0).withColumnRenamed("loss_bce", "sampled")
    return plain.join(sampled, KEY)


@query("ls_pos_weight", f"WITH {LOSS_SQL}, w AS (SELECT scene_id, sqrt((1-avg(hot))/greatest(avg(hot), 1e-6)) AS pw FROM ls GROUP BY 1) SELECT scene_id, {q6('any_value(pw)')} AS pos_weight, {q6('avg(pw*support*sp0 + (1-support)*sp1)')} AS loss_aux FROM ls JOIN w USING (scene_id) GROUP BY 1", "pred")
def ls_pos_weight(spark, root):
    w = losses.positive_weight(losses.prepare(predictions(spark, root)), KEY).select("scene_id", r6("pos_weight").alias("pos_weight"))
    return w.join(_terms("soft_boundary", spark, root, ["loss_aux"]), KEY)


@query("ls_focal_mse", _sql(loss_aux="avg((1+9*support)*(prob-support)*(prob-support))"), "pred")
def ls_focal_mse(spark, root):
    return _terms("focal_mse_boundary", spark, root, ["loss_aux"])


@query("ls_ce_upweight", _sql(hard="avg(ce*(1+9*mask))", soft="sum(ce*(1+9*support)*lab)/sum(lab)", truncated="sum(ce*(1+9*hot*support)*lab)/sum(lab)", continuous="avg(ce*(1+9*support))"), "pred")
def ls_ce_upweight(spark, root):
    out = None
    for loss, name in (("hard_mask", "hard"), ("soft_weighted_semantic", "soft"), ("boundary_upweight", "truncated"), ("support_weighted", "continuous")):
        part = _terms(loss, spark, root, ["loss_ce"]).withColumnRenamed("loss_ce", name)
        out = part if out is None else out.join(part, KEY)
    return out


@query("ls_focus", _sql(loss_focus="sum(ce*(1+sv)*lab)/sum((1+sv)*lab)", loss_support="sum(valid*(sv*sp0 + (1-sv)*sp1))/sum(valid)"), "pred")
def ls_focus(spark, root):
    return _terms("support_guided_semantic_focus", spark, root, ["loss_focus", "loss_support"])


@query("ls_prox", _sql(weighted="avg((1+support)*(valid*sp0 + (1-valid)*sp1))", plain="avg(valid*sp0 + (1-valid)*sp1)", aux_prob_mean="avg(prob)"), "pred")
def ls_prox(spark, root):
    a = _terms("boundary_proximity_cue", spark, root, ["loss_aux", "aux_prob_mean"]).withColumnRenamed("loss_aux", "weighted")
    return a.join(_terms("unweighted_boundary_cue", spark, root, ["loss_aux"]).withColumnRenamed("loss_aux", "plain"), KEY)


_DIST = "CASE WHEN abs(dist_pred-gt)/0.08 < 1 THEN 0.5*((dist_pred-gt)/0.08)*((dist_pred-gt)/0.08) ELSE abs(dist_pred-gt)/0.08-0.5 END"


@query("ls_dir", _sql(loss_dir="avg(CASE WHEN valid > 0.5 AND gt > 0.001 THEN 1-cos END)", weighted_dir="sum((1-cos)*CASE WHEN gt > 0.001 THEN sv ELSE 0 END)/(sum(CASE WHEN gt > 0.001 THEN sv ELSE 0 END)+1e-6)"), "pred")
def ls_dir(spark, root):
    a = _terms("semantic_boundary", spark, root, ["loss_dir"])
    return a.join(_terms("semantic_boundary", spark, root, ["loss_dir"], weighted_edge=True).withColumnRenamed("loss_dir", "weighted_dir"), KEY)


@query("ls_dist", _sql(loss_dist=f"sum(valid*{_DIST})/(sum(valid)+1e-6)", weighted_dist=f"sum(sv*{_DIST})/(sum(sv)+1e-6)"), "pred")
def ls_dist(spark, root):
    a = _terms("semantic_boundary", spark, root, ["loss_dist"])
    return a.join(_terms("semantic_boundary", spark, root, ["loss_dist"], weighted_edge=True).withColumnRenamed("loss_dist", "weighted_dist"), KEY)


@query("ls_axis", _sql(loss_axis="sum(sv*(1-abs(cos)))/(sum(sv)+1e-6)"), "pred")
def ls_axis(spark, root):
    return _terms("axis_side", spark, root, ["loss_axis"])


@query("ls_side", _sql(loss_side="sum(sv*(side*sd0 + (1-side)*sd1))/(sum(sv)+1e-6)"), "pred")
def ls_side(spark, root):
    return _terms("axis_side", spark, root, ["loss_side"])


@query("ls_redesigned", _sql(loss_ce=CE, loss_support=f"({REG}) + 0.2::DOUBLE*({TVERSKY})"), "pred")
def ls_redesigned(spark, root):
    return _terms("redesigned_support_focus", spark, root, ["loss_ce", "loss_support"])


@query("ls_redesigned_focus", f"WITH {LOVASZ_SQL.format(p='', w='AND support > 0.1')} SELECT scene_id, {q6('avg(loss)')} AS loss_focus FROM pc GROUP BY 1", "pred")
def ls_redesigned_focus(spark, root):
    """Lovasz term restricted to the boundary region."""
    near = predictions(spark, root).where("support > 0.1")
    return losses.lovasz(near, KEY, 8).select("scene_id", r6("lovasz").alias("loss_focus"))


@query("ls_ordinal", f"WITH {ORDINAL_SQL} SELECT {q6('avg(loss)')} AS loss_ordinal, avg(pairs) AS avg_pairs FROM ord", "pred")
def ls_ordinal(spark, root):
    per_scene = losses.ordinal_pairs(predictions(spark, root))
    return per_scene.agg(r6(F.avg("loss")).alias("loss_ordinal"), F.avg("pairs").alias("avg_pairs"))


@query("ls_coherence", f"WITH {BASIN_NN}, b AS (SELECT scene_id, basin, 1 - avg(cos) AS t FROM nnb GROUP BY 1, 2) SELECT {q6('avg(t)')} AS loss_coherence, count(*) AS basins FROM b", "pred")
def ls_coherence(spark, root):
    out = losses.coherence(predictions(spark, root).withColumn("basin", F.col("point_id") % 7))
    return out.select(r6("loss_coherence").alias("loss_coherence"), "basins")


@query("ls_local", f"WITH {PATCH_SQL} SELECT scene_id, {q6('avg(1 - cos)')} AS loss_local FROM pp GROUP BY 1", "pred")
def ls_local(spark, root):
    return losses.local_consistency(predictions(spark, root), KEY).select("scene_id", r6("loss_local").alias("loss_local"))


@query("ls_marg", _sql(loss_marg_bce="sum(lab*(mask*sp0 + (1-mask)*sp1))/sum(lab)", loss_marg_dice="1 - (2*sum(lab*prob*mask)+1)/(sum(lab*prob)+sum(lab*mask)+1)"), "pred")
def ls_marg(spark, root):
    return _terms("cr_sd", spark, root, ["loss_marg_bce", "loss_marg_dice"])


@query(
    "ls_dual",
    f"WITH {LOSS_SQL}, e AS (SELECT *, CASE WHEN truth >= 0 THEN ln(list_sum([exp(v/2) FOR v IN logits])) - logits[truth + 1]/2 ELSE 0 END AS ce1 FROM ls) SELECT scene_id, {q6('avg(ce*(1+9*mask))')} AS loss_ce, {q6('avg(ce1*(1+9*mask))')} AS loss_ce_v1, {q6('avg(ce*(1+9*mask)) + avg(ce1*(1+9*mask))')} AS loss_ce_total FROM e GROUP BY 1",
    "pred",
)
def ls_dual(spark, root):
    late = _rows(spark, root)
    early = late.withColumn("logits", F.transform("logits", lambda v: v / 2))
    out = losses.dual("dual_hard_mask", late, early, KEY)
    return out.select("scene_id", *[r6(c).alias(c) for c in ("loss_ce", "loss_ce_v1", "loss_ce_total")])


@query("ls_monitor", _sql(prob_pos_mean="sum(prob*mask)/sum(mask)", prob_neg_mean="sum(prob*(1-mask))/sum(1-mask)", boundary_ce_frac="sum(ce*mask)/sum(ce)", transition_ce_frac="sum(CASE WHEN support > 0 AND support <= 0.5 THEN ce ELSE 0 END)/sum(ce)", mean_weight="avg(1+9*support)"), "pred")
def ls_monitor(spark, root):
    a = _terms("hard_mask", spark, root, ["prob_pos_mean", "prob_neg_mean", "boundary_ce_frac"])
    return a.join(_terms("soft_weighted_semantic", spark, root, ["transition_ce_frac", "mean_weight"]), KEY)


@query("ls_gate", "SELECT scene_id, (round(avg(support), 6) + 0.0::DOUBLE) AS mean_weight FROM pred GROUP BY 1", "pred")
def ls_gate(spark, root):
    rows = predictions(spark, root).withColumn("boundary_mask", F.lit(1.0))
    return rows.groupBy(*KEY).agg(r6(F.avg(losses.gate(rows))).alias("mean_weight"))


# -- totals: one query per loss type ---------------------------------------------------

_LOV, _NEAR = LOVASZ_SQL.format(p="", w=""), LOVASZ_SQL.format(p="n", w="AND support > 0.1")
_MASKED = f"{BCE_MASK} + {DICE}"
_BINARY = "0.3::DOUBLE*(avg((1+9*support)*(hot*sp0 + (1-hot)*sp1)) + 1 - (2*sum(CASE WHEN support > 0 THEN prob*hot ELSE 0 END)+1)/(sum(CASE WHEN support > 0 THEN prob+hot ELSE 0 END)+1))"
_TRUNCATED = "sum(ce*(1+9*hot*support)*lab)/sum(lab)"
_EDGE = f"{REG} + 0.25::DOUBLE*({TVERSKY})"
_DIRECTED = f"{_EDGE} + avg(CASE WHEN valid > 0.5 AND gt > 0.001 THEN 1-cos END) + sum(valid*{_DIST})/(sum(valid)+1e-6)"
_FOCAL = "0.3::DOUBLE*avg((1+9*support)*(prob-support)*(prob-support))"
_SOFT = "0.3::DOUBLE*(sqrt((1-avg(hot))/greatest(avg(hot), 1e-6))*avg(support*sp0) + avg((1-support)*sp1))"

# name: point-wise terms without Lovasz, then a table of one further term per scene
_TOTAL_SQL = {
    "semantic_only": (CE, None),
    "semantic_boundary": (f"{CE} + {_DIRECTED}", None),
    "boundary_weighted_semantic": (_TRUNCATED, None),
    "support_shape": (f"{CE} + {REG} + 0.2::DOUBLE*({TVERSKY})", (ORDINAL_SQL, "SELECT scene_id, 0.5*loss AS more FROM ord")),
    "route_a": (f"{CE} + {_DIRECTED}", (BASIN_NN + ", bt AS (SELECT scene_id, basin, 1 - avg(cos) AS t FROM nnb GROUP BY 1, 2)", "SELECT scene_id, 0.1*avg(t) AS more FROM bt GROUP BY 1")),
    "axis_side": (f"{CE} + {_EDGE} + sum(sv*(1-abs(cos)))/(sum(sv)+1e-6) + sum(sv*(side*sd0 + (1-side)*sd1))/(sum(sv)+1e-6)", None),
    "redesigned_support_focus": (f"{CE} + {REG} + 0.2::DOUBLE*({TVERSKY})", (_NEAR, "SELECT scene_id, 0.5*avg(loss) AS more FROM npc GROUP BY 1")),
    "hard_mask": (f"avg(ce*(1+9*mask)) + {_MASKED}", None),
    "support_weighted": (f"avg(ce*(1+9*support)) + {_MASKED}", None),
    "boundary_binary": (f"{_TRUNCATED} + {_BINARY}", None),
    "soft_boundary": (f"{CE} + {_SOFT}", None),
    "focal_mse_boundary": (f"{CE} + {_FOCAL}", None),
    "boundary_upweight": (f"{_TRUNCATED} + {_FOCAL}", None),
    "soft_weighted_semantic": ("sum(ce*(1+9*support)*lab)/sum(lab)", None),
    "support_guided_semantic_focus": (f"{CE} + sum(valid*(sv*sp0 + (1-sv)*sp1))/sum(valid) + sum(ce*(1+sv)*lab)/sum((1+sv)*lab)", None),
    "boundary_proximity_cue": (f"{CE} + 0.3::DOUBLE*avg((1+support)*(valid*sp0 + (1-valid)*sp1))", None),
    "unweighted_boundary_cue": (f"{CE} + 0.3::DOUBLE*avg(valid*sp0 + (1-valid)*sp1)", None),
    "serial_derivation": (f"{CE} + {_SOFT} + avg(CASE WHEN valid > 0.5 THEN 1-cos END)", (PATCH_SQL, "SELECT scene_id, 0.5*avg(1 - cos) AS more FROM pp GROUP BY 1")),
    "cr_sd": ("avg(ce*(1+4*support)) + sum(lab*(mask*sp0 + (1-mask)*sp1))/sum(lab) + 1 - (2*sum(lab*prob*mask)+1)/(sum(lab*prob)+sum(lab*mask)+1)", None),
    "dual_hard_mask": (f"avg(ce*(1+9*mask)) + {_MASKED}", None),
    "dual_boundary_binary": (f"{_TRUNCATED} + {_BINARY}", None),
    "dual_support_weighted": (f"avg(ce*(1+9*support)) + {_MASKED}", None),
}


def _dual_sql(name):
    """Both stages, the early one with its own logits."""
    terms, _ = _TOTAL_SQL[name]
    early = LOSS_SQL.replace("ls0", "els0").replace(" ls AS", " els AS").replace("FROM pred", "FROM pe")
    lovasz = LOVASZ_SQL.format(p="e", w="").replace("FROM pred", "FROM pe")
    stage = "(SELECT scene_id, avg(loss) AS lov FROM {p}pc GROUP BY 1), {p}tm AS (SELECT scene_id, {terms} AS v FROM {p}ls GROUP BY 1)"
    return (
        f"WITH {LOSS_SQL}, {_LOV}, pe AS (SELECT * REPLACE ([v / 2 FOR v IN logits] AS logits) FROM pred), {early}, {lovasz},"
        f" lv AS {stage.format(p='', terms=terms)}, elv AS {stage.format(p='e', terms=terms)}"
        f" SELECT tm.scene_id, {q6('tm.v + coalesce(lv.lov, 0) + etm.v + coalesce(elv.lov, 0)', 5)} AS loss FROM tm JOIN etm USING (scene_id) LEFT JOIN lv USING (scene_id) LEFT JOIN elv USING (scene_id)"
    )


def _total_sql(name):
    if name.startswith("dual_"):
        return _dual_sql(name)
    terms, more = _TOTAL_SQL[name]
    tables, extra = more or ("none AS (SELECT 1)", "SELECT scene_id, 0.0::DOUBLE AS more FROM pred GROUP BY 1")
    return (
        f"WITH {LOSS_SQL}, {_LOV}, {tables}, lv AS (SELECT scene_id, avg(loss) AS lov FROM pc GROUP BY 1), tm AS (SELECT scene_id, {terms} AS v FROM ls GROUP BY 1), xt AS ({extra})"
        f" SELECT tm.scene_id, {q6('v + coalesce(lov, 0) + coalesce(more, 0)', 5)} AS loss FROM tm LEFT JOIN lv ON lv.scene_id = tm.scene_id LEFT JOIN xt ON xt.scene_id = tm.scene_id"
    )


def _total(name):
    def run(spark, root):
        rows = _rows(spark, root).withColumn("basin", F.col("point_id") % 7)
        early = rows.withColumn("logits", F.transform("logits", lambda v: v / 2))
        out = losses.dual(name, rows, early, KEY) if name.startswith("dual_") else losses.total_loss(name, rows, KEY)
        return out.select("scene_id", r6("loss", 5).alias("loss"))

    return run


for _name in losses.LOSSES:
    query(f"ls_total_{_name}", _total_sql(_name), "pred")(_total(_name))
