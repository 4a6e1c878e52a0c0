"""Segmentation, support and edge metrics as aggregations over a predictions table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.functions import geometry as g
from cloudloom.functions.weights import argmax, sigmoid, smooth_l1, softmax


def weighted_mean(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Running-mean meter as one aggregation; an empty meter reads 0."""
    total = F.sum(F.col(value) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1))
    return df.groupBy(*keys).agg(total.alias("mean"), F.sum(weight).alias("count"))


def confusion(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts per (truth, pred): the cloud shrinks to at most (K+1)^2 rows per key, map-side."""
    return df.groupBy(*keys, "truth", "pred").agg(F.count("*").alias("n"))


def class_counts(conf: DataFrame, keys: Sequence[str], classes: int, ignore: int | None = None) -> DataFrame:
    """Intersection, union and target per class, zero-filled.

    With ``ignore=None`` rows of any truth value add to the union of their
    predicted class (evaluator); with ``ignore`` set they are dropped (tester).
    """
    rows = conf if ignore is None else conf.where(F.col("truth") != ignore)
    aggs = []
    for c in range(classes):
        t, p = F.col("truth") == c, F.col("pred") == c
        for name, cond in (("i", t & p), ("u", t | p), ("t", t)):
            aggs.append(F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias(f"{name}{c}"))
    wide = rows.groupBy(*keys).agg(*aggs)
    packed = F.array(*[F.struct(F.col(f"i{c}").alias("i"), F.col(f"u{c}").alias("u"), F.col(f"t{c}").alias("t")) for c in range(classes)])
    out = wide.select(*keys, F.posexplode(packed).alias("class_id", "_c"))
    return out.select(*keys, "class_id", F.col("_c.i").alias("intersection"), F.col("_c.u").alias("union_n"), F.col("_c.t").alias("target"))


def _ratio(num: Column, den: Column, eps: float) -> Column:
    return F.when(den > 0, num / (den + F.lit(eps)))


def summary(counts: DataFrame, keys: Sequence[str], eps: float = 0.0) -> DataFrame:
    """mIoU over classes with a union, mAcc over classes with targets, overall accuracy."""
    iou = _ratio(F.col("intersection"), F.col("union_n"), eps)
    acc = _ratio(F.col("intersection"), F.col("target"), eps)
    total = F.sum("target")
    overall = F.when(total > 0, F.sum("intersection") / (total + F.lit(eps))).otherwise(0.0)
    return counts.groupBy(*keys).agg(
        F.coalesce(F.avg(iou), F.lit(0.0)).alias("miou"), F.coalesce(F.avg(acc), F.lit(0.0)).alias("macc"), overall.alias("allacc")
    )


def scene_and_pooled(df: DataFrame, classes: int, ignore: int = -1) -> DataFrame:
    """Tester metrics per scene (pooled = 0) and over all scenes (pooled = 1)."""
    conf = confusion(df, ["scene_id"])
    pooled = conf.groupBy("truth", "pred").agg(F.sum("n").alias("n")).withColumn("scene_id", F.lit(None).cast("bigint"))
    both = conf.withColumn("pooled", F.lit(0)).unionByName(pooled.withColumn("pooled", F.lit(1)))
    return summary(class_counts(both, ["pooled", "scene_id"], classes, ignore), ["pooled", "scene_id"], eps=1e-10)


def batch_mean(df: DataFrame, classes: int) -> DataFrame:
    """Unweighted mean of per-batch mIoU next to the pooled mIoU; the two differ."""
    counts = class_counts(confusion(df, ["batch_id"]), ["batch_id"], classes)
    mean = summary(counts, ["batch_id"]).agg(F.avg("miou").alias("mean_of_batches"))
    pooled_counts = counts.groupBy("class_id").agg(*[F.sum(c).alias(c) for c in ("intersection", "union_n", "target")])
    pooled = summary(pooled_counts, []).select(F.col("miou").alias("pooled"))
    both = mean.select("mean_of_batches", F.lit(None).cast("double").alias("pooled")).unionByName(
        pooled.select(F.lit(None).cast("double").alias("mean_of_batches"), "pooled")
    )
    return both.agg(F.max("mean_of_batches").alias("mean_of_batches"), F.max("pooled").alias("pooled"))


def boundary_metrics(df: DataFrame, keys: Sequence[str], classes: int, threshold: float, support: str = "support") -> DataFrame:
    """Metrics over points whose support reaches ``threshold``, and their share."""
    near = F.col(support) >= F.lit(threshold)
    conf = df.groupBy(*keys, near.alias("_near"), "truth", "pred").agg(F.count("*").alias("n"))
    share = conf.groupBy(*keys).agg((F.sum(F.when(F.col("_near"), F.col("n")).otherwise(0)) / F.sum("n")).alias("boundary_ratio"))
    inside = summary(class_counts(conf.where("_near"), keys, classes), keys).drop("allacc")
    return share.join(inside, list(keys), "left").fillna(0.0, ["miou", "macc"])


def support_regression(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Valid-weighted SmoothL1, probability BCE, squared error and Tversky overlap of the support head."""
    prob, v = sigmoid(F.col("support_logit")), F.col("valid")
    target = F.col("support") * v
    rows = df.select(*keys, prob.alias("p"), v.alias("v"), target.alias("t"), F.when(v > 0.5, 1.0).otherwise(0.0).alias("b"))
    p, t, b = F.col("p"), F.col("t"), F.col("b")
    bce = -(t * F.greatest(F.log(p), F.lit(-100.0)) + (1.0 - t) * F.greatest(F.log1p(-p), F.lit(-100.0)))
    s = rows.groupBy(*keys).agg(
        F.sum("v").alias("v"), F.sum(smooth_l1(p - t) * F.col("v")).alias("sl"), F.sum(bce * F.col("v")).alias("bce"),
        F.sum((p - t) * (p - t) * F.col("v")).alias("sq"), F.sum(p * b).alias("tp"), F.sum(p * (1.0 - b)).alias("fp"),
        F.sum((1.0 - p) * b).alias("fn"), F.sum("b").alias("nb"),
    )
    v = F.greatest("v", F.lit(1e-6))
    return s.select(
        *keys, (F.col("sl") / v).alias("support_reg_error"), (F.col("bce") / v).alias("support_bce"),
        F.when(F.col("v") > 0, F.col("sq") / (F.col("v") + 1e-6)).otherwise(0.0).alias("support_error"),
        F.when(F.col("nb") > 0, F.col("tp") / (F.col("tp") + 0.3 * F.col("fp") + 0.7 * F.col("fn") + 1e-6)).otherwise(0.0).alias("support_cover"),
    )


def edge_errors(df: DataFrame, keys: Sequence[str], tau: float = 1e-3, scale: float = 0.08) -> DataFrame:
    """Direction cosine, its sign-free form, side accuracy and distance errors over valid points."""
    gt = g.norm(g.vec("v"))
    d = df.select("*", gt.alias("_gt"))
    pu, vu = g.unit_floor(g.vec("p"), 1e-6), g.unit_floor(g.vec("v"), 1e-6)
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), g.dot(pu, vu)))
    side_hit = F.when((sigmoid(F.col("side_logit")) > 0.5).cast("int") == g.side_of(g.vec("v")), 1.0).otherwise(0.0)
    rows = d.where("valid > 0.5").select(
        *keys, (F.col("_gt") > tau).alias("m"), cos.alias("cos"), side_hit.alias("side"), F.abs(F.col("dist_pred") - F.col("_gt")).alias("err")
    )

    def mean(c):
        return F.coalesce(F.avg(c), F.lit(0.0))

    return rows.groupBy(*keys).agg(
        mean(F.when(F.col("m"), F.col("cos"))).alias("dir_cosine"), mean(F.when(F.col("m"), F.abs("cos"))).alias("axis_cosine"),
        mean(F.when(F.col("m"), F.col("side"))).alias("side_accuracy"), mean(F.col("err")).alias("dist_error"),
        mean(F.col("err") / F.lit(scale)).alias("dist_error_scaled"),
    )


def fragment_vote(fragments: DataFrame, keys: Sequence[str], classes: int) -> DataFrame:
    """Adds up the class probabilities of all fragments of a point and takes the best class."""
    probs = fragments.select(*keys, softmax(F.col("logits")).alias("p"))
    summed = probs.groupBy(*keys).agg(*[F.sum(F.col("p")[c]).alias(f"s{c}") for c in range(classes)])
    votes = F.array(*[F.col(f"s{c}") for c in range(classes)])
    return summed.select(*keys, argmax(votes).alias("pred"), F.array_max(votes).alias("prob"))


def ratios(df: DataFrame, keys: Sequence[str], tau: float = 1e-3) -> DataFrame:
    """Shares of valid points, of points with support, and of valid points with a direction."""
    pointed = (F.col("valid") > 0.5) & (g.norm(g.vec("v")) > tau)
    one = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return df.groupBy(*keys).agg(F.avg("valid").alias("valid_ratio"), one(F.col("support") > tau).alias("support_positive_ratio"), one(pointed).alias("pointed_ratio"))


def mask_support(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Support head against a soft target of all points: SmoothL1, Tversky overlap of target > 0.5, and that share."""
    p, t = sigmoid(F.col("support_logit")), F.least(F.greatest(F.col("support"), F.lit(0.0)), F.lit(1.0))
    rows = df.select(*keys, p.alias("p"), t.alias("t"), F.when(t > 0.5, 1.0).otherwise(0.0).alias("b"))
    p, b = F.col("p"), F.col("b")
    s = rows.groupBy(*keys).agg(
        F.avg(smooth_l1(p - F.col("t"))).alias("support_reg_error"), F.avg("b").alias("support_positive_ratio"),
        F.sum(p * b).alias("tp"), F.sum(p * (1.0 - b)).alias("fp"), F.sum((1.0 - p) * b).alias("fn"), F.sum("b").alias("nb"),
    )
    cover = F.when(F.col("nb") > 0, F.col("tp") / (F.col("tp") + 0.3 * F.col("fp") + 0.7 * F.col("fn") + 1e-6)).otherwise(0.0)
    return s.select(*keys, "support_reg_error", cover.alias("support_cover"), "support_positive_ratio")


def registry(classes: int) -> dict[str, Callable[[DataFrame, Sequence[str]], DataFrame]]:
    """Evaluator name -> metrics of a predictions table, per key. Each evaluator has columns of its own."""
    def semantic(df, keys):
        return summary(class_counts(confusion(df, keys), keys, classes), keys)

    def region(threshold):
        return lambda df, keys: boundary_metrics(df, keys, classes, threshold).withColumnsRenamed({"miou": "boundary_miou", "macc": "boundary_macc"})

    def joined(columns: str, *parts):
        def run(df, keys):
            out = semantic(df, keys)
            for part in parts:
                out = out.join(part(df, keys), list(keys))
            return out.select(*keys, "miou", "macc", "allacc", *columns.split())

        return run

    def named(name):
        return lambda df, keys: ratios(df, keys).withColumnRenamed("pointed_ratio", name)

    near = "boundary_ratio boundary_miou boundary_macc"
    shares = "valid_ratio support_positive_ratio"
    return {
        "semantic": semantic,
        "semantic_boundary": joined(f"support_cover support_error dir_cosine dist_error dist_error_scaled {shares} dir_valid_ratio", support_regression, edge_errors, named("dir_valid_ratio")),
        "axis_side": joined(f"support_cover support_error axis_cosine side_accuracy dir_cosine {shares} axis_valid_ratio", support_regression, edge_errors, named("axis_valid_ratio")),
        "support_guided_focus": joined(f"{near} support_bce support_cover {shares}", region(0.2), support_regression, ratios),
        "redesigned_support_focus": joined(f"{near} support_reg_error support_cover {shares}", region(0.2), support_regression, ratios),
        "mask_support_focus": joined(f"{near} support_reg_error support_cover support_positive_ratio", region(0.5), mask_support),
    }
