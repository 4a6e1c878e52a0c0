"""Training-log analytics: log lines -> epoch table, per-class table, best epoch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns, metric names and class names of the log format.
NUMBER = r"([\d.]+)"
KEY_VALUE = r"(\w+)=([\d.]+)"
VAL_SUMMARY = r"Val result: mIoU/mAcc/allAcc (\d+\.\d+)/(\d+\.\d+)/(\d+\.\d+)"
PER_CLASS = r"(\w+) Result: iou/accuracy ([\d.]+)/([\d.]+)"
VAL_BATCH = r"Val/Test: \[(\d+)/(\d+)\]"
BATCH_METRICS = (
    "val_boundary_mIoU", "val_boundary_mAcc", "boundary_point_ratio", "support_bce", "support_reg_error", "support_cover", "valid_ratio",
)
TRAIN_METRICS = {
    "redesigned": ("loss", "loss_semantic", "loss_support", "loss_support_reg", "loss_support_cover", "loss_focus"),
    "focus": ("loss", "loss_semantic", "loss_support", "loss_focus"),
    "support_only": (
        "loss", "loss_semantic", "loss_edge", "loss_support", "loss_support_reg", "loss_support_cover", "loss_dir", "loss_dist",
    ),
}
CLASS_NAMES = ("balustrade", "balcony", "advboard", "wall", "eave", "column", "window", "clutter")


def key_values(line: Column) -> Column:
    """``name=number`` pairs of a line as a map; the last value of a name wins."""
    keys, values = F.regexp_extract_all(line, F.lit(KEY_VALUE), 1), F.regexp_extract_all(line, F.lit(KEY_VALUE), 2)
    pairs = F.reverse(F.arrays_zip(keys.alias("k"), values.alias("v")))
    first = F.aggregate(
        pairs, F.expr("cast(map() as map<string,string>)"),
        lambda m, p: F.when(F.map_contains_key(m, p["k"]), m).otherwise(F.map_concat(m, F.create_map(p["k"], p["v"]))),
    )
    return first


def run_type(lines: DataFrame, keys: Sequence[str] = ("log",)) -> DataFrame:
    """Kind of run, from the first telling ``Train result`` line."""
    v = F.col("value")
    kind = F.when(v.contains("loss_support_reg=") & v.contains("loss_focus="), "redesigned").when(v.contains("loss_focus="), "focus").when(
        v.contains("loss_edge="), "support_only"
    )
    head = lines.where(v.contains("Train result:")).withColumn("run_type", kind).where("run_type IS NOT NULL")
    return head.groupBy(*keys).agg(F.min_by("run_type", "line_no").alias("run_type"))


def numbered(lines: DataFrame, keys: Sequence[str] = ("log",)) -> DataFrame:
    """Adds ``epoch``: how many ``Val result`` lines a log has up to and including the line.

    Only the few Val lines of a log are ordered; the other lines look their
    epoch up in blocks of 4096 line numbers, so no log is sorted as a whole.
    """
    keys = list(keys)
    size = 4096
    block = F.floor(F.col("line_no") / size)
    rows = lines.withColumn("_b", block).withColumn("_val", F.regexp_extract("value", VAL_SUMMARY, 1) != "")
    per_block = rows.groupBy(*keys, "_b").agg(F.count_if("_val").alias("_k"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per_block = per_block.select(*keys, "_b", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_b").orderBy("line_no")
    out = rows.withColumn("_in", F.sum(F.col("_val").cast("int")).over(inside)).join(per_block, [*keys, "_b"])
    return out.withColumn("epoch", (F.col("_before") + F.col("_in")).cast("int")).drop("_b", "_in", "_before")


def epoch_table(lines: DataFrame, kind: str, keys: Sequence[str] = ("log",)) -> DataFrame:
    """One row per ``Val result``.

    The last batch line since the previous Val line gives the boundary metrics
    (not for support_only runs); the last ``Train result`` before the next Val
    line fills the train columns.
    """
    keys = list(keys)
    n = numbered(lines, keys)
    v = F.col("value")
    is_batch = v.contains("Val/Test:") if kind != "support_only" else F.lit(False)
    tagged = n.withColumn("_batch", is_batch & (F.regexp_extract(v, VAL_BATCH, 1) != "")).withColumn(
        "_train", ~F.col("_val") & v.contains("Train result:") & ~is_batch
    )
    vals = tagged.where("_val").select(*keys, "epoch", *[F.regexp_extract(v, VAL_SUMMARY, i + 1).alias(c) for i, c in enumerate(("val_mIoU", "val_mAcc", "val_allAcc"))])
    train = tagged.where(F.col("_train") & (F.col("epoch") > 0)).groupBy(*keys, "epoch").agg(F.max_by("value", "line_no").alias("_l"))
    kv = train.withColumn("_m", key_values(F.col("_l")))
    train = kv.select(*keys, "epoch", *[F.coalesce(F.try_element_at("_m", F.lit(m)), F.lit("")).alias(f"train_{m}") for m in TRAIN_METRICS[kind]])
    out = vals.join(train, [*keys, "epoch"], "left")
    if kind == "support_only":
        return out
    batch = tagged.where("_batch").groupBy(*keys, (F.col("epoch") + 1).alias("epoch")).agg(F.max_by("value", "line_no").alias("_l"))
    found = [F.regexp_extract("_l", f"{m}: {NUMBER}", 1) for m in BATCH_METRICS]
    batch = batch.select(*keys, "epoch", *[F.when(c != "", c).alias(m) for m, c in zip(BATCH_METRICS, found)])
    return out.join(batch, [*keys, "epoch"], "left")


def class_table(lines: DataFrame, keys: Sequence[str] = ("log",)) -> DataFrame:
    """IoU per class and epoch, for epochs that report every class."""
    keys = list(keys)
    n = numbered(lines, keys).where(~F.col("_val"))
    name = F.regexp_extract("value", PER_CLASS, 1)
    rows = n.where(name.isin(list(CLASS_NAMES))).select(*keys, "epoch", "line_no", name.alias("name"), F.regexp_extract("value", PER_CLASS, 2).alias("iou"))
    wide = rows.groupBy(*keys, "epoch").agg(
        *[F.max_by(F.when(F.col("name") == c, F.col("iou")), F.when(F.col("name") == c, F.col("line_no"))).alias(c) for c in CLASS_NAMES],
        F.count_distinct("name").alias("_k"),
    )
    return wide.where(F.col("_k") == len(CLASS_NAMES)).drop("_k")


def best_epoch(epochs: DataFrame, keys: Sequence[str] = ("log",)) -> DataFrame:
    """Epoch with the greatest mIoU, the first one on a tie; 0 when nothing beats zero."""
    m = F.col("val_mIoU").cast("double")
    pick = F.when(m > 0, F.struct(m.alias("m"), (-F.col("epoch")).alias("e")))
    best = epochs.groupBy(*keys).agg(F.max(pick).alias("_b"), F.count("*").alias("epochs"))
    return best.select(*keys, F.coalesce(-F.col("_b.e"), F.lit(0)).alias("best_epoch"), F.coalesce(F.col("_b.m"), F.lit(0.0)).alias("best_miou"), "epochs")
