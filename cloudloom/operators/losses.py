"""Loss values as aggregations over a predictions table.

``prepare`` derives the per-point terms once; every loss is then a set of
sums, so a batch of any size is one partially aggregated pass.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cloudloom.functions import geometry as g
from cloudloom.functions.weights import cross_entropy, sigmoid, smooth_l1, softmax, softplus
from cloudloom.operators.neighbors import k_nearest
from cloudloom.operators.prefix import totals_above
from cloudloom.session import cut

TAU = 1e-3
DIST_SCALE = 0.08


def prepare(df: DataFrame) -> DataFrame:
    """Per-point terms: ce, prob, target support, distances, direction and side errors.

    ``mask`` is the given ``boundary_mask``, else support above 0.5; ``weight`` is
    the given ``s_weight``, else the mask.
    """
    gt = g.norm(g.vec("v"))
    pu, vu = g.unit_floor(g.vec("p"), 1e-6), g.unit_floor(g.vec("v"), 1e-6)
    out = df.withColumns({
        "ce": cross_entropy(F.col("logits"), F.col("truth")),
        "prob": sigmoid(F.col("support_logit")),
        "dist_gt": gt,
        "cos": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), g.dot(pu, vu))),
        "side_gt": g.side_of(g.vec("v")).cast("double"),
        "hot": F.when(F.col("support") > 0.5, 1.0).otherwise(0.0),
        "mask": F.col("boundary_mask").cast("double") if "boundary_mask" in df.columns else F.when(F.col("support") > 0.5, 1.0).otherwise(0.0),
        "region": F.when(F.col("valid") > 0.5, 1.0).otherwise(0.0),
        "is_labelled": F.when(F.col("truth") != -1, 1.0).otherwise(0.0),
    })
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("s_weight"))) if "s_weight" in df.columns else F.col("mask")
    return out.withColumns({"weight": weight, "sv": F.col("support") * F.col("valid"), "ce0": F.coalesce("ce", F.lit(0.0))})


def bce_logits(logit: Column, target: Column, pos_weight: Column | float = 1.0) -> Column:
    w = pos_weight if isinstance(pos_weight, Column) else F.lit(float(pos_weight))
    return w * target * softplus(-logit) + (1.0 - target) * softplus(logit)


def weighted(value: Column, weight: Column, eps: float = 1e-6) -> Column:
    return F.when(F.sum(weight) > 0, F.sum(value * weight) / (F.sum(weight) + F.lit(eps))).otherwise(0.0)


def masked(value: Column, mask: Column) -> Column:
    return F.coalesce(F.avg(F.when(mask, value)), F.lit(0.0))


def tversky(prob: Column, target: Column, alpha: float = 0.3, beta: float = 0.7, eps: float = 1e-6) -> Column:
    tp, fp, fn = F.sum(prob * target), F.sum(prob * (1.0 - target)), F.sum((1.0 - prob) * target)
    return 1.0 - (tp + F.lit(eps)) / (tp + alpha * fp + beta * fn + F.lit(eps))


def dice(prob: Column, target: Column, smooth: float = 1.0) -> Column:
    return 1.0 - (2.0 * F.sum(prob * target) + smooth) / (F.sum(prob) + F.sum(target) + smooth)


def ce_mean() -> Column:
    return F.coalesce(F.avg("ce"), F.lit(0.0))


def ce_over_labelled(weight: Column) -> Column:
    """Weighted CE divided by the number of labelled points."""
    return F.sum(F.col("ce0") * weight * F.col("is_labelled")) / F.greatest(F.sum("is_labelled"), F.lit(1.0))


def ce_over_all(weight: Column) -> Column:
    """Weighted CE divided by the number of all points, ignored ones adding zero."""
    return F.avg(F.col("ce0") * weight)


def frac_of_ce(part: Column) -> Column:
    return F.sum(F.col("ce0") * part) / F.greatest(F.sum("ce0"), F.lit(1e-6))


def positive_weight(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """sqrt(negative share / positive share) of support > 0.5, per key."""
    pos = F.avg("hot")
    return df.groupBy(*keys).agg(F.sqrt((1.0 - pos) / F.greatest(pos, F.lit(1e-6))).alias("pos_weight"))


def lovasz(df: DataFrame, keys: Sequence[str], classes: int) -> DataFrame:
    """Lovasz softmax (Berman et al. 2018), mean over the classes present in the truth.

    Equal errors contribute the same whatever their order, so points are first
    merged by (class, error) and the Jaccard steps are read off running totals.
    """
    labelled = df.where("truth >= 0")
    probs = labelled.select(*keys, "truth", F.posexplode(softmax(F.col("logits"))).alias("c", "p")).where(F.col("c") < classes)
    fg = F.when(F.col("truth") == F.col("c"), 1).otherwise(0)
    err = probs.select(*keys, "c", fg.alias("fg"), F.abs(fg - F.col("p")).alias("err"))
    merged = err.groupBy(*keys, "c", "err").agg(F.sum("fg").alias("fg"), F.count("*").alias("n"))
    total = merged.groupBy(*keys, "c").agg(F.sum("fg").alias("gts")).where("gts > 0")
    run = totals_above(merged, [*keys, "c"], "err", ["fg", "n"]).join(total, [*keys, "c"])

    def jaccard(f: Column, n: Column) -> Column:
        """1 - intersection / union after the n largest errors, f of them foreground."""
        return 1.0 - (F.col("gts") - f) / (F.col("gts") + (n - f))

    after = jaccard(F.col("fg_above") + F.col("fg"), F.col("n_above") + F.col("n"))
    before = F.when(F.col("n_above") == 0, F.lit(0.0)).otherwise(jaccard(F.col("fg_above"), F.col("n_above")))
    per_class = run.groupBy(*keys, "c").agg(F.sum(F.col("err") * (after - before)).alias("loss"))
    return per_class.groupBy(*keys).agg(F.avg("loss").alias("lovasz"))


# -- loss registry: name -> {column: aggregate} over prepared rows ----------------

def _support(reg: float = 1.0, cover: float = 0.25) -> dict[str, Column]:
    out = {
        "loss_support_reg": weighted(smooth_l1(F.col("prob") - F.col("sv")), F.col("valid")),
        "loss_support_cover": tversky(F.col("prob"), F.col("region")),
    }
    out["loss_support"] = reg * out["loss_support_reg"] + cover * out["loss_support_cover"]
    return out


def _focal_mse(alpha: float = 9.0) -> Column:
    d = F.col("prob") - F.col("support")
    return F.avg((1.0 + alpha * F.col("support")) * d * d)


def _monitor(target: Column, part: str = "hot") -> dict[str, Column]:
    neg = 1.0 - target
    return {
        "prob_pos_mean": F.sum(F.col("prob") * target) / F.greatest(F.sum(target), F.lit(1e-6)),
        "prob_neg_mean": F.sum(F.col("prob") * neg) / F.greatest(F.sum(neg), F.lit(1e-6)),
        "boundary_ce_frac": frac_of_ce(F.col(part)),
    }


def _semantic_boundary(weighted_edge: bool = False) -> dict[str, Column]:
    near = (F.col("valid") > 0.5) & (F.col("dist_gt") > TAU)
    dist = smooth_l1((F.col("dist_pred") - F.col("dist_gt")) / DIST_SCALE)
    direction = 1.0 - F.col("cos")
    if weighted_edge:
        loss_dir = weighted(direction, F.col("sv") * F.when(F.col("dist_gt") > TAU, 1.0).otherwise(0.0))
        loss_dist = weighted(dist, F.col("sv"))
    else:
        loss_dir, loss_dist = masked(direction, near), weighted(dist, F.col("valid"))
    return {"loss_ce": ce_mean(), **_support(), "loss_dir": loss_dir, "loss_dist": loss_dist}


def _axis_side() -> dict[str, Column]:
    return {
        "loss_ce": ce_mean(), **_support(),
        "loss_axis": weighted(1.0 - F.abs("cos"), F.col("sv")),
        "loss_side": weighted(bce_logits(F.col("side_logit"), F.col("side_gt")), F.col("sv")),
    }


def _masked_ce(weight: str, ce_weight: float = 10.0, dice_weight: float = 1.0) -> dict[str, Column]:
    t = F.col("mask")
    out = {
        "loss_ce": ce_over_all(1.0 + F.col(weight) * (ce_weight - 1.0)),
        "loss_bce": F.avg(bce_logits(F.col("support_logit"), t)),
        "loss_dice": dice(F.col("prob"), t),
    }
    out["loss_aux"] = out["loss_bce"] + dice_weight * out["loss_dice"]
    return {**out, **_monitor(t, "mask")}


def _boundary_binary(ce_weight: float = 10.0, pos_weight: float = 1.0, sample_scale: float = 9.0) -> dict[str, Column]:
    t = F.col("hot")
    near = F.when(F.col("support") > 0, 1.0).otherwise(0.0)
    return {
        "loss_ce": ce_over_labelled(1.0 + t * F.col("support") * (ce_weight - 1.0)),
        "loss_bce": F.avg((1.0 + F.col("support") * sample_scale) * bce_logits(F.col("support_logit"), t, pos_weight)),
        "loss_dice": dice(F.col("prob") * near, t * near), **_monitor(t),
    }


def _truncated(ce_weight: float = 10.0) -> dict[str, Column]:
    return {"loss_ce": ce_over_labelled(1.0 + F.col("hot") * F.col("support") * (ce_weight - 1.0))}


def _upweight(ce_weight: float = 10.0) -> dict[str, Column]:
    return {**_truncated(ce_weight), "loss_aux": _focal_mse()}


def _soft_weighted(ce_weight: float = 10.0) -> dict[str, Column]:
    w = 1.0 + F.col("support") * (ce_weight - 1.0)
    mid = F.when((F.col("support") > 0) & (F.col("support") <= 0.5), 1.0).otherwise(0.0)
    return {"loss_ce": ce_over_labelled(w), "boundary_ce_frac": frac_of_ce(F.col("hot")), "transition_ce_frac": frac_of_ce(mid), "mean_weight": F.avg(w)}


def _focus(lam: float = 1.0, gamma: float = 1.0) -> dict[str, Column]:
    w = (1.0 + lam * F.pow(F.col("sv"), F.lit(gamma))) * F.col("is_labelled")
    v = F.greatest(F.sum("valid"), F.lit(1e-6))
    return {
        "loss_ce": ce_mean(), "loss_support": F.sum(bce_logits(F.col("support_logit"), F.col("sv")) * F.col("valid")) / v,
        "loss_focus": F.sum(F.col("ce0") * w) / F.greatest(F.sum(w), F.lit(1e-6)),
    }


def _proximity(weighted_by_support: bool = True) -> dict[str, Column]:
    w = 1.0 + F.col("support") if weighted_by_support else F.lit(1.0)
    v = F.greatest(F.sum("valid"), F.lit(1e-6))
    return {
        "loss_ce": ce_mean(), "loss_aux": F.avg(w * bce_logits(F.col("support_logit"), F.col("valid"))),
        "aux_prob_mean": F.avg("prob"), "aux_prob_boundary_mean": F.sum(F.col("prob") * F.col("valid")) / v,
    }


def _marginal(ce_weight: float = 5.0) -> dict[str, Column]:
    lab, t = F.col("is_labelled"), F.col("mask")
    return {
        "loss_ce": ce_over_all(1.0 + F.col("weight") * (ce_weight - 1.0)),
        "loss_marg_bce": F.avg(F.when(lab > 0, bce_logits(F.col("support_logit"), t))),
        "loss_marg_dice": dice(F.col("prob") * lab, t * lab),
    }


LOSSES: dict[str, Callable[..., dict[str, Column]]] = {
    "semantic_only": lambda: {"loss_ce": ce_mean()},
    "semantic_boundary": _semantic_boundary,
    "boundary_weighted_semantic": _truncated,
    "support_shape": lambda: {"loss_ce": ce_mean(), **_support(1.0, 0.2)},
    "route_a": _semantic_boundary,
    "axis_side": _axis_side,
    "redesigned_support_focus": lambda: {"loss_ce": ce_mean(), **_support(1.0, 0.2)},
    "hard_mask": lambda: _masked_ce("mask"),
    "support_weighted": lambda: _masked_ce("weight"),
    "boundary_binary": _boundary_binary,
    "soft_boundary": lambda: {"loss_ce": ce_mean(), "loss_aux": F.avg(bce_logits(F.col("support_logit"), F.col("support"), F.col("pos_weight")))},
    "focal_mse_boundary": lambda: {"loss_ce": ce_mean(), "loss_aux": _focal_mse()},
    "boundary_upweight": _upweight,
    "soft_weighted_semantic": _soft_weighted,
    "support_guided_semantic_focus": _focus,
    "boundary_proximity_cue": _proximity,
    "unweighted_boundary_cue": lambda: _proximity(False),
    "serial_derivation": lambda: {
        "loss_ce": ce_mean(), "loss_aux": F.avg(bce_logits(F.col("support_logit"), F.col("support"), F.col("pos_weight"))),
        "loss_direction": masked(1.0 - F.col("cos"), F.col("valid") > 0.5),
    },
    "cr_sd": _marginal,
    "dual_hard_mask": lambda: _masked_ce("mask"),
    "dual_boundary_binary": _boundary_binary,
    "dual_support_weighted": lambda: _masked_ce("weight"),
}

_SUPPORT = {"loss_support": 1.0}
_AUX = {"loss_aux": 0.3}
_MASK = {"loss_bce": 1.0, "loss_dice": 1.0}
_EDGE = {**_SUPPORT, "loss_dir": 1.0, "loss_dist": 1.0}

# The weight of each term in the total; CE and Lovasz always count once
TOTALS: dict[str, dict[str, float]] = {
    "semantic_only": {},
    "semantic_boundary": _EDGE,
    "boundary_weighted_semantic": {},
    "support_shape": {**_SUPPORT, "loss_ordinal": 0.5},
    "route_a": {**_EDGE, "loss_coherence": 0.1},
    "axis_side": {**_SUPPORT, "loss_axis": 1.0, "loss_side": 1.0},
    "redesigned_support_focus": {**_SUPPORT, "loss_focus_lovasz": 0.5},
    "hard_mask": _MASK,
    "support_weighted": _MASK,
    "boundary_binary": {"loss_bce": 0.3, "loss_dice": 0.3},
    "soft_boundary": _AUX,
    "focal_mse_boundary": _AUX,
    "boundary_upweight": _AUX,
    "soft_weighted_semantic": {},
    "support_guided_semantic_focus": {**_SUPPORT, "loss_focus": 1.0},
    "boundary_proximity_cue": _AUX,
    "unweighted_boundary_cue": _AUX,
    "serial_derivation": {**_AUX, "loss_direction": 1.0, "loss_local": 0.5},
    "cr_sd": {"loss_marg_bce": 1.0, "loss_marg_dice": 1.0},
    "dual_hard_mask": _MASK,
    "dual_boundary_binary": {"loss_bce": 0.3, "loss_dice": 0.3},
    "dual_support_weighted": _MASK,
}


def loss_terms(name: str, df: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    """All point-wise terms of one loss type per key."""
    rows = prepare(df)
    if name in ("soft_boundary", "serial_derivation"):
        rows = rows.join(positive_weight(rows, keys), list(keys))
    return rows.groupBy(*keys).agg(*[c.alias(n) for n, c in LOSSES[name](**options).items()])


def total_loss(name: str, df: DataFrame, keys: Sequence[str], classes: int = 8) -> DataFrame:
    """All terms of one loss type per key, ``lovasz``, its pair terms, and their weighted sum ``loss``.

    A term without any pair counts zero.  ``support_shape`` and
    ``route_a`` need ``scene_id`` among the keys, and ``route_a`` a ``basin`` column.
    """
    keys, shares = list(keys), TOTALS[name]
    out = loss_terms(name, df, keys).join(lovasz(df, keys, classes), keys, "left")
    extra = None
    if "loss_focus_lovasz" in shares:
        extra = lovasz(df.where("support > 0.1"), keys, classes).withColumnRenamed("lovasz", "loss_focus_lovasz")
    elif "loss_ordinal" in shares:
        extra = ordinal_pairs(df).groupBy(*keys).agg(F.avg("loss").alias("loss_ordinal"))
    elif "loss_coherence" in shares:
        extra = coherence(df, keys).select(*keys, "loss_coherence")
    elif "loss_local" in shares:
        extra = local_consistency(df, keys)
    if extra is not None:
        out = out.join(extra, keys, "left")
    parts = {"loss_ce": 1.0, "lovasz": 1.0, **shares}
    return out.withColumn("loss", sum((F.coalesce(c, F.lit(0.0)) * w for c, w in parts.items()), F.lit(0.0)))


def dual(name: str, df: DataFrame, early: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both supervision stages side by side, the early one suffixed ``_v1``, with the CE total and ``loss``."""
    late, first = total_loss(name, df, keys), total_loss(name, early, keys)
    first = first.withColumnsRenamed({c: f"{c}_v1" for c in first.columns if c not in keys})
    out = late.join(first, list(keys)).withColumn("loss_ce_total", F.col("loss_ce") + F.col("loss_ce_v1"))
    return out.withColumnRenamed("loss", "loss_v2").withColumn("loss", F.col("loss_v2") + F.col("loss_v1"))


def gate(df: DataFrame) -> str:
    """Which column supplies the weight: s_weight, then support of the edge, then the mask."""
    for name in ("s_weight", "support", "boundary_mask"):
        if name in df.columns:
            return name
    raise ValueError("a weight needs s_weight, support or boundary_mask")


# -- pair terms --------------------------------------------------------------------

#: Points of one block of a cell; two blocks meet in one batch of arithmetic.
BLOCK_POINTS = 1024
_HALF = [(dx, dy, dz) for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1) if (dx, dy, dz) >= (0, 0, 0)]


def ordinal_pairs(df: DataFrame, radius: float = 0.15, min_gap: float = 0.02, margin: float = 0.05) -> DataFrame:
    """Margin ranking of support over close pairs, per scene: (scene_id, pairs, loss).

    Every pair of narrow-band points closer than ``radius`` whose distances to the edge differ by more than ``min_gap``
    takes part; training draws points and pairs from these at random.  Scenes with fewer than four narrow-band points
    have none.  Points are packed in blocks of about ``BLOCK_POINTS`` of a cell of edge ``radius``; each two blocks of
    neighbouring cells meet once and give a count and a sum, so a crowded cell is many tasks' work and no pair is
    written out.  The work is the number of close pairs, which the definition asks for.
    """
    h = float(radius)
    dist = g.norm(g.vec("v"))
    band = df.where("valid > 0.5 AND support > 0.1").select("scene_id", "point_id", "x", "y", "z", sigmoid(F.col("support_logit")).alias("prob"), dist.alias("dist"))
    cell = [F.floor(F.col(a) / F.lit(h)).alias(f"c{a}") for a in "xyz"]
    key = ["scene_id", "cx", "cy", "cz"]
    placed = cut(band.select("*", *cell))
    enough = placed.groupBy("scene_id").agg(F.count("*").alias("_n")).where("_n >= 4").select("scene_id")
    parts = placed.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK_POINTS).alias("_parts")).join(enough, "scene_id")
    rows = placed.join(parts, key).withColumn("part", F.pmod(F.xxhash64("point_id"), F.col("_parts")))
    names = ["x", "y", "z", "prob", "dist"]
    blocks = cut(rows.groupBy(*key, "part").agg(*[F.collect_list(c).alias(c) for c in names]))
    near = F.explode(F.array(*[F.struct(*[F.lit(d).alias(a) for d, a in zip(s, "xyz")]) for s in _HALF]))
    left = blocks.withColumn("_s", near).select("scene_id", *[(F.col(f"c{a}") + F.col(f"_s.{a}")).alias(f"c{a}") for a in "xyz"], F.col("part").alias("part_i"), ((F.col("_s.x") == 0) & (F.col("_s.y") == 0) & (F.col("_s.z") == 0)).alias("_same"), *[F.col(c).alias(f"{c}_i") for c in names])
    met = left.join(blocks.withColumnRenamed("part", "part_j"), key).where("NOT _same OR part_i <= part_j")

    def run(batches):
        for batch in batches:
            out = {"scene_id": [], "pairs": [], "total": []}
            for row in batch.to_pylist():
                i, j = ([np.array(row[f"{c}{side}"]) for c in names] for side in ("_i", ""))
                d2 = sum((i[a][:, None] - j[a][None, :]) ** 2 for a in range(3))
                diff = i[4][:, None] - j[4][None, :]
                ok = (np.sqrt(d2) < h) & (np.abs(diff) > min_gap)
                if row["_same"] and row["part_i"] == row["part_j"]:
                    ok = np.triu(ok, 1)
                gap = np.where(diff < 0, i[3][:, None] - j[3][None, :], j[3][None, :] - i[3][:, None])[ok]
                out["scene_id"].append(row["scene_id"])
                out["pairs"].append(int(ok.sum()))
                out["total"].append(float(np.maximum(0.0, margin - gap).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(out["scene_id"], scene), pa.array(out["pairs"], pa.int64()), pa.array(out["total"], pa.float64())], names=list(out))

    scene = to_arrow_type(blocks.schema["scene_id"].dataType)
    wide = met.select("scene_id", "_same", "part_i", "part_j", *[f"{c}_i" for c in names], *names)
    sums = wide.mapInArrow(run, T.StructType([blocks.schema["scene_id"], T.StructField("pairs", T.LongType()), T.StructField("total", T.DoubleType())]))
    both = sums.groupBy("scene_id").agg(F.sum("pairs").alias("pairs"), F.sum("total").alias("total")).where("pairs > 0")
    return both.select("scene_id", "pairs", (F.col("total") / F.col("pairs")).alias("loss"))


def basin_neighbours(df: DataFrame, radius: float = 0.30) -> DataFrame:
    """Cosine of each direction-valid point with its nearest point of the same basin, within ``radius``."""
    unit = g.unit_floor(g.vec("p"), 1e-6)
    rows = df.where((F.col("valid") > 0.5) & (g.norm(g.vec("v")) > TAU)).select(
        "scene_id", "basin", "point_id", "x", "y", "z", *[c.alias(f"u{a}") for a, c in zip("xyz", unit)]
    )
    axes = ["ux", "uy", "uz"]
    near = k_nearest(rows, rows, 1, by=["scene_id", "basin"], exclude_self=True, rmax=radius, carry=axes, keep=axes)
    near = near.where(F.col("distance") < radius)
    return near.select("scene_id", "basin", "point_id", "nbr_id", g.dot(g.vec("u"), g.vec("nbr_u")).alias("cos"))


def coherence(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over basins of 1 - mean cosine, per key (``scene_id`` or none)."""
    per_basin = basin_neighbours(df).groupBy("scene_id", "basin").agg((1.0 - F.avg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cos"))))).alias("t"))
    return per_basin.groupBy(*keys).agg(F.coalesce(F.avg("t"), F.lit(0.0)).alias("loss_coherence"), F.count("*").alias("basins"))


def patch_pairs(df: DataFrame, keys: Sequence[str] = (), size: int = 48, position: str = "point_id") -> DataFrame:
    """Per patch of ``size`` consecutive positions of a key: same-label ordered pairs and their summed 1 - cosine.

    For unit vectors the sum over ordered pairs of one label is
    n(n-1) - (|sum u|^2 - sum |u|^2), so no pair is formed.  A patch holds the rows
    of one key only and an incomplete one counts like any other.
    """
    keys, unit = list(keys), g.unit_floor(g.vec("p"), 1e-6)
    rows = df.select(*keys, F.floor(F.col(position) / size).alias("patch"), "truth", *[c.alias(f"u{a}") for a, c in zip("xyz", unit)])
    sums = rows.where("truth >= 0").groupBy(*keys, "patch", "truth").agg(
        F.count("*").alias("n"), *[F.sum(f"u{a}").alias(f"u{a}") for a in "xyz"], F.sum(g.dot(g.vec("u"), g.vec("u"))).alias("uu")
    )
    loss = F.col("n") * (F.col("n") - 1) - (g.dot(g.vec("u"), g.vec("u")) - F.col("uu"))
    return sums.where("n > 1").groupBy(*keys, "patch").agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"), F.sum(loss).alias("loss_sum"))


def local_consistency(df: DataFrame, keys: Sequence[str] = (), size: int = 48) -> DataFrame:
    p = patch_pairs(df, keys, size)
    return p.groupBy(*keys).agg(F.coalesce(F.sum("loss_sum") / F.sum("pairs"), F.lit(0.0)).alias("loss_local"))
