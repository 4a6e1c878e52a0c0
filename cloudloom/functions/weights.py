"""Distance weights, scores, logits and stable pseudo colours as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# 32 class colours, red green blue.
PALETTE = (
    (230, 25, 75), (60, 180, 75), (255, 225, 25), (0, 130, 200), (245, 130, 48), (145, 30, 180),
    (70, 240, 240), (240, 50, 230), (210, 245, 60), (250, 190, 212), (0, 128, 128), (220, 190, 255),
    (170, 110, 40), (255, 250, 200), (128, 0, 0), (170, 255, 195), (128, 128, 0), (255, 215, 180),
    (0, 0, 128), (128, 128, 128), (255, 255, 255), (64, 64, 64), (139, 69, 19), (46, 139, 87),
    (255, 105, 180), (75, 0, 130), (255, 140, 0), (0, 191, 255), (154, 205, 50), (199, 21, 133),
    (184, 134, 11), (47, 79, 79),
)

# Multipliers and masks of the pseudo-colour hashes.
PAIR_SEED = (73856093, 19349663, 0x9E3779B1)
CLUSTER_SEED = (1103515245, 12345, 0x7FFFFFFF)
NOISE_COLOUR = 140


def gaussian_support(dist: Column, valid: Column, sigma: float = 0.02) -> Column:
    value = F.exp(-(dist * dist) / F.lit(2.0 * sigma * sigma))
    return F.when(valid, value).otherwise(F.lit(0.0))


def decay_weight(dist: Column, core: float = 0.06, outer: float = 0.12, rate: float = 3.0) -> Column:
    """1 up to ``core``, exponential decay up to ``outer``, 0 beyond."""
    fall = F.exp(F.lit(-rate) * (dist - F.lit(core)) / F.lit(outer - core))
    return F.when(dist <= core, F.lit(1.0)).when(dist <= outer, fall).otherwise(F.lit(0.0))


def center_confidence(cross: Column, balance: Column, separation: Column, tangent: Column) -> Column:
    score = 0.45 * cross + 0.30 * balance + 0.15 * (separation / (separation + 1.0)) + 0.10 * tangent
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softplus(x: Column) -> Column:
    """log(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def smooth_l1(d: Column) -> Column:
    return F.when(F.abs(d) < 1, 0.5 * d * d).otherwise(F.abs(d) - 0.5)


def log_sum_exp(logits: Column) -> Column:
    top = F.array_max(logits)
    return top + F.log(F.aggregate(logits, F.lit(0.0), lambda acc, v: acc + F.exp(v - top)))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
    return F.transform(logits, lambda v: F.exp(v - top) / total)


def argmax(logits: Column) -> Column:
    """0-based position of the largest value, first on a tie."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def cross_entropy(logits: Column, label: Column) -> Column:
    """NULL for an ignored (negative) label."""
    return F.when(label >= 0, log_sum_exp(logits) - F.get(logits, label))


def density_bucket(density: Column, p25: Column, p75: Column) -> Column:
    """``density`` is a mean neighbour distance: small is dense; sparse wins when both apply."""
    return F.when(density >= p75, "sparse").when(density <= p25, "dense").otherwise("mid")


def _fields(seed: Column) -> list[Column]:
    return [(F.lit(64) + F.shiftright(seed, s).bitwiseAND(F.lit(127))).cast("int") for s in (0, 8, 16)]


def pair_colour(a: Column, b: Column) -> list[Column]:
    p, q, r = PAIR_SEED
    mixed = (a.cast("bigint") * F.lit(p)).bitwiseXOR(b.cast("bigint") * F.lit(q)).bitwiseXOR(F.lit(r).cast("bigint"))
    return _fields(mixed)


def cluster_colour(cluster: Column) -> list[Column]:
    p, q, mask = CLUSTER_SEED
    seed = (cluster.cast("bigint") * F.lit(p) + F.lit(q)).bitwiseAND(F.lit(mask).cast("bigint"))
    return [F.when(cluster < 0, F.lit(NOISE_COLOUR)).otherwise(c) for c in _fields(seed)]


def class_colour(cls: Column, classes: int) -> list[Column]:
    """Palette colour of a class, cycling past 32; anything outside 0..classes-1 is black."""
    known = cls.between(0, classes - 1)
    out = []
    for band in range(3):
        shades = F.array(*[F.lit(c[band]) for c in PALETTE])
        out.append(F.when(known, F.get(shades, F.pmod(cls, F.lit(len(PALETTE))))).otherwise(F.lit(0)))
    return out


def pack_edge(vec: Sequence[Column], support: Column, valid: Column) -> Column:
    """vec, support, valid as one 5-element FLOAT array."""
    return F.array(*[c.cast("float") for c in (*vec, support, valid)])
