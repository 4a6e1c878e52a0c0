"""3-vector column arithmetic.  A vector is a tuple of three columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8
Vec = tuple[Column, Column, Column]


def vec(prefix: str, names=("x", "y", "z")) -> Vec:
    return tuple(F.col(f"{prefix}{n}") for n in names)


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b))


def scale(a: Vec, k) -> Vec:
    return tuple(p * k for p in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Vec, b: Vec) -> Vec:
    return (
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )


def unit_or_zero(a: Vec, eps: float = EPS) -> Vec:
    """Zero vector when the norm is below ``eps``."""
    n = norm(a)
    return tuple(F.when(n < eps, F.lit(0.0)).otherwise(p / F.greatest(n, F.lit(eps))) for p in a)


def unit_floor(a: Vec, eps: float = EPS) -> Vec:
    """Divides by ``max(norm, eps)``."""
    n = F.greatest(norm(a), F.lit(eps))
    return tuple(p / n for p in a)


def unit_or_same(a: Vec, eps: float = EPS) -> Vec:
    """Divides by the norm, or by 1 when the norm is below ``eps``."""
    n = norm(a)
    d = F.when(n < eps, F.lit(1.0)).otherwise(n)
    return tuple(p / d for p in a)


def on_segment(p: Vec, a: Vec, b: Vec, eps: float = EPS) -> tuple[Column, Vec]:
    """Clamped parameter and closest point on a segment; a short segment is its start."""
    s = sub(b, a)
    len2 = dot(s, s)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(sub(p, a), s) / F.greatest(len2, F.lit(eps))))
    t = F.when(len2 < eps, F.lit(0.0)).otherwise(t)
    return t, tuple(a[i] + t * s[i] for i in range(3))


def segment_distance(p: Vec, a: Vec, b: Vec) -> Column:
    _, q = on_segment(p, a, b)
    return norm(sub(p, q))


def line_distance(p: Vec, origin: Vec, direction: Vec) -> Column:
    d = unit_or_zero(direction)
    v = sub(p, origin)
    along = dot(v, d)
    perp = sub(v, scale(d, along))
    return F.when(norm(d) < EPS, F.lit(float("inf"))).otherwise(norm(perp))


def axis_snap(df: DataFrame, d: Vec, out: tuple[str, str, str], score: str, degrees: float = 15.0, strength: float = 0.3) -> DataFrame:
    """Pull a direction toward its nearest axis when it is within ``degrees`` of it.

    Staged over helper columns: as one expression the generated code would
    repeat every sub-term many times.
    """
    limit = math.cos(math.radians(degrees))
    keep = [F.col(c) for c in df.columns]
    s = df.select(*keep, *[c.alias(f"_u{i}") for i, c in enumerate(unit_or_zero(d))])
    u = [F.col(f"_u{i}") for i in range(3)]
    s = s.select("*", F.greatest(*[F.abs(c) for c in u]).alias("_best"))
    best = F.col("_best")
    alpha = F.lit(strength) * F.least(F.greatest((best - F.lit(limit)) / F.lit(1.0 - limit + EPS), F.lit(0.0)), F.lit(1.0))
    axis = F.when(F.abs(u[0]) == best, 0).when(F.abs(u[1]) == best, 1).otherwise(2)
    s = s.select("*", alpha.alias("_alpha"), axis.alias("_axis"))
    pull = [
        (1.0 - F.col("_alpha")) * u[i]
        + F.when(F.col("_axis") == i, F.col("_alpha") * F.when(u[i] >= 0, 1.0).otherwise(-1.0)).otherwise(0.0)
        for i in range(3)
    ]
    s = s.select("*", *[c.alias(f"_m{i}") for i, c in enumerate(pull)])
    s = s.select("*", norm(tuple(F.col(f"_m{i}") for i in range(3))).alias("_mn"))
    snapped = [F.when(best < F.lit(limit), u[i]).otherwise(F.col(f"_m{i}") / F.greatest(F.col("_mn"), F.lit(EPS))) for i in range(3)]
    return s.select(*keep, *[c.alias(n) for n, c in zip(out, snapped)], best.alias(score))


def side_of(d: Vec) -> Column:
    """1 when the largest-magnitude component is positive, else 0; first axis wins a tie."""
    size = [F.abs(c) for c in d]
    top = F.greatest(*size)
    lead = F.when(size[0] == top, d[0]).when(size[1] == top, d[1]).otherwise(d[2])
    return F.when(lead > 0, 1).otherwise(0)
