"""Cell arithmetic: voxel keys, grid indices, tile sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The packed voxel key holds three 21-bit fields, each offset by 2^20.
KEY_FIELD_BITS = 21
KEY_OFFSET = 1 << 20

# Candidate tile sizes in metres.
TILE_SIZES = (8.0, 10.0, 12.0, 16.0, 20.0, 24.0, 32.0)


def voxel_index(coord: Column, grid: float) -> Column:
    """Voxel number along one axis; multiplies by the reciprocal of ``grid``."""
    return F.floor(coord * F.lit(1.0 / grid))


def voxel_key(x: Column, y: Column, z: Column, grid: float) -> Column:
    """The 63-bit key of a point's voxel as a non-negative BIGINT."""
    fields = [voxel_index(c, grid) + F.lit(KEY_OFFSET) for c in (x, y, z)]
    high = F.shiftleft(fields[0], 2 * KEY_FIELD_BITS)
    return high.bitwiseOR(F.shiftleft(fields[1], KEY_FIELD_BITS)).bitwiseOR(fields[2])


def hash_bin(key: Column, bins: int = 16) -> Column:
    return F.pmod(key, F.lit(bins))


def grid_index(coord: Column, grid: float) -> Column:
    """Grid number along one axis; divides by ``grid``."""
    return F.floor(coord / F.lit(grid))


def relative_grid(df: DataFrame, grid: float, scene: Sequence[str], coords=("x", "y", "z")) -> DataFrame:
    """Adds ``gx, gy, gz`` counted from the smallest occupied index of the scene.

    The minimum is a partially aggregated one-row-per-scene table joined back,
    so a huge scene is never gathered in one window partition.
    """
    low = df.groupBy(*scene).agg(*[F.min(grid_index(F.col(c), grid)).alias(f"_m{c}") for c in coords])
    out = df.join(low, list(scene))
    for c in coords:
        out = out.withColumn(f"g{c}", grid_index(F.col(c), grid) - F.col(f"_m{c}"))
    return out.drop(*[f"_m{c}" for c in coords])


def fnv(values: Sequence[Column], *, offset: int, xor_first: bool) -> Column:
    """64-bit FNV over integer columns, returned as two 32-bit halves in a struct.

    Each step is carried out on 32-bit halves so that no product leaves BIGINT.
    The multiplier is 2^40 + 435.
    """
    mask = F.lit(0xFFFFFFFF)
    hi, lo = F.lit(offset >> 32), F.lit(offset & 0xFFFFFFFF)

    def times(hi, lo):
        low = lo * F.lit(435)
        high = F.shiftrightunsigned(low, 32) + hi * F.lit(435) + F.shiftleft(lo, 8)
        return high.bitwiseAND(mask), low.bitwiseAND(mask)

    for v in values:
        if not xor_first:
            hi, lo = times(hi, lo)
        hi = hi.bitwiseXOR(F.shiftrightunsigned(v, 32).bitwiseAND(mask))
        lo = lo.bitwiseXOR(v.bitwiseAND(mask))
        if xor_first:
            hi, lo = times(hi, lo)
    return F.struct(hi.alias("hi"), lo.alias("lo"))


def class_clip(c: Column, top: int = 16) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(top), c))


def remap_after_void(c: Column, classes: int = 16) -> Column:
    """1..classes -> 0..classes-1; any other value fails the job."""
    ok = c.between(1, classes)
    return F.when(ok, c - 1).otherwise(F.raise_error(F.concat(F.lit("class out of range: "), c.cast("string"))).cast("int"))


def adaptive_tile(density: Column, target: float) -> Column:
    """Tile edge for a point budget, snapped to the nearest allowed size (smaller on a tie)."""
    raw = F.sqrt(F.lit(target) / density)
    options = F.array(*[F.struct(F.abs(F.lit(g) - raw).alias("gap"), F.lit(g).alias("size")) for g in TILE_SIZES])
    return F.array_min(options)["size"]


def chunk_name(base: Column, idx: Column) -> Column:
    """Four digits, more where the index needs them."""
    name = F.format_string("%s__c%04d", base, idx)
    return F.when(idx >= 0, name).otherwise(F.raise_error(F.lit("negative chunk index")))


def tile_count(span: Column, tile: float, overlap: float) -> Column:
    stride = tile - overlap
    if stride <= 0:
        raise ValueError("overlap must be smaller than the tile")
    many = F.ceil((span - F.lit(tile)) / F.lit(stride)).cast("int") + 1
    return F.when(span <= F.lit(tile), F.lit(1)).otherwise(many)
