"""Spatial chunking: overlapping tiles, facade components, bisection, padded cubes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions.grid import tile_count
from cloudloom.operators.graph import components
from cloudloom.operators.neighbors import k_nearest
from cloudloom.operators.stats import median
from cloudloom.session import cut

# Classes that mark a facade after the remap.
FACADE_CLASSES = (0, 1, 2, 3, 4, 5, 6, 7, 12)


def tile_edges(lo: Column, hi: Column, i: Column, n: Column, tile: float, overlap: float) -> tuple[Column, Column]:
    """Closed bounds of tile ``i`` of ``n``; the last one ends at ``hi`` and keeps its width if it can."""
    stride = tile - overlap
    plain = lo + i * F.lit(stride)
    last = i == n - 1
    start = F.when(n == 1, lo).when(last, F.least(plain, hi - F.lit(tile))).otherwise(plain)
    end = F.when(last, hi).otherwise(plain + F.lit(tile))
    return start, end


def tile_grid(boxes: DataFrame, tile: float, overlap: float, keys: Sequence[str], z_band: float | None = None) -> DataFrame:
    """All tiles of every box, numbered x outer, y inner, z innermost."""
    bad = (F.col("x_max") <= F.col("x_min")) | (F.col("y_max") <= F.col("y_min")) | (F.col("z_max") <= F.col("z_min"))
    g = boxes.withColumn("_ok", F.when(bad, F.raise_error(F.lit("degenerate bounding box")).cast("int")))
    sizes = {"x": (tile, overlap), "y": (tile, overlap), "z": (z_band, 0.0)}
    for a, (size, over) in sizes.items():
        n = F.lit(1) if size is None else tile_count(F.col(f"{a}_max") - F.col(f"{a}_min"), size, over)
        g = g.withColumn(f"_n{a}", n).withColumn(f"{a}_tile", F.explode(F.sequence(F.lit(0), F.col(f"_n{a}") - 1)))
    for a, (size, over) in sizes.items():
        if size is None:
            lo, hi = F.col(f"{a}_min"), F.col(f"{a}_max")
        else:
            lo, hi = tile_edges(F.col(f"{a}_min"), F.col(f"{a}_max"), F.col(f"{a}_tile"), F.col(f"_n{a}"), size, over)
        g = g.withColumn(f"{a}_lo", lo).withColumn(f"{a}_hi", hi)
    index = (F.col("x_tile") * F.col("_ny") + F.col("y_tile")) * F.col("_nz") + F.col("z_tile")
    return g.where(F.col("_ok").isNull()).select(
        *keys, index.alias("chunk_idx"), "x_tile", "y_tile", "z_tile", *[f"{a}_{e}" for a in "xyz" for e in ("lo", "hi")]
    )


def assign_tiles(points: DataFrame, tile: float, overlap: float, keys: Sequence[str]) -> DataFrame:
    """Every (point, tile) with the point inside the closed tile; overlaps repeat points.

    The tile numbers follow from the coordinate by arithmetic, so there is no
    range join: a point lists the few tile numbers around it and keeps those
    whose exact bounds hold it.
    """
    stride = tile - overlap
    box = points.groupBy(*keys).agg(*[f(F.col(a)).alias(f"_{a}{e}") for a in "xy" for e, f in (("0", F.min), ("1", F.max))])
    out = points.join(box, list(keys))
    for a in "xy":
        lo, hi = F.col(f"_{a}0"), F.col(f"_{a}1")
        n = tile_count(hi - lo, tile, overlap)
        first = F.floor((F.col(a) - lo - F.lit(tile)) / F.lit(stride)).cast("int")
        last = F.floor((F.col(a) - lo) / F.lit(stride)).cast("int")
        out = out.withColumn(f"_n{a}", n)
        low = F.least(F.greatest(first, F.lit(0)), F.col(f"_n{a}") - 1)
        high = F.col(f"_n{a}") - 1
        span = F.sequence(low, F.least(F.greatest(last + 1, low), high))
        near_last = F.array_distinct(F.concat(span, F.array(high)))  # the last tile is pulled back
        out = out.withColumn(f"{a}_tile", F.explode(near_last))
        start, end = tile_edges(lo, hi, F.col(f"{a}_tile"), F.col(f"_n{a}"), tile, overlap)
        out = out.where((F.col(a) >= start) & (F.col(a) <= end))
    out = out.withColumn("chunk_idx", F.col("x_tile") * F.col("_ny") + F.col("y_tile"))
    return out.drop("_x0", "_x1", "_y0", "_y1", "_nx", "_ny", "x_tile", "y_tile")


_CELL_SPAN = 1 << 31


def _cell_id(gx: Column, gy: Column) -> Column:
    """Order-preserving id of an XY cell: by gx, then gy."""
    return gx.cast("bigint") * F.lit(_CELL_SPAN) + gy.cast("bigint")


def nearest_occupied(cells: DataFrame, occupied: DataFrame, by: Sequence[str]) -> DataFrame:
    """Nearest occupied XY cell of every given cell; ties go to the smaller (gx, gy)."""
    q = cells.withColumn("cell_id", _cell_id(F.col("gx"), F.col("gy")))
    b = occupied.withColumn("cell_id", _cell_id(F.col("gx"), F.col("gy")))
    near = k_nearest(q, b, 1, by=by, coords=("gx", "gy"), query_id="cell_id", base_id="cell_id", carry=["gx", "gy"], keep=["gx", "gy"])
    return near.select(*by, "gx", "gy", F.col("nbr_gx").alias("near_gx"), F.col("nbr_gy").alias("near_gy"))


def shell_depth(positive: DataFrame, everything: DataFrame, by: Sequence[str]) -> DataFrame:
    """L-infinity steps from each positive voxel to the nearest other voxel; 99 if there is none."""
    cell = ["gx", "gy", "gz"]
    negative = everything.join(positive, [*by, *cell], "left_anti")
    ident = F.xxhash64(*cell)
    near = k_nearest(
        positive.withColumn("cell_id", ident), negative.withColumn("cell_id", ident), 1,
        by=by, coords=cell, query_id="cell_id", base_id="cell_id", metric="linf", keep=cell,
    )
    out = positive.join(near.select(*by, *cell, F.col("distance").cast("bigint").alias("depth")), [*by, *cell], "left")
    return out.withColumn("depth", F.coalesce("depth", F.lit(99).cast("bigint")))


def occupancy(points: DataFrame, cell: float, by: Sequence[str], facade: Sequence[int] = FACADE_CLASSES) -> DataFrame:
    """Occupied XY cells of the facade classes, counted from the minimum corner of all points."""
    placed = with_cells(points, cell, by)
    return placed.where(F.col("segment").isin(list(facade))).select(*by, "gx", "gy").distinct()


def with_cells(points: DataFrame, cell: float, by: Sequence[str]) -> DataFrame:
    low = points.groupBy(*by).agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"))
    placed = points.join(low, list(by))
    for a in "xy":
        placed = placed.withColumn(f"g{a}", ((F.col(a) - F.col(f"_{a}0")) / F.lit(cell)).cast("int"))
    return placed.drop("_x0", "_y0")


def facade_components(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """4-connected components of the occupied cells, numbered from 1 in raster order."""
    node = _cell_id(F.col("gx"), F.col("gy"))
    nodes = cells.withColumn("node", node)
    edges = None
    for dx, dy in ((1, 0), (0, 1)):
        shifted = nodes.select(*by, (F.col("gx") - dx).alias("gx"), (F.col("gy") - dy).alias("gy"), F.col("node").alias("dst"))
        e = nodes.join(shifted, [*by, "gx", "gy"]).select(*by, F.col("node").alias("src"), "dst")
        edges = e if edges is None else edges.unionByName(e)
    labelled = components(nodes.select(*by, "node"), edges, by)
    roots = labelled.select(*by, "component").distinct()
    order = Window.partitionBy(*by).orderBy("component") if by else Window.partitionBy(F.lit(0)).orderBy("component")
    roots = roots.withColumn("label", F.row_number().over(order))
    return nodes.join(labelled, [*by, "node"]).join(roots, [*by, "component"]).select(*by, "gx", "gy", "label")


def bisect(points: DataFrame, piece: Sequence[str], budget: int, min_points: int) -> DataFrame:
    """Halve every piece above ``budget`` at the median of its longer XY axis, repeatedly.

    ``path`` collects the turns (0 left, 1 right).  Each round is one aggregation
    for the pieces' boxes and medians and one join back; the number of rounds is
    the depth of the deepest split.  A piece with a half below ``min_points`` or
    an empty half stays whole.
    """
    out = points.withColumn("path", F.lit("")).withColumn("_open", F.lit(True))
    key = [*piece, "path"]
    while True:
        stats = out.where("_open").groupBy(*key).agg(
            F.count("*").alias("_n"), (F.max("x") - F.min("x")).alias("_sx"), (F.max("y") - F.min("y")).alias("_sy")
        ).where(F.col("_n") > budget)
        stats = cut(stats.select(*key, (F.col("_sx") >= F.col("_sy")).alias("_on_x")))
        if stats.isEmpty():
            return out.drop("_open")
        along = out.where("_open").join(stats, key).select(*key, F.when(F.col("_on_x"), F.col("x")).otherwise(F.col("y")).alias("_a"))
        stats = stats.join(median(along, key, "_a", "_cut"), key)
        trial = out.where("_open").join(stats, key)
        left = F.when(F.col("_on_x"), F.col("x")).otherwise(F.col("y")) <= F.col("_cut")
        sides = trial.groupBy(*key).agg(F.count_if(left).alias("_l"), F.count_if(~left).alias("_r"))
        good = sides.where((F.col("_l") >= max(min_points, 1)) & (F.col("_r") >= max(min_points, 1))).select(*key)
        splits = cut(stats.join(good, key))
        if splits.isEmpty():
            return out.drop("_open")
        moved = out.join(splits, key, "left")
        turn = F.when(F.col("_cut").isNull(), F.lit("")).when(left, F.lit("0")).otherwise(F.lit("1"))
        out = cut(moved.withColumn("_open", F.col("_cut").isNotNull()).withColumn("path", F.concat("path", turn)).drop("_on_x", "_cut"))


def component_of_points(points: DataFrame, by: Sequence[str], cell: float, facade: Sequence[int] = FACADE_CLASSES) -> DataFrame:
    """Adds ``label``: the facade component nearest to each point's XY cell (0 in a scene without facade)."""
    placed = with_cells(points, cell, by)
    cells = cut(placed.groupBy(*by, "gx", "gy").agg(F.bool_or(F.col("segment").isin(list(facade))).alias("occ")))
    occupied = cells.where("occ").drop("occ")
    labels = cut(facade_components(occupied, by))
    near = nearest_occupied(cells.where(~F.col("occ")).drop("occ"), occupied, by)
    loose = near.join(labels.withColumnsRenamed({"gx": "near_gx", "gy": "near_gy"}), [*by, "near_gx", "near_gy"]).select(*by, "gx", "gy", "label")
    every = labels.unionByName(loose)
    return placed.join(every, [*by, "gx", "gy"], "left").withColumn("label", F.coalesce("label", F.lit(0))).drop("gx", "gy")


def facade_chunks(points: DataFrame, by: Sequence[str], cell: float = 1.0, budget: int = 1_000_000, min_points: int = 10_000,
                  facade: Sequence[int] = FACADE_CLASSES) -> DataFrame:
    """The full facade chunker: a partition of the kept points with ``chunk_idx`` by centroid x.

    A scene without facade points stays one chunk of all its points, whatever its size.
    """
    placed = cut(component_of_points(points, by, cell, facade))
    plain, owned = placed.where("label = 0"), placed.where("label > 0")
    size = owned.groupBy(*by, "label").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_points).drop("_n")
    pieces = bisect(owned.join(size, [*by, "label"]), [*by, "label"], budget, min_points)
    key = [*by, "label", "path"]
    stats = pieces.groupBy(*key).agg(F.count("*").alias("_n"), F.avg("x").alias("_cx")).where(F.col("_n") >= min_points)
    ordered = pieces.join(order_chunks(stats, by, key), key).drop("label", "path")
    return ordered.unionByName(plain.drop("label").withColumn("chunk_idx", F.lit(0)))


def order_chunks(stats: DataFrame, by: Sequence[str], key: Sequence[str], at: str = "_cx") -> DataFrame:
    """Chunk numbers by centroid x; one row per chunk, so the window is small."""
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    tie = [c for c in key if c not in by]
    return stats.select(*key, (F.row_number().over(part.orderBy(at, *tie)) - 1).alias("chunk_idx"))


def padded_cubes(points: DataFrame, size: float, pad: float, by: Sequence[str]) -> DataFrame:
    """Replicates points into every padded cube that holds them; ``core`` marks the owner.

    Cubes are counted from the scene's minimum corner.  Padded ranges are
    half-open; each point has exactly one core cube (the last cube is closed).
    """
    box = points.groupBy(*by).agg(*[f(F.col(a)).alias(f"_{a}{e}") for a in "xyz" for e, f in (("0", F.min), ("1", F.max))])
    out = points.join(box, list(by))
    own = {}
    for a in "xyz":
        rel = F.col(a) - F.col(f"_{a}0")
        top = F.greatest(F.ceil((F.col(f"_{a}1") - F.col(f"_{a}0")) / F.lit(size)) - 1, F.lit(0))
        own[a] = F.least(F.floor(rel / F.lit(size)), top)
        first = F.greatest(F.floor((rel - F.lit(pad)) / F.lit(size)), F.lit(0))
        last = F.least(F.floor((rel + F.lit(pad)) / F.lit(size)), top)
        out = out.withColumn(f"_own{a}", own[a]).withColumn(f"cube_{a}", F.explode(F.sequence(F.least(first, top), F.greatest(last, F.least(first, top)))))
    core = F.lit(True)
    for a in "xyz":
        core = core & (F.col(f"cube_{a}") == F.col(f"_own{a}"))
    drop = [f"_{a}{e}" for a in "xyz" for e in "01"] + [f"_own{a}" for a in "xyz"]
    return out.withColumn("core", core).drop(*drop)
