"""Exact k-nearest and radius-bounded neighbour search as Spark joins.

The search never compares all pairs.  It works on a count pyramid:

1. points are binned in cubic cells; a cell holding more than ``budget`` base
   points is refined until it is small, so a dense spot is split however many
   rows it holds (co-located duplicates beyond the ``k + 1`` smallest ids can
   never be an answer and are dropped first);
2. cell counts are rolled up to every coarser level;
3. each group of queries (one leaf cell) reads an upper bound on its k-th
   distance from the counts alone, lists the cells that may hold an answer and
   descends to the leaves, pruning by box distance.  Cells far denser than the
   querying group are opened per query point, one level per round;
4. surviving leaves are joined to their points, and each group is ranked with
   vectorised arithmetic in one bounded Arrow batch.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudloom.session import cut

_FINEST = 30  # bits per axis of the finest cell index
_SLACK = 1.0 + 1e-9  # keeps box bounds on the safe side of float rounding
_QUERIES_PER_TASK = 2048
_GROUPS_PER_TASK = 2048
_OFFERS_PER_TASK = 1_000_000


def _axis(prefix: str, dims: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(dims)]


def _cell_at(fine: str, level: str | int) -> Column:
    return F.expr(f"shiftright({fine}, {_FINEST} - {level})")


def _gap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    return F.greatest(lo_a - hi_b, lo_b - hi_a, F.lit(0.0))


def _reach(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    return F.greatest(hi_a - lo_b, hi_b - lo_a)


def _combine(parts: list[Column], metric: str) -> Column:
    """Per-axis extents -> the distance value the search compares (d^2 or L-inf)."""
    if metric == "linf":
        return F.greatest(*parts) if len(parts) > 1 else parts[0]
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return total


def _box_bound(fn, a: tuple[str, str], b: tuple[str, str], dims: int, metric: str) -> Column:
    parts = [
        fn(F.col(f"{a[0]}{i}"), F.col(f"{a[1]}{i}"), F.col(f"{b[0]}{i}"), F.col(f"{b[1]}{i}"))
        for i in range(dims)
    ]
    return _combine(parts, metric)


class _Search:
    def __init__(self, dims, by, need, budget, metric, differ):
        self.dims, self.by, self.need = dims, list(by), need
        self.budget, self.metric, self.differ = budget, metric, differ
        self.cells = _axis("_c", dims)
        self.leaf = [*self.by, "_lvl", *self.cells]

    # -- cells -------------------------------------------------------------
    def locate(self, df: DataFrame, origin, extent, level: int) -> DataFrame:
        scale = float(2**_FINEST) / extent
        top = 2**_FINEST - 1
        for i in range(self.dims):
            df = df.withColumn(
                f"_f{i}",
                F.least(F.floor((F.col(f"_p{i}") - F.lit(origin[i])) * F.lit(scale)), F.lit(top)),
            )
        return self.rebin(df.withColumn("_lvl", F.lit(level)))

    def rebin(self, df: DataFrame) -> DataFrame:
        for i in range(self.dims):
            df = df.withColumn(f"_c{i}", _cell_at(f"_f{i}", "_lvl"))
        return df

    def deepen(self, df: DataFrame, dense: DataFrame) -> DataFrame:
        joined = df.join(dense.withColumn("_deep", F.lit(True)), self.leaf, "left")
        step = F.when(F.col("_deep"), F.least(F.col("_lvl") + 2, F.lit(_FINEST))).otherwise(F.col("_lvl"))
        return self.rebin(joined.withColumn("_lvl", step).drop("_deep"))

    # -- pyramid -----------------------------------------------------------
    def pyramid(self, base: DataFrame) -> DataFrame:
        """Cells of every level: count, tight box, label histogram if needed."""
        label = ["_label"] if self.differ else []
        boxes = [F.min(f"_p{i}").alias(f"_lo{i}") for i in range(self.dims)]
        boxes += [F.max(f"_p{i}").alias(f"_hi{i}") for i in range(self.dims)]
        leaves = base.groupBy(*self.leaf, *label).agg(F.count("*").alias("_n"), *boxes)
        up = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("_lvl"))))
        for i in range(self.dims):
            up = up.withColumn(f"_c{i}", F.expr(f"shiftright(_c{i}, _lvl - level)"))
        merge = [F.sum("_n").alias("_n"), F.max(F.col("level") == F.col("_lvl")).alias("_is_leaf")]
        merge += [F.min(f"_lo{i}").alias(f"_lo{i}") for i in range(self.dims)]
        merge += [F.max(f"_hi{i}").alias(f"_hi{i}") for i in range(self.dims)]
        key = [*self.by, "level", *self.cells]
        if not self.differ:
            return up.groupBy(*key).agg(*merge)
        per_label = up.groupBy(*key, "_label").agg(*merge)
        return per_label.groupBy(*key).agg(
            F.map_from_entries(F.collect_list(F.struct("_label", "_n"))).alias("_hist"),
            F.sum("_n").alias("_n"),
            F.max("_is_leaf").alias("_is_leaf"),
            *merge[2:],
        )

    def eligible(self) -> Column:
        if not self.differ:
            return F.col("_n")
        return F.col("_n") - F.coalesce(F.try_element_at("_hist", F.col("_qlabel")), F.lit(0))

    def parent_join(self, rows: DataFrame, pyr: DataFrame) -> DataFrame:
        return rows.join(pyr, [*self.by, "level", *self.cells])


def k_nearest(
    query: DataFrame,
    base: DataFrame,
    k: int = 1,
    *,
    by: Sequence[str] = (),
    coords: Sequence[str] = ("x", "y", "z"),
    query_id: str = "point_id",
    base_id: str = "point_id",
    exclude_self: bool = False,
    differ: str | None = None,
    rmax: float | None = None,
    metric: str = "l2",
    carry: Sequence[str] = (),
    keep: Sequence[str] = (),
    budget: int | None = None,
) -> DataFrame:
    """The ``k`` nearest rows of ``base`` for every row of ``query``.

    Returns ``by..., query_id, nbr_id, distance, rank``, ``nbr_<col>`` for every
    column of ``carry`` and the query's own columns named in ``keep``.  Ties are broken by the smaller ``base_id``.
    ``exclude_self`` drops the row with the query's own id; ``differ`` keeps
    only rows whose ``differ`` column is not equal to the query's; ``rmax``
    keeps only rows within that distance (closed).  A query with no answer has
    no output row.  ``metric`` is ``l2`` or ``linf``.
    """
    by, coords, carry, keep = list(by), list(coords), list(carry), list(keep)
    dims = len(coords)
    need = k + (1 if exclude_self else 0)
    size = max(2 * k, 32)  # base points aimed at per leaf cell
    budget = budget or 8 * size
    s = _Search(dims, by, need, budget, metric, differ)
    same = query is base and query_id == base_id
    taken = [(c, f"nbr_{c}") for c in carry]
    kept = [(c, f"_keep_{c}") for c in keep]

    def shape(df, ident, label, extra):
        cols = [F.col(c).alias(c) for c in by] + [F.col(ident).alias("_id")]
        cols += [F.col(c).cast("double").alias(f"_p{i}") for i, c in enumerate(coords)]
        if differ:
            cols.append(F.col(differ).alias(label))
        # the input is read by every step of the search, so whatever made it runs once
        return cut(df.select(*cols, *[F.col(c).alias(name) for c, name in extra]))

    if same:
        b = shape(base, base_id, "_label", [*taken, *kept])
        q = b.select(*[F.col(c).alias("_qlabel" if c == "_label" else c) for c in b.columns if c not in [n for _, n in taken]])
        b = b.drop(*[n for _, n in kept])
    else:
        b, q = shape(base, base_id, "_label", taken), shape(query, query_id, "_qlabel", kept)

    bounds = [F.min(f"_p{i}").alias(f"lo{i}") for i in range(dims)]
    bounds += [F.max(f"_p{i}").alias(f"hi{i}") for i in range(dims)]
    seen = b.select(*_axis("_p", dims), F.lit(1).alias("is_base"))
    if not same:
        seen = seen.unionByName(q.select(*_axis("_p", dims), F.lit(0).alias("is_base")))
    stat = seen.agg(F.sum("is_base").alias("n"), F.count("*").alias("rows"), *bounds).first()
    total = int(stat["n"] or 0)
    extra = [f"nbr_{c}" for c in carry]
    rank = _ranker(dims, k, exclude_self, bool(differ), rmax, metric, by, query_id, extra, keep)
    out_schema = _result_schema(b, q, by, query_id, carry, keep)
    if total == 0:
        return query.sparkSession.createDataFrame([], out_schema)
    origin = [float(stat[f"lo{i}"]) for i in range(dims)]
    extent = max(float(stat[f"hi{i}"]) - origin[i] for i in range(dims)) * _SLACK or 1.0
    # scans cover surfaces: pick the level by how many cells are really occupied; each group of ``by`` has a grid of its own
    grids = max(int(b.agg(F.approx_count_distinct(F.xxhash64(*by))).first()[0]), 1) if by else 1
    lowest = max(0, min(_FINEST - 5, round(math.log(max(total / grids / size, 1.0), 2**dims)) - 1))
    b = s.locate(b, origin, extent, lowest)
    levels = range(lowest, lowest + 5)
    occupied = b.agg(*[
        F.approx_count_distinct(F.xxhash64(*by, *[_cell_at(f"_f{i}", v) for i in range(dims)])).alias(str(v)) for v in levels
    ]).first()
    level = min(levels, key=lambda v: abs(math.log(total / max(occupied[str(v)], 1) / size)))
    b = s.rebin(b.withColumn("_lvl", F.lit(level)))
    q = s.locate(q, origin, extent, level)
    pyr = cut(s.pyramid(b))
    uneven = not pyr.where(F.col("_is_leaf") & (F.col("_n") > s.budget)).isEmpty()
    if uneven:
        b, q = _split_dense(s, b, q, need)
        pyr = cut(s.pyramid(b))
    groups, frontier = _first_frontier(s, q, pyr, extent, rmax, level, uneven)
    frontier = cut(frontier)
    open_cell = (F.col("_n") > s.budget) & ~F.col("_is_leaf")
    gkey = [*by, "_glvl", *[f"_g{i}" for i in range(dims)], *(["_qlabel"] if differ else [])]
    q = q.withColumnsRenamed({"_lvl": "_glvl", **{f"_c{i}": f"_g{i}" for i in range(dims)}})

    pairs = _to_leaves(s, frontier.where(~open_cell), pyr, gkey, prune=True)
    if not frontier.where(open_cell).isEmpty():
        opened = _open_dense(s, frontier.where(open_cell), q, pyr, gkey)
        pairs = pairs.unionByName(_to_leaves(s, opened, pyr, gkey, prune=False)).distinct()

    # one ranking task unit per leaf group: labels share it, huge groups are split by id hash
    unit = [c for c in gkey if c != "_qlabel"]
    if differ:
        pairs = pairs.select(*unit, "_lvl", *s.cells).distinct()
    share = groups.groupBy(*unit).agg(F.ceil(F.sum("_nq") / F.lit(_QUERIES_PER_TASK)).cast("int").alias("_parts"))
    q = q.join(share, unit).withColumn("_part", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int"))
    pairs = pairs.join(share, unit).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    # a pair of some 20 bytes becomes all points of its leaf, so these tasks too are cut by rows and not by bytes
    pairs = cut(pairs)
    tasks = max(1, math.ceil(pairs.count() * size / _OFFERS_PER_TASK))
    at = s.leaf if uneven else [*by, *s.cells]  # a level that all share is a constant, and Spark would shuffle again without it
    pairs, b = pairs.select(*unit, "_part", *[c for c in at if c not in by]), b.select(*at, "_id", *_axis("_p", dims), *(["_label"] if differ else []), *extra)
    offer = pairs.repartition(tasks, *at).join(b.repartition(tasks, *at).hint("merge"), at)
    return _ranked(q, offer, by, [*unit, "_part"], dims, bool(differ), keep, extra).mapInArrow(rank, out_schema)


def _ranked(q: DataFrame, offer: DataFrame, by, unit, dims: int, differ: bool, keep, extra) -> DataFrame:
    """Queries and candidates of each unit side by side, sorted for the ranker."""
    h1, h2 = F.xxhash64(*unit), F.xxhash64(F.lit(17), *unit)
    point = ["_id", *_axis("_p", dims)]
    head = [*by, h1.alias("_h1"), h2.alias("_h2")]
    ask = q.select(*head, F.lit(0).alias("_role"), *point, *([F.col("_qlabel").alias("_label")] if differ else []), *[f"_keep_{c}" for c in keep])
    offer = offer.select(*head, F.lit(1).alias("_role"), *point, *(["_label"] if differ else []), *extra)
    rows = ask.unionByName(offer, allowMissingColumns=True)
    return rows.repartition("_h1", "_h2").sortWithinPartitions("_h1", "_h2", "_role", "_id")


def _result_schema(b, q, by, query_id, carry, keep) -> T.StructType:
    fields = [T.StructField(c, q.schema[c].dataType) for c in by]
    fields.append(T.StructField(query_id, q.schema["_id"].dataType))
    fields.append(T.StructField("nbr_id", b.schema["_id"].dataType))
    fields.append(T.StructField("distance", T.DoubleType()))
    fields.append(T.StructField("rank", T.IntegerType()))
    fields += [T.StructField(f"nbr_{c}", b.schema[f"nbr_{c}"].dataType) for c in carry]
    fields += [T.StructField(c, q.schema[f"_keep_{c}"].dataType) for c in keep]
    return T.StructType(fields)


def _split_dense(s: _Search, b: DataFrame, q: DataFrame, need: int):
    """Refine every cell that holds more than ``budget`` base points."""
    spot = [*s.by, *_axis("_p", s.dims), *(["_label"] if s.differ else [])]
    order = Window.partitionBy(*spot).orderBy("_id")
    b = cut(b.withColumn("_dup", F.row_number().over(order)).where(F.col("_dup") <= need).drop("_dup"))
    while True:
        counts = b.where(F.col("_lvl") < _FINEST).groupBy(*s.leaf).agg(F.count("*").alias("_n"))
        dense = cut(counts.where(F.col("_n") > s.budget).drop("_n"))
        if dense.isEmpty():
            return b, q
        b, q = cut(s.deepen(b, dense)), cut(s.deepen(q, dense))


def _first_frontier(s: _Search, q: DataFrame, pyr: DataFrame, extent: float, rmax: float | None, base_level: int, uneven: bool):
    """Query groups with a distance bound, and the cells that may answer them."""
    dims, cells = s.dims, s.cells
    label = ["_qlabel"] if s.differ else []
    boxes = [F.min(f"_p{i}").alias(f"_qlo{i}") for i in range(dims)]
    boxes += [F.max(f"_p{i}").alias(f"_qhi{i}") for i in range(dims)]
    groups = q.groupBy(*s.leaf, *label).agg(F.count("*").alias("_nq"), *boxes)
    groups = groups.withColumnsRenamed({"_lvl": "_glvl", **{f"_c{i}": f"_g{i}" for i in range(dims)}})
    gkey = [*s.by, "_glvl", *[f"_g{i}" for i in range(dims)], *label]

    climb = groups.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("_glvl"))))
    for i in range(dims):
        climb = climb.withColumn(f"_c{i}", F.expr(f"shiftright(_g{i}, _glvl - level)"))
    hit = climb.join(pyr, [*s.by, "level", *cells], "left")
    bound = _box_bound(_reach, ("_qlo", "_qhi"), ("_lo", "_hi"), dims, s.metric) * F.lit(_SLACK)
    enough = F.when(s.eligible() >= F.lit(s.need), F.struct(F.col("level"), bound.alias("bound")))
    first = [F.first(f"_q{e}{i}").alias(f"_q{e}{i}") for e in ("lo", "hi") for i in range(dims)]
    best = hit.groupBy(*gkey).agg(F.max(enough).alias("_best"), *first)

    level = F.coalesce(F.col("_best.level"), F.lit(0))
    tau = F.coalesce(F.col("_best.bound"), F.lit(float("inf")))
    if rmax is not None:
        limit = float(rmax) if s.metric == "linf" else float(rmax) * float(rmax)
        by_radius = max(0, math.floor(math.log2(2.0 * extent / rmax))) if rmax > 0 else _FINEST
        level = F.greatest(level, F.least(F.lit(by_radius), F.col("_glvl")))
        tau = F.least(tau, F.lit(limit * _SLACK))
    best = best.withColumn("level", level).withColumn("_tau", tau).drop("_best")
    for i in range(dims):
        best = best.withColumn(f"_c{i}", F.expr(f"shiftright(_g{i}, _glvl - level)"))

    # a row becomes up to 125 cells a level, so tasks are cut by rows and not by bytes
    tasks = max(1, math.ceil(best.count() / _GROUPS_PER_TASK))
    around = best.repartition(tasks, *gkey).withColumn("_at", F.col("level"))
    if uneven:
        # a neighbouring region may be one leaf coarser than this level: look at the ancestors too
        around = around.withColumn("_at", F.explode(F.sequence(F.least(F.lit(base_level), F.col("level")), F.col("level"))))
    for i in range(dims):
        around = around.withColumn(f"_c{i}", F.explode(F.expr(
            f"sequence(shiftright(greatest(_c{i} - 2, 0L), level - _at), shiftright(least(_c{i} + 2, shiftleft(1L, level) - 1), level - _at))"
        )))
    around = around.withColumn("_top", F.col("_at") < F.col("level")).drop("level").withColumnRenamed("_at", "level")
    near = _box_bound(_gap, ("_qlo", "_qhi"), ("_lo", "_hi"), dims, s.metric) <= F.col("_tau")
    frontier = s.parent_join(around, pyr).where((s.eligible() > 0) & near)
    frontier = frontier.where(F.col("_is_leaf") | ~F.col("_top")).drop("_top")
    return groups, frontier.drop("_lo", "_hi", "_hist", *[f"_{e}{i}" for e in ("lo", "hi") for i in range(dims)])


def _open_dense(s: _Search, heavy: DataFrame, q: DataFrame, pyr: DataFrame, gkey: list[str]) -> DataFrame:
    """Descend into cells much denser than the querying group, per query point."""
    dims, cells = s.dims, s.cells
    points = q.select(*gkey, "_id", *_axis("_p", dims))
    rows = heavy.select(*gkey, "level", *cells, "_tau").join(points, gkey)
    child = pyr.withColumnsRenamed({"level": "_clevel", **{c: f"{c}_child" for c in cells}}).where("_clevel > 0")
    child = child.withColumn("level", F.col("_clevel") - 1)
    for c in cells:
        child = child.withColumn(c, F.expr(f"shiftright({c}_child, 1)"))
    mine = Window.partitionBy(*s.by, "_id")
    done = None
    while True:
        nxt = rows.join(child, [*s.by, "level", *cells]).where(s.eligible() > 0)
        far = _box_bound(_reach, ("_p", "_p"), ("_lo", "_hi"), dims, s.metric) * F.lit(_SLACK)
        near = _box_bound(_gap, ("_p", "_p"), ("_lo", "_hi"), dims, s.metric)
        nxt = nxt.withColumn("_near", near).withColumn(
            "_tau",
            F.least(F.col("_tau"), F.min(F.when(s.eligible() >= F.lit(s.need), far)).over(mine)),
        ).where(F.col("_near") <= F.col("_tau"))
        keep = [*gkey, "_id", *_axis("_p", dims), "_tau", "_n", "_is_leaf"]
        nxt = cut(nxt.select(*keep, F.col("_clevel").alias("level"), *[F.col(f"{c}_child").alias(c) for c in cells]))
        small = (F.col("_n") <= s.budget) | F.col("_is_leaf")
        settled = nxt.where(small).select(*gkey, "level", *cells).distinct()
        done = settled if done is None else done.unionByName(settled)
        rows = nxt.where(~small).drop("_n", "_is_leaf")
        if rows.isEmpty():
            return done.distinct()


def _to_leaves(s: _Search, cells_df: DataFrame, pyr: DataFrame, gkey: list[str], prune: bool) -> DataFrame:
    """Replace (group, cell) by (group, leaf below that cell)."""
    dims = s.dims
    leaves = pyr.where("_is_leaf").select(
        *s.by, F.col("level").alias("_lvl"), *s.cells, *[f"_{e}{i}" for e in ("lo", "hi") for i in range(dims)]
    )
    leaves = leaves.withColumnsRenamed({c: f"{c}_leaf" for c in s.cells})
    leaves = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("_lvl"))))
    for c in s.cells:
        leaves = leaves.withColumn(c, F.expr(f"shiftright({c}_leaf, _lvl - level)"))
    pairs = cells_df.join(leaves, [*s.by, "level", *s.cells])
    if prune:
        near = _box_bound(_gap, ("_qlo", "_qhi"), ("_lo", "_hi"), dims, s.metric)
        pairs = pairs.where(near <= F.col("_tau"))
    return pairs.select(*gkey, "_lvl", *[F.col(f"{c}_leaf").alias(c) for c in s.cells])


def _ranker(dims, k, exclude_self, differ, rmax, metric, by, query_id, extra, keep):
    """Rank candidates group by group over rows sorted by group, role and id."""
    limit = None if rmax is None else (rmax if metric == "linf" else rmax * rmax)

    def measure(qs: list[np.ndarray], cs: list[np.ndarray]) -> np.ndarray:
        parts = [a[:, None] - c[None, :] for a, c in zip(qs, cs)]
        if metric == "linf":
            return np.maximum.reduce([np.abs(p) for p in parts])
        total = parts[0] * parts[0]
        for p in parts[1:]:
            total += p * p
        return total

    def one_group(axes, ids, labels, lo, mid, hi):
        cs = [a[mid:hi] for a in axes]
        block = max(1, 2_000_000 // (hi - mid))
        for at in range(lo, mid, block):
            end = min(mid, at + block)
            d = measure([a[at:end] for a in axes], cs)
            if exclude_self:
                d[ids[at:end, None] == ids[None, mid:hi]] = np.inf
            if differ:
                d[labels[at:end, None] == labels[None, mid:hi]] = np.inf
            if limit is not None:
                d[d > limit] = np.inf
            kk = min(k, d.shape[1])
            kth = d.min(axis=1) if kk == 1 else np.partition(d, kk - 1, axis=1)[:, kk - 1]
            row, col = np.nonzero((d <= kth[:, None]) & np.isfinite(d))
            val = d[row, col]
            order = np.lexsort((col, val, row))  # candidates are id-sorted: ties go to the smaller id
            row, col, val = row[order], col[order], val[order]
            place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
            keep = place < k
            yield row[keep] + at, col[keep] + mid, val[keep], place[keep] + 1

    def finish(table: pa.Table, starts: np.ndarray, stops: np.ndarray):
        axes = [table.column(f"_p{i}").to_numpy() for i in range(dims)]
        ids, role = table.column("_id").to_numpy(), table.column("_role").to_numpy()
        labels = table.column("_label").to_numpy() if differ else None
        found = []
        for lo, hi in zip(starts, stops):
            mid = lo + int(np.searchsorted(role[lo:hi], 1))
            if lo < mid < hi:
                found.extend(one_group(axes, ids, labels, lo, mid, hi))
        if not found:
            return
        asked, answer, val, place = (np.concatenate(part) for part in zip(*found))
        left, right = table.take(asked), table.take(answer)
        cols = {c: left.column(c) for c in by}
        cols[query_id] = left.column("_id")
        cols["nbr_id"] = right.column("_id")
        cols["distance"] = pa.array(val if metric == "linf" else np.sqrt(val))
        cols["rank"] = pa.array(place.astype(np.int32))
        cols |= {c: right.column(c) for c in extra}
        cols |= {c: left.column(f"_keep_{c}") for c in keep}
        yield from pa.table(cols).combine_chunks().to_batches()

    def rank(batches):
        pending, key = [], None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            h1, h2 = batch.column("_h1").to_numpy(), batch.column("_h2").to_numpy()
            if key == (h1[0], h2[0]) and key == (h1[-1], h2[-1]):
                pending.append(batch)
                continue
            table = pa.Table.from_batches([*pending, batch]).combine_chunks()
            h1, h2 = table.column("_h1").to_numpy(), table.column("_h2").to_numpy()
            edge = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
            key = (h1[-1], h2[-1])
            if len(edge) == 0:
                pending = [batch] if not pending else [*pending, batch]
                continue
            yield from finish(table, np.concatenate([[0], edge[:-1]]), edge)
            pending = table.slice(int(edge[-1])).combine_chunks().to_batches()
        if pending:
            table = pa.Table.from_batches(pending).combine_chunks()
            yield from finish(table, np.array([0]), np.array([table.num_rows]))

    return rank
