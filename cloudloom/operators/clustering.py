"""Boundary-centre clustering: density clusters, direction groups, lateral splits, merge, rescue."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudloom.functions import geometry as g
from cloudloom.operators.axes import group_axes, largest_gap, mean_tangent
from cloudloom.operators.density import spacing as scene_spacing
from cloudloom.operators.graph import components
from cloudloom.operators.neighbors import k_nearest
from cloudloom.operators.pairs import radius_pairs
from cloudloom.operators.splits import split_recursively
from cloudloom.session import cut


@dataclass(frozen=True)
class ClusterConfig:
    """Default thresholds, all scales relative to the median spacing."""

    micro_eps_scale: float = 3.5
    micro_min_samples: int = 3
    split_lateral_scale: float = 5.0
    merge_radius_scale: float = 8.0
    merge_angle_deg: float = 45.0
    merge_lateral_scale: float = 5.0
    rescue_radius_scale: float = 10.0
    min_cluster_points: int = 4

    @property
    def cos_th(self) -> float:
        return math.cos(math.radians(self.merge_angle_deg))


_CELLS, _BLOCKS = ["_c0", "_c1", "_c2"], ["_b0", "_b1", "_b2"]
_POINTS_PER_PART = 2048  # points of one cell that one task compares


def _in_block(rows: DataFrame, cells: Sequence[str] = _CELLS) -> DataFrame:
    """Blocks are 4 x 4 x 4 cells, over twice eps wide, so what lies within eps lies in eight of them at most."""
    return rows.withColumns({b: F.shiftright(c, 2) for b, c in zip(_BLOCKS, cells)})


def _to_blocks(rows: DataFrame, first: Sequence[Column], last: Sequence[Column]) -> DataFrame:
    """A row for every block from cell ``first`` to cell ``last``."""
    for b, lo, hi in zip(_BLOCKS, first, last):
        rows = rows.withColumn(b, F.explode(F.sequence(F.shiftright(lo, 2), F.shiftright(hi, 2))))
    return rows


def _square(v: Sequence[Column]) -> Column:
    return g.dot(tuple(v), tuple(v))


def _lone_hits(lone: DataFrame, crowd: DataFrame, dense: DataFrame, eps: float, side: float, least: int, by: list[str], ident: str) -> DataFrame:
    """What lies within eps of the points of cells that are not crowded: by..., ident, cells, ``_nbr``, ``_k``.

    One row a lone neighbour (``_nbr``, the point itself among them) and one a crowded cell with ``_k`` points in reach,
    so a point has some hundred rows at most.  A cell's box shows whether all or none of its points are in reach; points
    of a crowded cell are looked at only where neither holds and the others do not make ``least`` yet.
    """
    cells, at = _CELLS, [f"_q{a}" for a in "xyz"]
    asked = lone.select(*by, ident, *[F.col(a).alias(q) for a, q in zip("xyz", at)])
    reach = eps * (1 + 1e-9)
    asked = _to_blocks(asked, *[[F.floor((F.col(q) + F.lit(r)) / F.lit(side)) for q in at] for r in (-reach, reach)])
    single = lone.select(*by, *cells, F.col(ident).alias("_nbr"), F.lit(1).cast("long").alias("_k"), *[F.col(a).alias(f"_{e}{a}") for e in ("lo", "hi") for a in "xyz"])
    near = asked.join(_in_block(single.unionByName(crowd, allowMissingColumns=True)), [*by, *_BLOCKS])
    gap = [F.greatest(F.col(f"_lo{a}") - F.col(q), F.col(q) - F.col(f"_hi{a}"), F.lit(0.0)) for a, q in zip("xyz", at)]
    far = [F.greatest(F.col(f"_hi{a}") - F.col(q), F.col(q) - F.col(f"_lo{a}")) for a, q in zip("xyz", at)]
    near = cut(near.where(_square(gap) <= eps * eps).select(*by, ident, *at, *cells, "_nbr", "_k", (_square(far) <= eps * eps).alias("_all")))
    few = near.groupBy(*by, ident).agg(F.coalesce(F.sum(F.when(F.col("_all"), F.col("_k"))), F.lit(0)).alias("_sure")).where(F.col("_sure") < least)
    # a crowded cell meets a bounded number of lone points; its own points are dealt over parts
    unsure = near.where("NOT _all").join(few.drop("_sure"), [*by, ident], "left_semi")
    unsure = unsure.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), _parts("_k") - 1))).drop("_nbr", "_k", "_all")
    seen = unsure.join(dense, [*by, *cells, "_part"]).where(_square([F.col(a) - F.col(q) for a, q in zip("xyz", at)]) <= eps * eps)
    seen = seen.groupBy(*by, ident, *cells).agg(F.count("*").alias("_k"))
    hits = near.where("_all").select(*by, ident, *cells, "_nbr", "_k")
    return cut(hits.unionByName(seen, allowMissingColumns=True))


def _parts(count: str) -> Column:
    return F.ceil(F.col(count) / F.lit(_POINTS_PER_PART))


def dbscan(points: DataFrame, eps: float, min_samples: int, by: Sequence[str], ident: str = "center_id") -> DataFrame:
    """Density clusters; ``cluster`` is the smallest core id, NULL for noise.

    Two points of one cell of edge eps/sqrt(3) are always within eps, so all
    points of a cell that holds ``min_samples`` are core and only the others look
    around, once, at boxes of cells first.  The core points of a cell are linked by a star, and one link per
    pair of neighbouring cells is needed at most: first those that the boxes or
    the cells' smallest ids show, then a search between what these leave apart.
    A cell's core points share their cluster, so borders read it off the cells
    in reach.  Neighbour lists of core points are never materialised.
    """
    by, cells = list(by), _CELLS
    side = eps / math.sqrt(3.0) * (1 - 1e-9)
    pts = points.select(*by, ident, *[F.col(a).cast("double").alias(a) for a in "xyz"])
    pts = cut(pts.withColumns({c: F.floor(F.col(a) / F.lit(side)) for c, a in zip(cells, "xyz")}))
    extent = [*[F.min(a).alias(f"_lo{a}") for a in "xyz"], *[F.max(a).alias(f"_hi{a}") for a in "xyz"]]
    crowd = cut(pts.groupBy(*by, *cells).agg(F.count("*").alias("_k"), *extent).where(F.col("_k") >= min_samples))
    lone = cut(pts.join(crowd, [*by, *cells], "left_anti"))
    dense = pts.join(crowd.select(*by, *cells, _parts("_k").alias("_part")), [*by, *cells])
    dense = dense.select(*by, *cells, F.pmod(F.xxhash64(ident), "_part").alias("_part"), "x", "y", "z")
    hits = _lone_hits(lone, crowd, dense, eps, side, min_samples, by, ident)
    core_ids = cut(hits.groupBy(*by, ident).agg(F.sum("_k").alias("_k")).where(F.col("_k") >= min_samples).select(*by, ident))
    core = cut(pts.join(crowd, [*by, *cells], "left_semi").unionByName(lone.join(core_ids, [*by, ident], "left_semi")))
    box = core.groupBy(*by, *cells).agg(F.min(F.struct(ident, *"xyz")).alias("_first"), *extent)
    box = cut(box.select(*by, *cells, F.col(f"_first.{ident}").alias("node"), *[F.col(f"_first.{a}").alias(f"_p{a}") for a in "xyz"], *[f"_{e}{a}" for e in ("lo", "hi") for a in "xyz"]))
    sides = [f"_{e}{a}" for e in ("lo", "hi", "p") for a in "xyz"]
    other = box.withColumnsRenamed({c: f"{c}o" for c in cells} | {"node": "dst"} | {c: f"{c}o" for c in sides})
    around = _to_blocks(box, [F.col(c) - 2 for c in cells], [F.col(c) + 2 for c in cells])
    pair = around.join(_in_block(other, [f"{c}o" for c in cells]), [*by, *_BLOCKS]).where("node < dst").drop(*_BLOCKS)
    gap = [F.greatest(F.col(f"_lo{a}") - F.col(f"_hi{a}o"), F.col(f"_lo{a}o") - F.col(f"_hi{a}"), F.lit(0.0)) for a in "xyz"]
    far = [F.greatest(F.col(f"_hi{a}o") - F.col(f"_lo{a}"), F.col(f"_hi{a}") - F.col(f"_lo{a}o")) for a in "xyz"]
    step = tuple(F.col(f"_p{a}") - F.col(f"_p{a}o") for a in "xyz")
    linked = (g.norm(tuple(far)) <= eps) | (g.dot(step, step) <= eps * eps)
    pair = pair.where(g.norm(tuple(gap)) <= eps).withColumn("_linked", linked).drop(*[f"_p{a}{t}" for a in "xyz" for t in ("", "o")])
    pair = cut(pair)
    comp = cut(components(box.select(*by, "node"), pair.where("_linked").select(*by, F.col("node").alias("src"), "dst"), by))
    # cells still apart: does any core point of one find a core point of the other within eps?
    ends = [comp.select(*by, F.col("node").alias(n), F.col("component").alias(c)) for n, c in (("node", "_ci"), ("dst", "_cj"))]
    link = cut(pair.where("NOT _linked").join(ends[0], [*by, "node"]).join(ends[1], [*by, "dst"]).where("_ci <> _cj"))
    if not link.isEmpty():
        slack = eps * (1 + 1e-9)

        def reaching(rows: DataFrame, t: str) -> DataFrame:
            """Rows whose point lies within eps of the pair's other box."""
            return rows.where(g.norm(tuple(F.greatest(F.col(f"_lo{a}{t}") - F.col(a), F.col(a) - F.col(f"_hi{a}{t}"), F.lit(0.0)) for a in "xyz")) <= slack)

        ask = reaching(link.join(core, [*by, *cells]), "o").select(*by, F.col("dst").alias("_target"), ident, "x", "y", "z", "_ci", "_cj")
        offer = link.drop(*cells).withColumnsRenamed({f"{c}o": c for c in cells}).join(core, [*by, *cells])
        offer = reaching(offer, "").select(*by, F.col("dst").alias("_target"), ident, "x", "y", "z").distinct()
        hit = k_nearest(ask, offer, 1, by=[*by, "_target"], query_id=ident, base_id=ident, rmax=eps, keep=["_ci", "_cj"])
        whole = components(comp.select(*by, F.col("component").alias("node")).distinct(), hit.select(*by, F.col("_ci").alias("src"), F.col("_cj").alias("dst")).distinct(), by)
        comp = comp.join(whole.select(*by, F.col("node").alias("component"), F.col("component").alias("_to")), [*by, "component"]).select(*by, "node", F.col("_to").alias("component"))
    cell = cut(box.select(*by, *cells, "node").join(comp, [*by, "node"]).select(*by, *cells, F.col("component").alias("cluster")))
    inside = core.join(cell, [*by, *cells]).select(*by, ident, "cluster")
    # a point that is not core takes the smallest cluster of the crowded cells and lone core points in its reach
    reach = hits.join(core_ids, [*by, ident], "left_anti")
    reach = reach.where("_nbr IS NULL").unionByName(reach.join(core_ids.withColumnRenamed(ident, "_nbr"), [*by, "_nbr"], "left_semi").select(*reach.columns))
    border = reach.join(cell, [*by, *cells]).groupBy(*by, ident).agg(F.min("cluster").alias("cluster"))
    return points.join(inside.unionByName(border), [*by, ident], "left")


def tangent_groups(points: DataFrame, keys: Sequence[str], cos_th: float, order: str = "center_id", out: str = "dir_group") -> DataFrame:
    """Greedy sign-free direction groups in id order.

    The result depends on the order by definition.  Rows stream through the
    task sorted by group and id; the only state is one vector per direction, so
    a group of any size runs in constant memory.
    """
    h1, h2 = F.xxhash64(*keys), F.xxhash64(F.lit(17), *keys)
    rows = points.withColumns({"_h1": h1, "_h2": h2}).repartition("_h1", "_h2").sortWithinPartitions("_h1", "_h2", order)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.IntegerType())])

    def run(batches):
        key, state = None, _Directions(cos_th)
        for batch in batches:
            h = np.stack([batch.column("_h1").to_numpy(), batch.column("_h2").to_numpy()], axis=1)
            t = np.stack([batch.column(f"t{a}").to_numpy() for a in "xyz"], axis=1)
            t = t / np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-8)
            label = np.empty(len(t), dtype=np.int32)
            for i in range(len(t)):
                if key is None or h[i, 0] != key[0] or h[i, 1] != key[1]:
                    key, state = (h[i, 0], h[i, 1]), _Directions(cos_th)
                label[i] = state.place(t[i])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label)], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, schema).drop("_h1", "_h2")


class _Directions:
    """Running representatives of the direction groups seen so far."""

    def __init__(self, cos_th: float):
        self.cos_th, self.total = cos_th, np.empty((0, 3))

    def place(self, t: np.ndarray) -> int:
        if len(self.total):
            size = np.linalg.norm(self.total, axis=1)
            cos = (self.total @ t) / np.where(size < 1e-8, np.inf, size)
            best = int(np.abs(cos).argmax())
            if abs(cos[best]) >= self.cos_th:
                self.total[best] += t if cos[best] >= 0 else -t
                return best
        self.total = np.vstack([self.total, t])
        return len(self.total) - 1


def lateral_gaps(points: DataFrame, keys: Sequence[str], threshold: float, min_points: int, order: str = "center_id"):
    """Groups with a lateral gap: (ids with ``_lat``, cuts).

    The lateral axis is the main axis of the offsets across the mean tangent.  The
    offsets are read four times, so ids and offsets are checkpointed.
    """
    keys = list(keys)
    stats = points.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.avg(a).alias(f"_m{a}") for a in "xyz"])
    stats = stats.where(F.col("_n") >= 2 * min_points).join(mean_tangent(points, keys, order), keys)
    stats = stats.where(g.norm(g.vec("mt")) > 0.5)
    rows = points.join(stats, keys)
    off = tuple(F.col(a) - F.col(f"_m{a}") for a in "xyz")
    along = g.dot(off, g.vec("mt"))
    rows = cut(rows.select(*keys, order, *[(off[i] - along * F.col(f"mt{a}")).alias(f"_l{a}") for i, a in enumerate("xyz")]))
    wide = rows.groupBy(*keys).agg(F.max(g.norm(g.vec("_l"))).alias("_wide")).where(F.col("_wide") >= threshold).select(*keys)
    rows = rows.join(wide, keys)
    axis = group_axes(rows, keys, ("_lx", "_ly", "_lz")).select(*keys, "ax", "ay", "az")
    rows = rows.join(axis, keys).withColumn("_lat", g.dot(g.vec("_l"), g.vec("a")))
    return rows, largest_gap(rows, keys, "_lat", F.lit(float(threshold)))


def lateral_split(points: DataFrame, keys: Sequence[str], threshold: float, min_points: int, order: str = "center_id") -> DataFrame:
    """Adds ``path``: the turns of splitting each group at lateral gaps; NULL for fragments below ``min_points``."""
    def distributed(rows: DataFrame, key: list[str]) -> DataFrame:
        rows, cuts = lateral_gaps(rows, key, threshold, min_points, order)
        return rows.join(cuts, key).select(*key, order, (F.col("_lat") < F.col("cut")).alias("_left"))

    return split_recursively(points, keys, order, min_points, distributed)


def split_parallel(micro: DataFrame, by: Sequence[str], spacing: float, cfg: ClusterConfig) -> DataFrame:
    """Breaks density clusters that hold parallel edges; re-keys ``cluster`` to the fragment's smallest id."""
    by = list(by)
    clustered = micro.where(F.col("cluster").isNotNull())
    big = clustered.groupBy(*by, "cluster").agg(F.count("*").alias("_n")).where(F.col("_n") >= 2 * cfg.min_cluster_points)
    grouped = cut(tangent_groups(clustered.join(big.drop("_n"), [*by, "cluster"]), [*by, "cluster"], cfg.cos_th))
    parts = lateral_split(grouped, [*by, "cluster", "dir_group"], cfg.split_lateral_scale * spacing, cfg.min_cluster_points)
    # a cluster changes only if one of its direction groups leaves two fragments or more
    left = parts.groupBy(*by, "cluster", "dir_group").agg(F.count_distinct("path").alias("_f"))
    split = left.where("_f >= 2").select(*by, "cluster").distinct()
    frag = parts.join(split, [*by, "cluster"])
    sizes = frag.where(F.col("path").isNotNull()).groupBy(*by, "cluster", "dir_group", "path").agg(F.count("*").alias("_k"), F.min("center_id").alias("_id"))
    frag = frag.join(sizes, [*by, "cluster", "dir_group", "path"], "left")
    moved = frag.select(*by, "center_id", F.when(F.col("_k") >= cfg.min_cluster_points, F.col("_id")).alias("_new"), F.lit(True).alias("_hit"))
    out = micro.join(moved, [*by, "center_id"], "left")
    return out.withColumn("cluster", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("cluster"))).drop("_hit", "_new")


def merge_candidates(micro: DataFrame, by: Sequence[str], spacing: float, cfg: ClusterConfig) -> DataFrame:
    """Pairs i < j of clusters close enough, aligned and not laterally offset."""
    by = list(by)
    mt = mean_tangent(micro, [*by, "cluster"], "center_id")
    cen = micro.groupBy(*by, "cluster").agg(*[F.avg(a).alias(a) for a in "xyz"]).join(mt, [*by, "cluster"])
    near = radius_pairs(cen, cfg.merge_radius_scale * spacing, by, "cluster", carry=["mtx", "mty", "mtz"])
    a, b = (tuple(F.col(f"mt{c}_{t}") for c in "xyz") for t in "ij")
    total = g.add(a, b)
    near = near.where((F.abs(g.dot(a, b)) >= cfg.cos_th) & (g.norm(total) >= 1e-9))
    unit = g.unit_or_zero(total, 1e-9)
    diff = tuple(F.col(f"{c}_j") - F.col(f"{c}_i") for c in "xyz")
    along = g.dot(diff, unit)
    lateral = F.sqrt(F.greatest(g.dot(diff, diff) - along * along, F.lit(0.0)))
    return near.where(lateral <= cfg.merge_lateral_scale * spacing).select(*by, "cluster_i", "cluster_j")


#: Trials of one component that are looked ahead in a round.
LOOKAHEAD = 256


class _Replay:
    """The one-by-one merge of one key's candidates, with the outcomes known so far.

    A candidate whose trial is not known yet is taken for good, and its trial is put down to be looked at.  What was
    found counts only for the very list of members it was found for, so a trial that rested on a merge that failed is
    looked at again.
    """

    def __init__(self, ahead: int):
        self.ahead, self.members, self.root = ahead, {}, {}
        self.trials: list[tuple[int, int, int, list[int]]] = []

    def find(self, x: int) -> int:
        while self.root.setdefault(x, x) != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def union(self, i: int, j: int) -> None:
        ri, rj = self.find(i), self.find(j)
        self.members[rj] = self.members.get(rj, [rj]) + self.members.pop(ri, [ri])
        self.root[ri] = rj

    def run(self, rows: list[tuple[int, int, int | None, bool | None]]) -> "_Replay":
        """``rows``: (cluster_i, cluster_j, mark of the members looked at, whether they show a gap)."""
        rows = sorted(rows, key=lambda r: r[:2])
        whole = _Replay(0)
        for i, j, _, _ in rows:
            if whole.find(i) != whole.find(j):
                whole.union(i, j)
        looked: dict[int, int] = {}
        for i, j, mark, gap in rows:
            ri, rj = self.find(i), self.find(j)
            if ri == rj:
                continue
            part = whole.find(i)
            if looked.get(part, 0) > self.ahead:
                continue
            both = self.members.get(ri, [ri]) + self.members.get(rj, [rj])
            now = int.from_bytes(hashlib.blake2b(np.array(both, np.int64).tobytes(), digest_size=8).digest(), "little", signed=True)
            if mark is not None and mark == now:
                if gap:
                    continue
            else:
                looked[part] = looked.get(part, 0) + 1
                if looked[part] > self.ahead:
                    continue
                self.trials.append((i, j, now, both))
            self.union(i, j)
        return self


def merge(micro: DataFrame, by: Sequence[str], spacing: float, cfg: ClusterConfig, ahead: int = LOOKAHEAD) -> DataFrame:
    """Joins candidate pairs in id order unless the union would show a lateral gap.

    A candidate's trial looks at all members that its two sides have gathered by then, so the outcome depends on the
    order by definition.  A round replays the order on cluster ids alone, taking unknown trials for good, and looks at
    all unknown trials together, up to ``ahead`` of each connected set of clusters.  A round settles every trial that
    rests on no failed merge, so a chain of n merges takes n / ``ahead`` rounds and one more for each failure that
    others rest on.  Members stand in the order in which the unions list them, each cluster's by id.
    """
    by = list(by)
    micro = cut(micro)
    pair = ["cluster_i", "cluster_j"]
    todo = merge_candidates(micro.where(F.col("cluster").isNotNull()), by, spacing, cfg).select(*by, *pair)
    todo = cut(todo.withColumns({"mark": F.lit(None).cast("long"), "gap": F.lit(None).cast("boolean")}))
    if todo.isEmpty():
        return micro
    ids = T.StructType([todo.schema[c] for c in by])
    touched = todo.select(*by, F.explode(F.array(*pair)).alias("cluster")).distinct()
    rows = cut(micro.join(touched, [*by, "cluster"]).select(*by, "cluster", "center_id", "x", "y", "z", "tx", "ty", "tz"))
    threshold = cfg.split_lateral_scale * spacing

    def replay(table: pa.Table) -> _Replay:
        return _Replay(ahead).run(list(zip(*(table.column(c).to_pylist() for c in (*pair, "mark", "gap")))))

    def keyed(key: tuple, n: int) -> dict:
        return {c: pa.array([k.as_py()] * n, k.type) for c, k in zip(by, key)}

    def plan(key: tuple, table: pa.Table) -> pa.Table:
        t = replay(table).trials
        return pa.table({**keyed(key, len(t)), "cluster_i": pa.array([x[0] for x in t], pa.int64()), "cluster_j": pa.array([x[1] for x in t], pa.int64()),
                         "mark": pa.array([x[2] for x in t], pa.int64()), "members": pa.array([x[3] for x in t], pa.list_(pa.int64()))})

    def roots(key: tuple, table: pa.Table) -> pa.Table:
        r = replay(table)
        sets = [m for m in r.members.values() if len(m) > 1]
        flat = [(c, min(m)) for m in sets for c in m]
        return pa.table({**keyed(key, len(flat)), "cluster": pa.array([c for c, _ in flat], pa.int64()), "root": pa.array([c for _, c in flat], pa.int64())})

    long = T.LongType()
    planned = T.StructType([*ids, *[T.StructField(c, long) for c in (*pair, "mark")], T.StructField("members", T.ArrayType(long))])
    rooted = T.StructType([*ids, T.StructField("cluster", long), T.StructField("root", long)])
    key = [*by, *pair]
    while True:
        trials = cut(todo.groupBy(*by).applyInArrow(plan, planned))
        if trials.isEmpty():
            break
        members = trials.select(*key, F.posexplode("members").alias("_at", "cluster")).join(rows, [*by, "cluster"])
        members = cut(members.withColumn("_order", F.struct("_at", "center_id")).drop("_at", "cluster", "center_id"))
        grouped = tangent_groups(members, key, cfg.cos_th, "_order")
        _, cuts = lateral_gaps(grouped, [*key, "dir_group"], threshold, cfg.min_cluster_points, "_order")
        bad = cuts.select(*key).distinct().withColumn("_bad", F.lit(True))
        seen = trials.join(bad, key, "left").select(*key, F.col("mark").alias("_mark"), F.coalesce("_bad", F.lit(False)).alias("_gap"))
        todo = todo.join(seen, key, "left").select(*key, F.coalesce("_mark", "mark").alias("mark"), F.when(F.col("_mark").isNotNull(), F.col("_gap")).otherwise(F.col("gap")).alias("gap"))
        todo = cut(todo)
    root = todo.groupBy(*by).applyInArrow(roots, rooted)
    out = micro.join(root, [*by, "cluster"], "left")
    return out.withColumn("cluster", F.coalesce("root", "cluster")).drop("root")


def rescue(labelled: DataFrame, by: Sequence[str], radius: float) -> DataFrame:
    """Noise joins the cluster of its nearest clustered centre within ``radius``."""
    by = list(by)
    pts = labelled.select(*by, "center_id", "x", "y", "z", "cluster")
    near = k_nearest(
        pts.where(F.col("cluster").isNull()), pts.where(F.col("cluster").isNotNull()), 1,
        by=by, query_id="center_id", base_id="center_id", rmax=radius, carry=["cluster"],
    )
    got = near.select(*by, "center_id", F.col("nbr_cluster").alias("_to"))
    out = labelled.join(got, [*by, "center_id"], "left")
    return out.withColumn("rescued", F.col("_to").isNotNull()).withColumn("cluster", F.coalesce("cluster", "_to")).drop("_to")


def cluster_centers(centers: DataFrame, scene: Sequence[str] = ("scene_id",), cfg: ClusterConfig = ClusterConfig(), spacing: float | None = None) -> DataFrame:
    """Full stage: centres with ``cluster`` (smallest member id at founding) or NULL.

    ``centers``: scene, center_id, label_a, label_b, x, y, z, tx, ty, tz.  All
    thresholds are multiples of the scene's own spacing (the median distance of
    its centres to their nearest centre, 0.01 for a lone centre), so coordinates are
    measured in spacings while clustering and a scene's result does not depend
    on the others.  ``spacing`` sets one value for all scenes.
    """
    by = [*scene, "label_a", "label_b"]
    if spacing is None:
        unit = scene_spacing(centers, scene, 1, ident="center_id")
        placed = centers.join(unit, list(scene))
    else:
        placed = centers.withColumn("spacing", F.lit(float(spacing)))
    step = F.greatest("spacing", F.lit(1e-9))
    placed = placed.withColumns({f"_o{a}": F.col(a) for a in "xyz"})
    placed = cut(placed.withColumns({a: F.col(f"_o{a}") / step for a in "xyz"}).drop("spacing"))
    micro = cut(dbscan(placed, cfg.micro_eps_scale, cfg.micro_min_samples, by))
    split = cut(split_parallel(micro, by, 1.0, cfg))
    merged = cut(merge(split, by, 1.0, cfg))
    whole = rescue(merged, by, cfg.rescue_radius_scale)
    big = whole.where(F.col("cluster").isNotNull()).groupBy(*by, "cluster").agg(F.count("*").alias("_n"))
    keep = big.where(F.col("_n") >= cfg.min_cluster_points).select(*by, "cluster", F.lit(True).alias("_ok"))
    out = whole.join(keep, [*by, "cluster"], "left")
    out = out.withColumn("cluster", F.when(F.col("_ok"), F.col("cluster"))).drop("_ok", *"xyz")
    return out.withColumnsRenamed({f"_o{a}": a for a in "xyz"})


def cluster_records(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Size, centroid and mean confidence per cluster."""
    return members.groupBy(*keys).agg(
        F.count("*").alias("size"), *[F.avg(a).alias(f"c{a}") for a in "xyz"], F.avg("confidence").alias("confidence")
    )
