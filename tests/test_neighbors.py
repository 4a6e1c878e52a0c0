"""The neighbour search against brute force, on even, skewed and duplicated clouds."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import neighbors
from cloudloom.operators.neighbors import k_nearest


def cloud(n=1500, seed=0):
    rng = np.random.default_rng(seed)
    xyz = rng.uniform(-1, 1, (n, 3))
    xyz[: n // 3] = xyz[0] + rng.normal(0, 1e-5, (n // 3, 3))  # a third of all points in one spot
    xyz[n // 3 : n // 2] = xyz[n // 3]  # and many exact copies
    return pd.DataFrame({
        "point_id": rng.permutation(n), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2],
        "segment": (xyz[:, 0] > 0).astype(int) + 2 * (xyz[:, 1] > 0.5), "scene_id": 0,
    })


def brute(pdf, k, exclude_self=False, differ=False, rmax=None):
    a = pdf.sort_values("point_id").reset_index(drop=True)
    p, lab, ids = a[["x", "y", "z"]].to_numpy(), a["segment"].to_numpy(), a["point_id"].to_numpy()
    out = {}
    for i in range(len(a)):
        d = p[i] - p
        d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
        if exclude_self:
            d2[i] = np.inf
        if differ:
            d2[lab == lab[i]] = np.inf
        if rmax is not None:
            d2[d2 > rmax * rmax] = np.inf
        order = np.argsort(d2, kind="stable")[:k]
        for r, j in enumerate(order):
            if np.isfinite(d2[j]):
                out[(ids[i], r + 1)] = ids[j]
    return out


@pytest.mark.parametrize("options", [
    dict(k=5, exclude_self=True), dict(k=2, differ="segment"), dict(k=3, exclude_self=True, rmax=0.1),
])
def test_matches_brute_force(spark, options):
    pdf = cloud()
    df = spark.createDataFrame(pdf)
    got = k_nearest(df, df, by=["scene_id"], **options).collect()
    want = brute(pdf, options["k"], options.get("exclude_self", False), "differ" in options, options.get("rmax"))
    assert {(r["point_id"], r["rank"]): r["nbr_id"] for r in got} == want


def test_no_unit_exceeds_its_bound_when_a_third_of_the_points_coincide(spark, monkeypatch):
    rng = np.random.default_rng(2)
    xyz = rng.uniform(-1, 1, (900, 3))
    xyz[:300] = xyz[0]
    pdf = pd.DataFrame(xyz, columns=list("xyz")).assign(point_id=rng.permutation(900), segment=0, scene_id=0)
    seen, ranked = [], neighbors._ranked

    def watch(q, offer, by, unit, *rest):
        seen.append(q.groupBy(*unit).count().agg({"count": "max"}).first()[0])
        return ranked(q, offer, by, unit, *rest)

    monkeypatch.setattr(neighbors, "_QUERIES_PER_TASK", 32)
    monkeypatch.setattr(neighbors, "_ranked", watch)
    df = spark.createDataFrame(pdf)
    got = k_nearest(df, df, 4, by=["scene_id"], exclude_self=True).collect()
    assert {(r["point_id"], r["rank"]): r["nbr_id"] for r in got} == brute(pdf, 4, True)
    assert max(seen) <= 64  # split by hash of the id: near 32, never the 300 that coincide


def test_two_tables_and_empty_base(spark):
    rng = np.random.default_rng(1)
    base = pd.DataFrame(rng.uniform(0, 1, (300, 3)), columns=list("xyz")).assign(point_id=range(300))
    ask = pd.DataFrame(rng.uniform(-1, 2, (200, 3)), columns=list("xyz")).assign(point_id=range(200))
    b, q = spark.createDataFrame(base), spark.createDataFrame(ask)
    got = {r["point_id"]: r["nbr_id"] for r in k_nearest(q, b, 1).collect()}
    d = ((ask[list("xyz")].to_numpy()[:, None] - base[list("xyz")].to_numpy()[None]) ** 2).sum(axis=2)
    assert got == dict(enumerate(d.argmin(axis=1)))
    assert k_nearest(q, b.limit(0), 1).count() == 0


def test_first_frontier_lists_cells_once_inside_the_grid_and_in_tasks_cut_by_groups(spark, monkeypatch):
    df = spark.createDataFrame(cloud(1200, 4))
    seen, join = [], neighbors._Search.parent_join

    def watch(self, rows, pyr):
        cells = rows.select(*[c for c in rows.columns if c.startswith("_g") or c in ("scene_id", "_qlabel", "level", *self.cells)])
        seen.append((rows.rdd.getNumPartitions(), cells.collect(), self.cells))
        return join(self, rows, pyr)

    monkeypatch.setattr(neighbors, "_GROUPS_PER_TASK", 8, raising=False)
    monkeypatch.setattr(neighbors._Search, "parent_join", watch)
    k_nearest(df, df, 1, by=["scene_id"], differ="segment").collect()
    (tasks, rows, cells), = seen
    assert len(rows) == len(set(rows))
    assert all(0 <= r[c] < 2 ** r["level"] for r in rows for c in cells)
    groups = {tuple(r[c] for c in r.asDict() if c not in ("level", *cells)) for r in rows}
    assert len(groups) > 16 and tasks == -(-len(groups) // 8)


def test_small_groups_are_not_cut_finer_because_there_are_many(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(0, 1, (10000, 3)), columns=list("xyz")).assign(point_id=range(10000))
    pdf["cluster_id"] = pdf["point_id"] // 25
    seen, first = [], neighbors._first_frontier
    monkeypatch.setattr(neighbors, "_first_frontier", lambda *a: seen.append(a[5]) or first(*a))
    df = spark.createDataFrame(pdf)
    got = {r["point_id"]: r["nbr_id"] for r in k_nearest(df, df, 1, by=["cluster_id"], exclude_self=True).collect()}
    assert seen == [0]
    p = pdf[list("xyz")].to_numpy().reshape(400, 25, 3)
    d = ((p[:, :, None] - p[:, None]) ** 2).sum(axis=3) + np.where(np.eye(25), np.inf, 0.0)
    assert got == dict(enumerate((d.argmin(axis=2) + 25 * np.arange(400)[:, None]).ravel()))


def test_candidates_are_joined_in_tasks_cut_by_rows(spark, monkeypatch):
    seen, ranked = [], neighbors._ranked

    def kept(q, offer, *args):
        seen.append(offer)
        return ranked(q, offer, *args)

    monkeypatch.setattr(neighbors, "_ranked", kept)
    monkeypatch.setattr(neighbors, "_OFFERS_PER_TASK", 4000, raising=False)
    xyz = np.random.default_rng(5).uniform(0, 1, (3000, 3))
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "point_id long, x double, y double, z double")
    got = {r["point_id"]: r["nbr_id"] for r in k_nearest(points, points, 1, exclude_self=True).collect()}
    d = ((xyz[:, None] - xyz[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    assert [got[i] for i in range(len(xyz))] == d.argmin(1).tolist()
    rows = [r["count"] for r in seen[0].groupBy(F.spark_partition_id()).count().collect()]
    assert sum(rows) > 40_000 and max(rows) < sum(rows) / 4
