"""Density clusters against brute force, and how much of them is searched."""

from __future__ import annotations

import numpy as np

from cloudloom.operators import clustering, graph


def _brute(xyz: np.ndarray, eps: float, least: int) -> list[int | None]:
    near = ((xyz[:, None] - xyz[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= least
    label: list[int | None] = [None] * len(xyz)
    for start in np.flatnonzero(core):
        stack = [start] if label[start] is None else []
        while stack:
            i = stack.pop()
            if label[i] is None:
                label[i] = int(start)
                stack += [j for j in np.flatnonzero(near[i] & core) if label[j] is None]
    for i in np.flatnonzero(~core):
        label[i] = min((label[j] for j in np.flatnonzero(near[i] & core)), default=None)
    return label


def test_dense_cells_are_not_searched(spark, monkeypatch):
    rng = np.random.default_rng(3)
    dense = rng.normal(0, 0.12, (600, 3))
    thin = rng.uniform(-1.2, 1.2, (250, 3))
    chain = np.c_[np.arange(40) * 0.09 - 1.8, np.full(40, 1.5), np.full(40, -1.5)]  # links of nearly eps, no full cell
    xyz = rng.permutation(np.concatenate([dense, thin, chain]))
    asked, search = [], clustering.k_nearest

    def counted(query, base, *args, **kw):
        asked.append(query.count())
        return search(query, base, *args, **kw)

    monkeypatch.setattr(clustering, "k_nearest", counted)
    rows = [(0, i, *map(float, p)) for i, p in enumerate(xyz)]
    points = spark.createDataFrame(rows, "scene int, center_id long, x double, y double, z double")
    got = {r["center_id"]: r["cluster"] for r in clustering.dbscan(points, 0.1, 3, ["scene"]).collect()}
    want = _brute(xyz, 0.1, 3)
    assert [got[i] for i in range(len(xyz))] == want
    assert len({c for c in want if c is not None}) > 1 and None in want
    assert sum(asked) < 1.3 * len(xyz)


def test_lone_points_look_around_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    spot = rng.normal(0, 0.01, (300, 3)) + 0.029  # most of it one cell, its points dealt over many parts
    halo = rng.normal(0, 1, (160, 3))
    halo = halo / np.linalg.norm(halo, axis=1, keepdims=True) * rng.uniform(0.05, 0.22, (160, 1)) + 0.029
    twins = np.repeat(rng.uniform(-0.6, 0.6, (30, 3)), 2, axis=0)
    xyz = rng.permutation(np.concatenate([spot, halo, twins, rng.uniform(-0.6, 0.6, (200, 3))]))
    calls, search = [], clustering.k_nearest
    monkeypatch.setattr(clustering, "_POINTS_PER_PART", 7, raising=False)
    monkeypatch.setattr(clustering, "k_nearest", lambda *args, **kw: (calls.append(1), search(*args, **kw))[1])
    rows = [(s, s * 1000 + i, *map(float, p)) for s in (0, 1) for i, p in enumerate(xyz[s::2])]
    points = spark.createDataFrame(rows, "scene int, center_id long, x double, y double, z double")
    for least in (1, 2, 4):
        calls.clear()
        got = {r["center_id"]: r["cluster"] for r in clustering.dbscan(points, 0.1, least, ["scene"]).collect()}
        assert len(calls) <= 1  # only cells that stay apart are searched, if any
        for s in (0, 1):
            want = _brute(xyz[s::2], 0.1, least)
            assert [got[s * 1000 + i] for i in range(len(want))] == [None if w is None else w + s * 1000 for w in want]


def test_components_start_from_stars(spark, monkeypatch):
    side = 24
    grid = [(i, i + 1) for i in range(side * side) if (i + 1) % side] + [(i + side, i) for i in range(side * (side - 1))]
    chain = [(1000 + i, 1001 + i) for i in range(300)]
    edges = [(k, u, v) for k in ("a", "b") for u, v in [*grid, *chain, (5, 5), (1000, 1001)]]
    rounds, keep = [], graph.cut
    monkeypatch.setattr(graph, "EDGES_PER_TASK", 500)
    monkeypatch.setattr(graph, "cut", lambda df: (rounds.append(1), keep(df))[1])
    edges = spark.createDataFrame(edges, "k string, src long, dst long")
    want = {(k, n): 0 if n < 1000 else 1000 if n < 2000 else 2000 for k in ("a", "b") for n in [*range(side * side), *range(1000, 1301), 2000]}
    nodes = spark.createDataFrame(list(want), "k string, node long")
    got = {(r["k"], r["node"]): r["component"] for r in graph.components(nodes, edges, ["k"]).collect()}
    assert got == want
    assert len(rounds) <= 5
    assert graph.components(nodes.where("node = 2000"), edges.limit(0), ["k"]).count() == 2
