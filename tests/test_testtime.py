"""Oriented normals, fragments and votes, sphere crops, merges of long chains."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import clustering, losses, orient, testtime


def forest_by_kruskal(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    taken = set()
    for w, u, v in sorted((w, u, v) for u, v, w, _ in edges):
        a, b = find(u), find(v)
        if a != b:
            root[a] = b
            taken.add((u, v))
    return taken, {n: find(n) for n in nodes}


def test_forest_and_signs(spark):
    r = random.Random(6)
    nodes = list(range(200))
    pairs = {tuple(sorted(r.sample(range(150), 2))) for _ in range(500)} | {(i, i + 1) for i in range(150, 190)}
    edges = [(u, v, r.randrange(5) / 4, r.choice((-1, 1))) for u, v in pairs]
    n = spark.createDataFrame([(0, i) for i in nodes], "scene_id int, node long")
    e = spark.createDataFrame([(0, *x) for x in edges], "scene_id int, u long, v long, w double, s int")
    state, forest = orient.spanning_forest(n, e, ["scene_id"])
    taken, comp = forest_by_kruskal(nodes, edges)
    assert {(x.u, x.v) for x in forest.collect()} == taken and forest.count() == len(taken)
    got = {x.node: (x.component, x.sign) for x in state.collect()}
    assert len(got) == len(nodes) and len({c for c, _ in got.values()}) == len(set(comp.values()))
    sign = {(u, v): s for u, v, _, s in edges}
    assert all(got[u][0] == got[v][0] and got[u][1] * got[v][1] == sign[u, v] for u, v in taken)


def test_a_sphere_points_outward(spark):
    r = np.random.default_rng(1)
    p = r.normal(size=(300, 3))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    n = p * r.choice([-1.0, 1.0], size=(300, 1))
    rows = [(0, i, *map(float, p[i]), *map(float, n[i])) for i in range(300)]
    pts = spark.createDataFrame(rows, "scene_id int, point_id long, x double, y double, z double, nx double, ny double, nz double")
    out, forest = orient.oriented(pts, ["scene_id"], 8)
    dots = [x.d for x in out.select((F.col("x") * F.col("nx") + F.col("y") * F.col("ny") + F.col("z") * F.col("nz")).alias("d")).collect()]
    assert len(dots) == 300 and min(dots) > 0.99 and forest.count() == 299


def test_fragments_cover_every_point(spark):
    rows = [("a", i, 0.1, 0.1, 0.1) for i in range(40)] + [("a", 100 + i, 1.5 + i, 0.0, -0.5) for i in range(20)] + [("b", 7, 0.0, 0.0, 0.0), ("b", 7, 0.0, 0.0, 0.0), ("b", 8, 3.0, 0.0, 0.0)]
    cover = testtime.cyclic_cover(spark.createDataFrame(rows, "scene string, point_id long, x double, y double, z double"), ["scene"], 1.0).cache()
    assert cover.count() == len(rows) and {(x.scene, x.fragments) for x in cover.collect()} == {("a", 40), ("b", 2)}
    seen = {}
    for i in range(40):
        part = testtime.fragment(cover, i).collect()
        assert len({(x.scene, x.vx, x.vy, x.vz) for x in part}) == len(part)
        for x in part:
            seen[x.scene, x.point_id, x.r] = seen.get((x.scene, x.point_id, x.r), 0) + 1
    want = {(x.scene, x.point_id, x.r): x.k for x in cover.withColumn("k", testtime.repeats()).collect()}
    assert seen == want and min(want.values()) >= 1


def test_turns_and_votes(spark):
    pts = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 0.0, 1.0, 0.0)], "point_id long, x double, y double, z double, nx double, ny double, nz double")
    got = {x.rotation: (x.x, x.y, x.z, x.nx, x.ny) for x in testtime.rotated(pts, (0.0, 0.5, 1.0, 1.5, 0.25), normal=True).collect()}
    assert got[1] == (-2.0, 1.0, 3.0, -1.0, 0.0) and got[2] == (-1.0, -2.0, 3.0, 0.0, -1.0) and got[3] == (2.0, -1.0, 3.0, 1.0, 0.0)
    assert math.isclose(got[4][0], (1 - 2) / math.sqrt(2)) and math.isclose(got[4][1], 3 / math.sqrt(2))
    rows = spark.createDataFrame([(1, [0.0, 1.0], 1), (1, [0.5, 0.0], 3), (2, [1.0, 1.0], 1)], "point_id long, logits array<double>, k int")
    out = {x.point_id: (x.pred, x.prob, x.votes) for x in testtime.vote(rows, ["point_id"], 2, weight=F.col("k")).collect()}
    p = math.exp(0) / (1 + math.e) + 3 * math.exp(0.5) / (math.exp(0.5) + 1)
    assert out[1][0] == 0 and math.isclose(out[1][1], p, abs_tol=1e-8) and out[1][2] == 4 and out[2][0] == 0


@pytest.mark.parametrize("take", [{"point_max": 1}, {"point_max": 25}, {"point_max": 10**6}, {"sample_rate": 0.3}, {"sample_rate": 0.0}])
def test_sphere_crop(spark, take):
    r = random.Random(3)
    rows = [(s, i, float(r.randrange(6)), float(r.randrange(6)), 0.0) for s in ("a", "b") for i in range(150)] + [("c", 1, 0.0, 0.0, 0.0), ("d", 5, 1e300, -1e300, 0.0), ("d", 6, 1.0, 1.0, 1.0)]
    pts = spark.createDataFrame(rows, "scene string, point_id long, x double, y double, z double")
    centre = {x.scene: (x.cx, x.cy, x.cz) for x in testtime.seeded_center(pts, ["scene"], "crop").collect()}
    want = set()
    for s, c in centre.items():
        own = sorted((sum((a - b) ** 2 if abs(a - b) < 1e150 else math.inf for a, b in zip(p[2:], c)), p[1]) for p in rows if p[0] == s)
        want |= {(s, i) for _, i in own[: take["point_max"] if "point_max" in take else math.floor(len(own) * take["sample_rate"])]}
    got = [(x.scene, x.point_id) for x in testtime.sphere_crop(pts, ["scene"], **take).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("most", [5, 12, 13, 30])
def test_sphere_crop_with_repeated_ids(spark, most):
    r = random.Random(5)
    rows = [("a", i // 9, float(r.randrange(3)), float(r.randrange(3)), 0.0) for i in range(27)] + [("b", 1, 1.0, 1.0, 1.0)] * 40
    pts = spark.createDataFrame(rows, "scene string, point_id long, x double, y double, z double")
    want = []
    for x in testtime.seeded_center(pts, ["scene"], "crop").collect():
        own = sorted((sum((a - b) ** 2 for a, b in zip(p[2:], (x.cx, x.cy, x.cz))), *p[1:]) for p in rows if p[0] == x.scene)
        want += [(x.scene, *p[1:]) for p in own[:most]]
    assert sorted(map(tuple, testtime.sphere_crop(pts, ["scene"], point_max=most).collect())) == sorted(want)


def test_center_shift(spark):
    pts = spark.createDataFrame([(0, 1, 2.0, 4.0, 5.0), (0, 2, 4.0, 8.0, 7.0)], "scene int, point_id long, x double, y double, z double")
    got = {x.point_id: (x.x, x.y, x.z) for x in testtime.center_shift(pts, ["scene"]).collect()}
    assert got == {1: (-1.0, -2.0, 0.0), 2: (1.0, 2.0, 2.0)}


def test_ordinal_pairs_are_all_pairs(spark):
    r = random.Random(9)
    rows = [(s, i, r.random() / 3, r.random() / 3, r.random() / 9, 1.0 if r.random() < 0.9 else 0.0, r.random(), r.random() - 0.5, r.random() / 5, 0.0, 0.0) for s in (0, 1) for i in range(90)]
    rows += [(2, i, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0, i / 5, 0.0, 0.0) for i in range(3)]
    df = spark.createDataFrame(rows, "scene_id int, point_id long, x double, y double, z double, valid double, support double, support_logit double, vx double, vy double, vz double")
    want = {}
    for s in (0, 1):
        own = [p for p in rows if p[0] == s and p[5] > 0.5 and p[6] > 0.1]
        found = []
        for a in range(len(own)):
            for b in range(a):
                p, q = own[a], own[b]
                if math.dist(p[2:5], q[2:5]) < 0.15 and abs(p[8] - q[8]) > 0.02:
                    near, far = (p, q) if p[8] < q[8] else (q, p)
                    prob = [1 / (1 + math.exp(-x[7])) for x in (near, far)]
                    found.append(max(0.0, 0.05 - (prob[0] - prob[1])))
        want[s] = (len(found), sum(found) / len(found))
    old = losses.BLOCK_POINTS
    try:
        for losses.BLOCK_POINTS in (old, 7):
            got = {x.scene_id: (x.pairs, x.loss) for x in losses.ordinal_pairs(df).collect()}
            assert got.keys() == want.keys() and all(got[s][0] == want[s][0] and math.isclose(got[s][1], want[s][1]) for s in want)
    finally:
        losses.BLOCK_POINTS = old


# -- merges ---------------------------------------------------------------------
def merge_one_by_one(pairs, gap):
    """Root sets of joining pairs in order unless ``gap`` of the member list says no."""
    members = {}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, j in sorted(pairs):
        a, b = find(i), find(j)
        if a == b:
            continue
        ma, mb = members.get(a, [a]), members.get(b, [b])
        if not gap(ma + mb):
            members[b] = mb + ma
            members.pop(a, None)
            root[a] = b
    return {frozenset(m) for m in members.values() if len(m) > 1}


def test_replay_gives_the_order_s_outcome():
    r = random.Random(12)
    for ahead in (1, 3, 256):
        for _ in range(60):
            pairs = {tuple(sorted(r.sample(range(12), 2))) for _ in range(r.randrange(1, 25))}
            bad = r.choice([3, 4, 5, 100])
            gap = lambda m: sum(m) % bad == 0
            known = {p: (None, None) for p in pairs}
            rounds = 0
            while True:
                found = clustering._Replay(ahead).run([(*p, *known[p]) for p in pairs])
                if not found.trials:
                    break
                rounds += 1
                for i, j, mark, both in found.trials:
                    known[i, j] = (mark, gap(both))
            assert {frozenset(m) for m in found.members.values() if len(m) > 1} == merge_one_by_one(pairs, gap)
            assert rounds <= 2 * len(pairs)


def test_a_chain_of_merges_takes_few_rounds():
    pairs = [(i, i + 1) for i in range(1000)]
    known, rounds = {p: (None, None) for p in pairs}, 0
    while True:
        found = clustering._Replay(clustering.LOOKAHEAD).run([(*p, *known[p]) for p in pairs])
        if not found.trials:
            break
        rounds += 1
        known |= {(i, j): (mark, False) for i, j, mark, _ in found.trials}
    assert rounds == 4 and len(found.members[found.find(0)]) == 1001
