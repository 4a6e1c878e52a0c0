"""Hand-made fixtures for the operators, and metamorphic checks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cloudloom.functions import grid
from cloudloom.operators import boundary, chunking, clustering, denoise, losses, metrics, stats, supervise, supports, validation, voxel
from cloudloom.operators.graph import components
from cloudloom.operators.prefix import totals_above


def points(spark, rows, cols="x y z c"):
    return spark.createDataFrame(rows, cols.split())


def test_vote_tie_goes_to_smallest_class(spark):
    for a, b in ((3, 5), (5, 3)):
        df = points(spark, [(0.005, 0.005, 0.005, a), (0.015, 0.015, 0.015, b)])
        got = voxel.majority_vote(df, 0.04, keys=()).collect()
        assert len(got) == 1 and got[0]["winner"] == 3 and got[0]["n"] == 2


def test_void_is_dropped_after_the_vote(spark):
    rows = [(0.001, 0.0, 0.0, c) for c in (0, 0, 1)] + [(1.001, 1.001, 1.001, c) for c in (0, 1, 1)]
    v = voxel.majority_vote(points(spark, rows), 0.04, keys=())
    assert v.count() == 2
    kept = voxel.drop_void(v).collect()
    assert [r["segment"] for r in kept] == [0]


def test_histogram_has_every_class(spark):
    h = voxel.zero_filled_histogram(points(spark, [(0.0, 0.0, 0.0, 3)]), F.col("c"), 17, [])
    assert {r["class_id"]: r["n"] for r in h.collect()} == {i: int(i == 3) for i in range(17)}


def test_tile_grid_of_twelve_metres(spark):
    box = spark.createDataFrame([(0.0, 0.0, 0.0, 12.0, 12.0, 8.0)], ["x_min", "y_min", "z_min", "x_max", "y_max", "z_max"])
    tiles = chunking.tile_grid(box, 4.0, 2.0, []).orderBy("chunk_idx").collect()
    assert [t["chunk_idx"] for t in tiles] == list(range(25))
    assert [(t["x_tile"], t["y_tile"]) for t in tiles[:6]] == [(0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (1, 0)]
    assert sorted({(t["x_lo"], t["x_hi"]) for t in tiles}) == [(0, 4), (2, 6), (4, 8), (6, 10), (8, 12)]


def test_mask_and_weights_by_hand(spark):
    rows = [(0, 0.0, 0.0, 0.0, 0), (1, 0.05, 0.0, 0.0, 1), (2, 0.2, 0.0, 0.0, 1)]
    df = points(spark, rows, "point_id x y z segment").withColumn("scene_id", F.lit(0))
    mask = {r["point_id"]: r["boundary_mask"] for r in boundary.radius_mask(df, 0.06, ["scene_id"]).collect()}
    assert mask == {0: True, 1: True, 2: False}
    near = {r["point_id"]: round(r["other_dist"], 6) for r in boundary.nearest_other_class(df, ["scene_id"]).collect()}
    assert near == {0: 0.05, 1: 0.05, 2: 0.2}
    w = {r["point_id"]: r["s_weight"] for r in boundary.support_weight(df, ["scene_id"]).collect()}
    assert w == {0: 1.0, 1: 1.0, 2: 0.0}


def test_two_ious(spark):
    df = spark.createDataFrame([(0, 0, 0), (0, 0, 1), (0, 1, 1), (0, -1, 1)], ["scene_id", "truth", "pred"])
    conf = metrics.confusion(df, ["scene_id"])
    def iou(ignore):
        rows = metrics.class_counts(conf, ["scene_id"], 2, ignore).orderBy("class_id").collect()
        return [r["intersection"] / r["union_n"] for r in rows]

    assert iou(None) == [1 / 2, 1 / 3]
    assert iou(-1) == [1 / 2, 1 / 2]


def test_supervision_by_hand(spark):
    pts = points(spark, [(0, 0.5, 0.03, 0.0, 1), (1, 2.0, 0.0, 0.0, 1), (2, 0.5, 0.09, 0.0, 1)], "point_id x y z segment")
    sup = spark.createDataFrame([(7, 1, 2)], ["support_id", "label_a", "label_b"])
    seg = spark.createDataFrame([(7, 0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0)], "support_id int, seg int, ax double, ay double, az double, bx double, by double, bz double")
    got = {r["point_id"]: r for r in supervise.supervise(pts, sup, seg).collect()}
    assert [got[i]["valid"] for i in range(3)] == [True, False, False]
    assert round(got[0]["vec_y"], 6) == -0.03 and round(got[0]["support"], 4) == 0.3247
    assert got[1]["support_id"] == -1 and got[1]["dist"] == float("inf")


def test_components(spark):
    rng = np.random.default_rng(0)
    # a long chain, a short one, hubs below, above and between their neighbours, a dense part
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 101 + i) for i in range(10)] + [(200, int(v)) for v in rng.integers(201, 260, 80)]
    edges += [(300, v) for v in range(301, 800)] + [(1900, v) for v in range(1000, 1900)] + [(2500, v) for v in range(2000, 3000)]
    edges += [(int(a), int(b)) for a, b in rng.integers(3000, 3100, (150, 2))]
    want = {v: v for e in edges for v in e} | {999: 999}

    def root(v):
        while want[v] != v:
            v = want[v]
        return v

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        want[b] = a
    nodes = spark.createDataFrame([(i,) for i in sorted(want)], ["node"])
    got = {r["node"]: r["component"] for r in components(nodes, spark.createDataFrame(edges, ["src", "dst"])).collect()}
    assert got == {v: root(v) for v in want}
    assert components(nodes, spark.createDataFrame([], "src long, dst long")).where("node <> component").isEmpty()


def test_raster_components(spark):
    cells = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "gx int, gy int")
    got = {(r["gx"], r["gy"]): r["label"] for r in chunking.facade_components(cells, []).collect()}
    assert got == {(0, 0): 1, (1, 1): 2, (2, 1): 2}


def line_cluster(spark):
    t = np.arange(60) * 0.01
    rows = [(i, float(v + (0.5 if i >= 30 else 0.0)), 0.001 * (i % 3), 0.0, 1.0, 0.0, 0.0) for i, v in enumerate(t)]
    return points(spark, rows, "center_id x y z tx ty tz").withColumn("cluster_id", F.lit(0))


def test_gap_split(spark):
    got = {r["center_id"]: r["path"] for r in supports.gap_split(line_cluster(spark), ["cluster_id"]).collect()}
    assert set(got.values()) == {"0", "1"}


def test_lateral_split(spark):
    rows = [(i, 0.01 * (i // 2), 0.3 * (i % 2), 0.0, 1.0, 0.0, 0.0) for i in range(80)]
    df = points(spark, rows, "center_id x y z tx ty tz").withColumn("g", F.lit(0))
    got = {r["center_id"]: r["path"] for r in clustering.lateral_split(df, ["g"], 0.1, 4).collect()}
    assert len({got[i] for i in range(0, 80, 2)}) == 1 and got[0] != got[1]


def test_one_surviving_fragment_keeps_the_cluster(spark):
    rows = [(i, 0, 0.01 * i, 0.3 if i >= 8 else 0.0, 0.0, 1.0, 0.0, 0.0) for i in range(10)]
    df = points(spark, rows, "center_id cluster x y z tx ty tz").withColumn("scene", F.lit(0))
    cfg = clustering.ClusterConfig()
    got = clustering.split_parallel(df, ["scene"], 0.01, cfg).collect()
    assert {r["cluster"] for r in got} == {0}


def test_supports_of_a_line(spark):
    members = line_cluster(spark).withColumn("confidence", F.lit(0.5))
    s = supports.fit_supports(members, ["cluster_id"]).collect()
    assert len(s) == 2 and {r["support_type"] for r in s} == {supports.LINE}
    assert all(r["residual"] < 0.002 and abs(r["dx"]) > 0.999 for r in s)


def test_clustering_does_not_depend_on_partitioning(spark):
    rng = np.random.default_rng(3)
    xyz = np.concatenate([rng.normal(0, 0.01, (40, 3)), rng.normal(1, 0.01, (40, 3))])
    pdf = pd.DataFrame(xyz, columns=list("xyz")).assign(center_id=range(80), label_a=1, label_b=2, scene_id=0, tx=1.0, ty=0.0, tz=0.0)
    got = []
    for parts in (1, 7):
        df = spark.createDataFrame(pdf.sample(frac=1, random_state=parts)).repartition(parts)
        out = clustering.cluster_centers(df, spacing=0.01)
        got.append({r["center_id"]: r["cluster"] for r in out.collect()})
    assert got[0] == got[1]


def test_merge_of_a_chain(spark):
    rows = [(i, i // 5, 0.01 * i, 0.0, 0.0, 1.0, 0.0, 0.0) for i in range(20)]
    df = points(spark, rows, "center_id cluster x y z tx ty tz").withColumn("scene", F.lit(0))
    got = {r["center_id"]: r["cluster"] for r in clustering.merge(df, ["scene"], 0.01, clustering.ClusterConfig()).collect()}
    assert set(got.values()) == {0}


def test_quantiles_of_large_groups(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": [0] * 400 + [1] * 50, "v": np.round(np.concatenate([rng.normal(0, 1, 300), np.full(100, 0.25), rng.uniform(0, 1, 50)]), 3)})
    df = spark.createDataFrame(pdf)
    got = {r["g"]: (r["q0"], r["q1"], r["q2"]) for r in stats.quantiles(df, ["g"], "v", [0.25, 0.5, 0.9]).collect()}
    for g, part in pdf.groupby("g"):
        assert np.allclose(got[g], np.quantile(part["v"], [0.25, 0.5, 0.9]))


def test_running_totals_with_fine_buckets(spark):
    rng = np.random.default_rng(6)
    err = np.unique(np.concatenate([rng.uniform(0, 1, 100), rng.uniform(0.5, 0.5001, 200)]))
    df = spark.createDataFrame([(float(e), 1) for e in err], ["err", "n"])
    got = {r["err"]: r["n_above"] for r in totals_above(df, [], "err", ["n"]).collect()}
    assert got == {e: len(err) - 1 - i for i, e in enumerate(err)}


def test_denoise_cube_and_cap(spark):
    rng = np.random.default_rng(42)
    cube = np.stack(np.meshgrid(*[np.arange(10) * 0.05] * 3), axis=-1).reshape(-1, 3)
    xyz = np.concatenate([cube, rng.uniform(-1, 1, (100, 3))])
    df = spark.createDataFrame(pd.DataFrame(xyz, columns=list("xyz")).assign(point_id=range(len(xyz)), scene_id=0))
    kept = denoise.denoise(df, [("sor", {"nb": 20, "ratio": 2.0})], ["scene_id"])
    assert 0.01 <= 1 - kept.count() / len(xyz) <= 0.10
    with pytest.raises(ValueError):
        denoise.denoise(df, [("radius", {"nb": 8, "reach": 0.01})], ["scene_id"])


def test_normals_of_a_plane(spark):
    rng = np.random.default_rng(1)
    g = np.stack(np.meshgrid(np.linspace(0, 1, 20), np.linspace(0, 1, 20)), axis=-1).reshape(-1, 2)
    pdf = pd.DataFrame(g, columns=["x", "y"]).assign(z=rng.normal(0, 0.001, 400), point_id=range(400), scene_id=0)
    n = denoise.normals(spark.createDataFrame(pdf), ["scene_id"]).toPandas()
    assert (n["nz"] > 0.99).all() and np.allclose(n["nx"] ** 2 + n["ny"] ** 2 + n["nz"] ** 2, 1)
    with pytest.raises(ValueError):
        denoise.normals(spark.createDataFrame(pdf.head(5)), ["scene_id"])


def test_bisect_is_a_partition(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.uniform(0, 1, (500, 3)) * [4, 1, 1], columns=list("xyz")).assign(point_id=range(500), piece=0)
    out = chunking.bisect(spark.createDataFrame(pdf), ["piece"], 100, 10).toPandas()
    assert len(out) == 500 and out.groupby("path").size().max() <= 100


def test_sanity_flags_a_fat_chunk(spark):
    h = spark.createDataFrame([(1, 10), (2, 10)], ["class_id", "n"])
    f = spark.createDataFrame([(0, 5), (1, 5)], ["class_id", "n"])
    chunks = spark.createDataFrame([("a__c0000", 999_999_999)], ["chunk", "n"])
    none = spark.createDataFrame([], "problem string, sample string")
    got = validation.sanity(h, f, chunks, none).collect()
    assert [(r["level"], r["subject"]) for r in got] == [("HARD FAIL", "a__c0000")]


def test_weight_gate(spark):
    assert losses.gate(spark.createDataFrame([(1.0, 2.0)], ["support", "s_weight"])) == "s_weight"
    with pytest.raises(ValueError):
        losses.gate(spark.createDataFrame([(1.0,)], ["other"]))


def test_remap_rejects_out_of_range(spark):
    df = spark.createDataFrame([(17,)], ["c"])
    with pytest.raises(Exception, match="out of range"):
        df.select(grid.remap_after_void(F.col("c"))).collect()


def test_a_scene_clusters_alone_as_among_others(spark):
    rng = np.random.default_rng(8)
    near = rng.normal(0, 1, (40, 3)) * [0.05, 0.002, 0.002]
    pdf = pd.DataFrame(np.concatenate([near, near * 7 + 1]), columns=list("xyz"))
    pdf = pdf.assign(center_id=range(80), scene_id=[0] * 40 + [1] * 40, label_a=1, label_b=2, tx=1.0, ty=0.0, tz=0.0)

    def run(part):
        return {r["center_id"]: r["cluster"] for r in clustering.cluster_centers(spark.createDataFrame(part)).collect()}

    both = run(pdf)
    assert {k: v for k, v in both.items() if k < 40} == run(pdf[pdf.scene_id == 0])
    # the second scene is the first one seven times larger: the same clusters
    assert [both[i] for i in range(40)] == [None if both[40 + i] is None else both[40 + i] - 40 for i in range(40)]


def test_scene_without_facade_stays_whole(spark):
    rows = [(0, i, float(i), 0.0, 0.0, 9) for i in range(100)] + [(1, i, float(i % 10), 0.0, 0.0, 2) for i in range(60)]
    df = points(spark, rows, "scene_id point_id x y z segment")
    out = chunking.facade_chunks(df, ["scene_id"], budget=20, min_points=5, facade=(2,))
    got = {(r["scene_id"], r["chunk_idx"]): r["count"] for r in out.groupBy("scene_id", "chunk_idx").count().collect()}
    assert got[0, 0] == 100 and sum(n for (s, _), n in got.items() if s == 1) == 60 and len(got) > 2


def test_numbers_within_a_key(spark):
    from cloudloom.operators.prefix import numbered

    df = spark.createDataFrame([(k, i, "ab"[i % 2]) for k in range(3) for i in range(20)], "k int, i int, t string")
    got = {(r["k"], r["i"]): r["n"] for r in numbered(df, ["k"], ["t", "i"], "n").collect()}
    assert got == {(k, i): i // 2 + 10 * (i % 2) for k in range(3) for i in range(20)}


def test_ordinal_pairs_of_all_points(spark):
    from cloudloom.operators import losses

    rows = [(0, i, 0.01 * i, 0.0, 0.0, 0.03 * i + 0.01, 0.0, 0.0, 1.0, 0.5, 0.0) for i in range(6)]
    df = points(spark, rows, "scene_id point_id x y z vx vy vz valid support support_logit")
    got = losses.ordinal_pairs(df).first()
    assert got["pairs"] == 15 and abs(got["loss"] - 0.05) < 1e-9
    assert losses.ordinal_pairs(df.where("point_id < 3")).isEmpty()
