"""Point files as a data source, the chunk store, digest trees, table functions and the epoch stream."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import digest, tablefn
from cloudloom.sources import chunkstore, pointfile
from cloudloom.sources.points import PointFormatError

HEADER = "# cloud\nVERSION 0.7\nFIELDS x y z classification rgb\nSIZE 4 4 4 1 4\nTYPE F F F U F\nCOUNT 1 1 1 1 1\nWIDTH 1000\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS 1000\nDATA ascii\n"


def body(n=1000):
    return "".join(f"{i % 10} {(i // 10) % 10}  {(i // 100) % 10} {i % 17} 13033652\n" for i in range(n))


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def read(spark, path, split=10**9):
    return pointfile.read_points(spark, str(path), split)


def test_ascii_ranges(spark, tmp_path):
    put(tmp_path, "training/S1.pcd", HEADER + body())
    put(tmp_path, "validation/S1.pcd", "#" * 9000 + "\n" + HEADER.replace("1000", "3") + "1 2 nan 3 5\n\n  \n4 5 6 7 8\n-1e3 .5 +2 0 9")
    put(tmp_path, "validation/.hidden.pcd", "junk")
    want = [(i % 10, (i // 10) % 10, (i // 100) % 10, i % 17) for i in range(1000)]
    for split in (10**9, 700, 13):
        got = read(spark, tmp_path, split).collect()
        one = sorted((r.at, r.x, r.y, r.z, r.c) for r in got if r.split == "training")
        assert [r[1:] for r in one] == want and len({r[0] for r in one}) == 1000
        two = sorted((r.at, r.x, r.y, r.c) for r in got if r.split == "validation")
        assert [r[1:] for r in two] == [(1.0, 2.0, 3), (4.0, 5.0, 7), (-1000.0, 0.5, 0)]
    assert len(pointfile.ranges(str(tmp_path), 700)) > 20


def test_ranges_grow_with_the_input_and_are_read_once(tmp_path):
    for i in range(3):
        put(tmp_path, f"training/S{i}.pcd", HEADER.replace("1000", "20000") + body(20000))
    size = sum(f.stat().st_size for f in tmp_path.rglob("*.pcd"))
    found = pointfile.ranges(str(tmp_path), 100)
    assert len(found) <= pointfile.RANGES + 3

    class Handle:
        def __init__(self, file):
            self.file, self.got = open(file, "rb"), 0
            self.seek = self.file.seek

        def read(self, n):
            out = self.file.read(n)
            self.got += len(out)
            return out

    handles = [Handle(r.file) for r in found]
    lines = [len(pointfile._full_lines(text)) for h, r in zip(handles, found) for _, text in pointfile._text_blocks(h, r)]
    assert sum(lines) == 60000
    assert sum(h.got for h in handles) <= size + len(found) * 2 * pointfile.LINE_BYTES


@pytest.mark.parametrize("old,new", [
    ("DATA ascii", "DATA binary"), ("TYPE F F F U F", "TYPE I I I U U"), ("FIELDS x y z classification rgb", "FIELDS x y z intensity rgb"), ("DATA ascii\n", ""),
    ("COUNT 1 1 1 1 1", "COUNT 1 1 1 2 1"), ("HEIGHT 1", "HEIGHT 2"), ("POINTS 1000\n", ""), ("SIZE 4 4 4 1 4", "SIZE 8 8 8 1 4"),
])
def test_bad_headers(tmp_path, old, new):
    put(tmp_path, "S1.pcd", HEADER.replace(old, new) + body())
    with pytest.raises(PointFormatError):
        pointfile.ranges(str(tmp_path), 10**9)


@pytest.mark.parametrize("text", [body(999), body(1001), body(999) + "word 2 3 4 5\n", body(999) + "1 2 3\n"])
def test_bad_bodies_fail_the_job(spark, tmp_path, text):
    put(tmp_path, "S1.pcd", HEADER + text)
    with pytest.raises(Exception, match="said|bytes"):
        read(spark, tmp_path, 5_000).agg(F.sum("x"), F.sum("c")).collect()


def test_ply(spark, tmp_path):
    kind = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("red", "u1"), ("green", "u1"), ("blue", "u1"), ("label", "<i4")])
    rows = np.zeros(500, kind)
    rows["x"], rows["red"], rows["label"] = np.arange(500), np.arange(500) % 256, np.arange(500) % 7
    names = {"f4": "float", "u1": "uchar", "i4": "int"}
    head = "ply\nformat binary_little_endian 1.0\ncomment c\nelement vertex 500\n" + "".join(f"property {names[kind[n].str[1:]]} {n}\n" for n in kind.names) + "end_header\n"
    (tmp_path / "a.ply").write_bytes(head.encode() + rows.tobytes())
    (tmp_path / "b.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty double x\nproperty double y\nproperty double z\nend_header\n1 2 3\n4 5 6\n")
    for split in (10**9, 100):
        got = read(spark, tmp_path, split).collect()
        assert sorted((r.x, r.r, r.c) for r in got if r["sample"] == "a") == [(float(i), i % 256, i % 7) for i in range(500)]
        assert sorted((r.x, r.y, r.z, r.c) for r in got if r["sample"] == "b") == [(1.0, 2.0, 3.0, None), (4.0, 5.0, 6.0, None)]
    for bad in (head.replace("binary_little", "binary_big"), head.replace("vertex 500", "vertex 501"), head.replace("property float z\n", ""), head.replace("element vertex", "element face")):
        (tmp_path / "a.ply").write_bytes(bad.encode() + rows.tobytes())
        with pytest.raises(PointFormatError):
            pointfile.ranges(str(tmp_path), 100)


def test_written_files_read_back(spark, tmp_path):
    pts = spark.range(300).select((F.col("id") % 3).cast("string").alias("file"), *[(F.col("id") * k).cast("double").alias(a) for k, a in enumerate("xyz")], (F.col("id") % 17).cast("int").alias("c"))
    for kind in ("pcd", "ply", "ascii_ply"):
        assert {(r.file, r.n) for r in pointfile.write_points(pts, str(tmp_path / kind), kind).collect()} == {("0", 100), ("1", 100), ("2", 100)}
        assert sorted((r["sample"], r.y, r.z, r.c) for r in read(spark, tmp_path / kind, 777).collect()) == sorted((str(i % 3), float(i), 2.0 * i, i % 17) for i in range(300))
        assert not [f for f in os.listdir(tmp_path / kind) if f.startswith(".") and not f.endswith(".crc")]


# -- chunks ---------------------------------------------------------------------
def chunk_rows(spark, samples=("a", "b", "c")):
    rows = [("training", s, f"h{s}", i % 3, 100 * k + i, float(i), 0.0, -1.0, i % 16, 0.0, 0.0, 1.0) for k, s in enumerate(samples) for i in range(30)]
    return spark.createDataFrame(rows, chunkstore.POINTS)


def test_chunks_round_trip_and_resume(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = chunk_rows(spark)
    assert chunkstore.chunks(spark, root).count() == 0 and chunkstore.state(spark, root).count() == 0
    chunkstore.write(rows.where("sample = 'a'"), root)
    chunkstore.write(rows, root)
    chunkstore.write(rows, root)
    found = {(r["sample"], r.chunk_idx): (r.job, r.n) for r in chunkstore.chunks(spark, root).collect()}
    assert found == {(s, c): (0 if s == "a" else 1, 10) for s in "abc" for c in range(3)}
    got = sorted((r["sample"], r.chunk_idx, r.row, r.x, r.segment) for r in chunkstore.points(spark, root).collect())
    assert got == sorted((s, i % 3, i // 3, float(i), i % 16) for s in "abc" for i in range(30))
    changed = rows.where("sample = 'b'").withColumn("source_hash", F.lit("new"))
    chunkstore.write(changed, root)
    assert {(r["sample"], r.source_hash, r.status) for r in chunkstore.state(spark, root).collect()} >= {("b", "new", "done"), ("a", "ha", "done")}
    assert {r.job for r in chunkstore.chunks(spark, root).where("sample = 'b'").collect()} == {3}


@pytest.mark.parametrize("column,value", [("nz", 2.0), ("segment", 16), ("x", float("nan")), ("point_id", 0)])
def test_a_failed_job_leaves_nothing_visible(spark, tmp_path, column, value):
    root = str(tmp_path / "store")
    rows = chunk_rows(spark)
    bad = rows.withColumn(column, F.when((F.col("sample") == "c") & ((F.col("point_id") % 30 < 6) if column == "point_id" else (F.col("chunk_idx") == 2)), F.lit(value)).otherwise(F.col(column)))
    with pytest.raises(Exception):
        chunkstore.write(bad, root)
    assert chunkstore.chunks(spark, root).count() == 0
    assert {(r["sample"], r.status) for r in chunkstore.state(spark, root).collect()} == {("a", "partial"), ("b", "partial"), ("c", "partial")}
    chunkstore.write(rows, root)
    assert chunkstore.chunks(spark, root).count() == 9 and {r.status for r in chunkstore.state(spark, root).collect()} == {"done"}


def test_a_changed_array_is_noticed(spark, tmp_path):
    root = tmp_path / "store"
    chunkstore.write(chunk_rows(spark, ("a",)), str(root))
    victim = next(root.glob("data/*/*/*/coord.npy"))
    values = np.load(victim)
    np.save(victim, values + 1)
    with pytest.raises(Exception, match="not what was written"):
        chunkstore.points(spark, str(root)).count()


# -- digests --------------------------------------------------------------------
def test_digest_tree(spark):
    r = random.Random(5)
    ids = sorted(r.sample(range(5000), 700))
    rows = [("a", i, f"t{i}") for i in ids] + [("b", 3, "x")]
    df = spark.createDataFrame(rows, "k string, i long, t string")
    tree = digest.digest_tree(df, ["k"], "i", F.col("t"), 4).cache()
    assert max(x.rows for x in tree.where("level = 0").collect()) <= 4
    tops = {x.k: (x.levels, x.rows) for x in digest.roots(tree, ["k"]).collect()}
    assert tops["b"] == (1, 1) and tops["a"][1] == 700 and tops["a"][0] >= 6
    again = digest.digest_tree(df.repartition(7), ["k"], "i", F.col("t"), 4)
    assert {tuple(x) for x in digest.roots(tree, ["k"]).collect()} == {tuple(x) for x in digest.roots(again, ["k"]).collect()}
    assert digest.changed_nodes(tree, again, ["k"], 4).count() == 0
    gone, new = ids[10], next(i for i in range(5000) if i // 4 not in {j // 4 for j in ids})
    other = df.where(f"NOT (k = 'a' AND (i = {gone} OR i = {ids[50]}))").unionByName(spark.createDataFrame([("a", ids[50], "other"), ("a", new, "n"), ("c", 9, "z")], "k string, i long, t string"))
    found = {(x.k, x.node): x.change for x in digest.changed_nodes(tree, digest.digest_tree(other, ["k"], "i", F.col("t"), 4), ["k"], 4).collect()}
    left = {j // 4 for j in ids if j != gone}
    assert found == {("a", gone // 4): "changed" if gone // 4 in left else "removed", ("a", ids[50] // 4): "changed", ("a", new // 4): "added", ("c", 2): "added"}


# -- table functions ------------------------------------------------------------
def test_table_functions(spark):
    tablefn.register(spark)
    got = spark.sql("SELECT * FROM segment_samples(0D, 0D, 0D, 1D, 0D, 0D, 0.4D)").collect()
    assert [(r.i, round(r.x, 9)) for r in got] == [(0, 0.0), (1, 0.333333333), (2, 0.666666667), (3, 1.0)]
    assert spark.sql("SELECT * FROM segment_samples(0D, NULL, 0D, 1D, 0D, 0D, 0.4D)").count() == 0
    for bad in ("segment_samples(1, 2)", "segment_samples(0D, 0D, 0D, 1D, 0D, 0D, 0D)"):
        with pytest.raises(Exception, match="segment_samples"):
            spark.sql(f"SELECT * FROM {bad}").collect()
    spark.createDataFrame([("p", 0.0, 1.0, 2.0), ("p", 4.0, -1.0, 2.0), ("q", 0.0, 0.0, 0.0)], "tile string, x double, y double, z double").createOrReplaceTempView("tiles")
    found = {r.tile: (r.n, r.x_min, r.x_max, r.y_min, r.z_max) for r in spark.sql("SELECT * FROM padded_bounds(TABLE(tiles), 'tile', 0.5D)").collect()}
    assert found == {"p": (2, -0.5, 4.5, -1.5, 2.5), "q": (1, -0.5, 0.5, -0.5, 0.5)}
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM padded_bounds(TABLE(tiles), 'chunk', 0.5D)").collect()


def test_late_train_lines_and_a_restart(spark, tmp_path):
    from cloudloom.operators import logs
    from cloudloom.streaming import epochs

    def val(x):
        return f"Val result: mIoU/mAcc/allAcc 0.{x}/0.5/0.6"

    steps = [
        [(1, "Train result: loss=9"), (2, "Val/Test: [1/2] val_boundary_mIoU: 0.11"), (3, val(1)), (5, "noise")],
        [(6, "Val/Test: [1/2] val_boundary_mIoU: 0.22"), (7, "Val/Test: [2/2] support_bce: 0.33"), (8, val(2))],
        [(4, "Train result: loss=1 loss_focus=2"), (9, "Train result: loss=3"), (10, "Train result: loss=4")],
        [(11, val(3))],
    ]
    lines = [(log, n, v) for log in (0, 1) for part in steps for n, v in part]
    table = logs.epoch_table(spark.createDataFrame(lines, "log long, line_no long, value string"), "focus")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, epochs.ROCKS)
    try:
        for part in steps:
            spark.createDataFrame([(log, n, v) for log in (0, 1) for n, v in part], "log long, line_no long, value string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema("log long, line_no long, value string").parquet(str(tmp_path / "in"))
            job = epochs.epoch_stream(stream, "focus").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
            job.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    finally:
        spark.conf.set(key, before)
    found = epochs.settled(spark.read.parquet(str(tmp_path / "out")), "focus")
    assert sorted(map(str, found.select(*table.columns).collect())) == sorted(map(str, table.collect())) and found.count() == 6
    assert json.dumps(sorted(r.train_loss or "" for r in found.where("log = 0").collect())) == '["", "1", "4"]'
