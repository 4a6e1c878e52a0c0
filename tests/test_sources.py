"""Point files, scene folders, logs, sinks and the file stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import logs
from cloudloom.sources import points as src
from cloudloom.sources import sinks, stage
from cloudloom.streaming import points as stream

HEADER = [
    "# cloud", "VERSION 0.7", "FIELDS x y z classification rgb", "SIZE 4 4 4 1 4", "TYPE F F F U F", "COUNT 1 1 1 1 1",
    "WIDTH 1000", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", "POINTS 1000", "DATA ascii",
]


def write_points(folder, name="S1", points=1000):
    body = [f"{i % 10} {(i // 10) % 10} {(i // 100) % 10} {i % 17} 13033652" for i in range(points)]
    (folder / f"{name}.pcd").write_text("\n".join(HEADER + body) + "\n")


def test_header(spark, tmp_path):
    write_points(tmp_path)
    assert src.read_header(spark, str(tmp_path / "S1.pcd")) == {"points": 1000, "body": 11}
    for old, new in (("DATA ascii", "DATA binary"), ("TYPE F F F U F", "TYPE I I I U U"), ("FIELDS x y z classification rgb", "FIELDS x y z intensity rgb")):
        with pytest.raises(src.PointFormatError):
            src.parse_header([new if h == old else h for h in HEADER])


def test_body_counts_and_stream(spark, tmp_path):
    write_points(tmp_path)
    write_points(tmp_path, "S2", 999)
    pts = src.read_points(spark, str(tmp_path))
    assert pts.columns == ["sample", "x", "y", "z", "c"] and pts.where("sample = 'S1'").count() == 1000
    assert [r["rows"] for r in src.check_counts(spark, str(tmp_path)).collect()] == [999]
    state = stream.voxel_state(stream.point_stream(spark, str(tmp_path), 1), 5.0)
    q = state.writeStream.outputMode("complete").format("memory").queryName("voxels").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in stream.vote(stream.voxel_state(pts, 5.0)).select("sample", "key", "n", "winner").collect()}
    assert {tuple(r) for r in stream.vote(spark.table("voxels")).select("sample", "key", "n", "winner").collect()} == want


def test_scene_folders(spark, tmp_path):
    d = tmp_path / "training" / "s1"
    d.mkdir(parents=True)
    np.save(d / "coord.npy", np.arange(12, dtype=np.float32).reshape(4, 3))
    np.save(d / "segment.npy", np.array([[1], [2], [3], [4]], dtype=np.int32))
    got = src.read_scenes(spark, str(tmp_path)).orderBy("point_id").collect()
    assert [(r["x"], r["segment"]) for r in got] == [(0.0, 1), (3.0, 2), (6.0, 3), (9.0, 4)]
    np.save(d / "segment.npy", np.array([1, 2, 3], dtype=np.int32))
    with pytest.raises(Exception, match="row counts differ"):
        src.read_scenes(spark, str(tmp_path)).collect()


def test_stage_schema_is_enforced(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, 2)], ["scene_id", "center_id", "cluster_id"])
    stage.write_stage(df, str(tmp_path), "local_clusters")
    assert stage.read_stage(spark, str(tmp_path), "local_clusters").count() == 1
    df.drop("cluster_id").write.parquet(str(tmp_path / "boundary_centers"))
    with pytest.raises(ValueError, match="missing column"):
        stage.read_stage(spark, str(tmp_path), "boundary_centers")


def test_log(spark, tmp_path):
    lines = [
        "Val/Test: [1/2] val_boundary_mIoU: 0.1", "Val/Test: [2/2] val_boundary_mIoU: 0.2", "Val result: mIoU/mAcc/allAcc 0.5000/0.6000/0.7000",
        *[f"{c} Result: iou/accuracy 0.{i}/0.9" for i, c in enumerate(logs.CLASS_NAMES)],
        "Train result: loss=1.5 loss_semantic=1.0 loss_support=0.5 loss_focus=0.1",
    ]
    (tmp_path / "train.log").write_text("\n".join(lines) + "\n")
    log = src.read_log(spark, str(tmp_path / "train.log"))
    assert logs.run_type(log).collect()[0]["run_type"] == "focus"
    row = logs.epoch_table(log, "focus").collect()[0]
    assert (row["epoch"], row["val_mIoU"], row["train_loss"], row["val_boundary_mIoU"]) == (1, "0.5000", "1.5", "0.2")
    assert logs.class_table(log).collect()[0]["clutter"] == "0.7"
    assert logs.best_epoch(logs.epoch_table(log, "focus")).collect()[0]["best_epoch"] == 1


def test_chunk_sink_rejects_bad_classes(spark, tmp_path):
    rows = [(0, 0, i, 0.0, 0.0, 0.0, i, 0.0, 0.0, 1.0) for i in (0, 7, 15, 3)]
    df = spark.createDataFrame(rows, ["split", "chunk", "point_id", "x", "y", "z", "segment", "nx", "ny", "nz"])
    sinks.write_chunks(df, str(tmp_path / "ok"))
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 4
    with pytest.raises(ValueError, match="class_range"):
        sinks.write_chunks(df.withColumn("segment", F.lit(16)), str(tmp_path / "bad"))
    assert all(len(r["digest"]) == 64 for r in sinks.chunk_digests(df, ["chunk"]).collect())


def test_denoise_config():
    text = "# x\n## Final Decision\n```yaml\nmethod: [sor, radius]\nparams:\n  sor: {nb: 20}\nmax_drop_frac: 0.2\n```\n"
    assert src.denoise_steps(text) == ([("sor", {"nb": 20}), ("radius", {})], 0.2)
