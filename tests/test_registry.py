"""The registered queries against their oracle SQL on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry
from tools.check_oracle import TABLES, compare

LIGHT = [
    "agg_voxel", "agg_hist_final", "agg_dataset_stats", "jn_knn_self", "jn_nearest_support", "chk_grid", "fit_bad_support", "met_iou_test",
    "met_val_batchmean", "ls_lovasz", "ls_local", "jn_patch_pairs", "val_sanity", "win_log_backfill", "src_log", "snk_manifest",
]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 180


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", LIGHT)
def test_matches_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    message, good = compare(spark, con, name, sf_dir)
    assert good, message


def test_supports_without_segments_are_counted(spark, sf_dir, tmp_path):
    """With 451 points the last cluster has a single vertex and its support no segment."""
    duckdb.sql(f"COPY (SELECT * FROM '{sf_dir}/embeddings.parquet' WHERE vec_id < 451) TO '{tmp_path}/embeddings.parquet'")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    message, good = compare(spark, con, "val_supports", str(tmp_path))
    assert good, message
