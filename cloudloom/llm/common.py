"""Session, table and folder helpers shared by the text operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one group of documents aims at; a group is one Python call.
GROUP_BYTES = 12_000_000


def ship(spark: SparkSession) -> None:
    """Give executors the package when they cannot import it from a shared path."""
    sc = spark.sparkContext
    if sc.master.startswith("local[") or sc.master == "local" or getattr(sc, "_cloudloom_shipped", False):
        return
    import shutil

    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "cloudloom"), "zip", here, "cloudloom"))
    sc._cloudloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under the folder that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="cloudloom-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_text(docs: DataFrame) -> DataFrame:
    """Only (doc_id, text): further columns, whatever their names, never meet the operator's own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def measure(docs: DataFrame) -> tuple[int, int]:
    """Rows and text bytes."""
    row = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    return row["n"], row["b"] or 0


def group_count(size: int, per: int = GROUP_BYTES) -> int:
    return max(1, -(-size // per))


def texts_of(batch: pa.RecordBatch | pa.Table, name: str = "text") -> list[bytes]:
    """The column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], size: int, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into row ranges of about ``size`` bytes of one column; a longer row stays whole."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name).cast(pa.binary())), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
            yield batch.slice(at, to - at)
            at = to


def batch_of(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def with_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns put at its end; one of the same name is replaced."""
    kept = [i for i, n in enumerate(batch.schema.names) if n not in columns]
    arrays = [batch.column(i) for i in kept] + list(columns.values())
    return pa.RecordBatch.from_arrays(arrays, names=[batch.schema.names[i] for i in kept] + list(columns))


def crc32_of_id(col: str = "doc_id"):
    """crc32 of the id written as decimal text; the fold key of the learned operators (null: null)."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def chosen(names: Sequence[str], taken: Sequence[str]) -> list[str]:
    return [n for n in names if n not in taken]
