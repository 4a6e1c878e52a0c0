"""Chunks as array files behind a commit log: a data source writer in two phases, and what is done, open and visible.

    root/data/<job>/<attempt>/<chunk>/{coord,segment,normal}.npy
    root/data/<job>/<attempt>.jsonl        one record a chunk: counts and the SHA-256 of each array
    root/_log/<time>-<job>.begin.json      the samples a job takes on (``partial``)
    root/_log/<time>-<job>.commit.json     the record files of the attempts that count

Phase one: every task attempt writes its chunks under a folder of its own and returns the name of its record file.
Phase two: the driver writes one commit entry under a hidden name and renames it, which makes all chunks of the job
visible at once.  Readers follow committed record files only, so failed, repeated and abandoned attempts are never
seen; a rerun takes on the samples without a committed chunk of the same source hash.  The driver handles one name an
attempt, chunk records are read by Spark.
"""

from __future__ import annotations

import hashlib
import io
import json
import posixpath
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from cloudloom.sources.pointfile import open_fs

POINTS = "split string, sample string, source_hash string, chunk_idx int, point_id long, x float, y float, z float, segment int, nx float, ny float, nz float"
RECORDS = "split string, sample string, source_hash string, chunk_idx int, folder string, n long, coord_sha256 string, segment_sha256 string, normal_sha256 string, segment_min int, segment_max int"
ARRAYS = {"coord": (["x", "y", "z"], np.float32), "segment": (["segment"], np.int32), "normal": (["nx", "ny", "nz"], np.float32)}
CLASSES = 16
UNIT = (0.99, 1.01)


class ChunkError(ValueError):
    pass


def _save(system, path: str, content: bytes) -> None:
    with system.open_output_stream(path) as out:
        out.write(content)


def _publish(system, folder: str, name: str, entry: dict) -> None:
    """A log entry in one step: written beside its place, then renamed."""
    system.create_dir(folder, recursive=True)
    hidden = posixpath.join(folder, f".{name}.{uuid.uuid4().hex}")
    _save(system, hidden, json.dumps(entry).encode())
    system.move(hidden, posixpath.join(folder, name))


def check(name: str, rows: pd.DataFrame) -> None:
    """Raises unless the rows may be a chunk: finite coordinates and unit normals, classes in range, no id twice."""
    if not np.isfinite(rows[["x", "y", "z"]].to_numpy(float)).all():
        raise ChunkError(f"{name}: coordinates that are not finite")
    if rows["segment"].isna().any() or not rows["segment"].between(0, CLASSES - 1).all():
        raise ChunkError(f"{name}: classes outside 0 to {CLASSES - 1}")
    size = np.linalg.norm(rows[["nx", "ny", "nz"]].to_numpy(float), axis=1)
    if not ((size >= UNIT[0]) & (size <= UNIT[1])).all():
        raise ChunkError(f"{name}: normals that are not of unit length")
    if rows["point_id"].duplicated().any():
        raise ChunkError(f"{name}: a point stands twice")


@dataclass
class Attempt(WriterCommitMessage):
    records: str
    chunks: int


class Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.root = options["path"]
        self.job = options.get("job") or uuid.uuid4().hex
        self.name = f"{time.time_ns():020d}-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        """Rows come clustered by chunk and in id order; one chunk is held at a time, its size is bounded by its budget."""
        system, root = open_fs(self.root)
        attempt = posixpath.join(root, "data", self.job, uuid.uuid4().hex)
        system.create_dir(attempt, recursive=True)
        records, seen, held, key = [], set(), [], None

        def flush() -> None:
            if not held:
                return
            if key in seen:
                raise ChunkError(f"{key}: rows of a chunk are not together")
            seen.add(key)
            records.append(self._chunk(system, attempt, key, pd.concat(held, ignore_index=True)))
            held.clear()

        for batch in iterator:
            rows = batch.to_pandas()
            for k, part in rows.groupby(["split", "sample", "source_hash", "chunk_idx"], sort=False, dropna=False):
                if k != key:
                    flush()
                    key = k
                held.append(part)
        flush()
        _save(system, attempt + ".jsonl", "".join(json.dumps(r) + "\n" for r in records).encode())
        return Attempt(attempt + ".jsonl", len(records))

    def _chunk(self, system, attempt: str, key: tuple, rows: pd.DataFrame) -> dict:
        split, sample, source, idx = key
        name = f"{split}/{sample}__c{int(idx):04d}"
        check(name, rows)
        folder = posixpath.join(attempt, f"{len(rows)}-{uuid.uuid4().hex[:12]}")
        system.create_dir(folder, recursive=True)
        record = {"split": split, "sample": sample, "source_hash": source, "chunk_idx": int(idx), "folder": folder, "n": len(rows)}
        for array, (columns, kind) in ARRAYS.items():
            values = np.ascontiguousarray(rows[columns].to_numpy(kind))
            values = values[:, 0] if len(columns) == 1 else values
            out = io.BytesIO()
            np.save(out, values, allow_pickle=False)
            _save(system, posixpath.join(folder, f"{array}.npy"), out.getvalue())
            record[f"{array}_sha256"] = hashlib.sha256(values.tobytes()).hexdigest()
        return record | {"segment_min": int(rows["segment"].min()), "segment_max": int(rows["segment"].max())}

    def commit(self, messages) -> None:
        system, root = open_fs(self.root)
        kept = [m.records for m in messages if m is not None and m.chunks]
        _publish(system, posixpath.join(root, "_log"), f"{self.name}.commit.json", {"job": self.job, "records": kept})

    def abort(self, messages) -> None:
        system, root = open_fs(self.root)
        folder = posixpath.join(root, "data", self.job)
        if system.get_file_info(folder).type.name == "Directory":
            system.delete_dir(folder)


class ChunkStore(DataSource):
    """Write only; ``chunks`` and ``points`` read what is committed."""

    @classmethod
    def name(cls) -> str:
        return "chunkstore"

    def schema(self) -> str:
        return POINTS

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


def _entries(root: str, kind: str) -> list[dict]:
    """Log entries of a kind in order: one a job."""
    from pyarrow import fs

    system, at = open_fs(root)
    found = system.get_file_info(fs.FileSelector(posixpath.join(at, "_log"), allow_not_found=True))
    names = sorted(f.path for f in found if f.base_name.endswith(f".{kind}.json") and not f.base_name.startswith("."))
    out = []
    for name in names:
        with system.open_input_stream(name) as handle:
            out.append(json.loads(handle.read()))
    return out


def chunks(spark: SparkSession, root: str) -> DataFrame:
    """Records of all committed chunks; of a chunk written twice the later job's."""
    jobs = [(i, path) for i, e in enumerate(_entries(root, "commit")) for path in e["records"]]
    if not jobs:
        return spark.createDataFrame([], f"{RECORDS}, job int")
    names = spark.createDataFrame([(i, posixpath.basename(path)) for i, path in jobs], "job int, _file string")
    rows = spark.read.schema(RECORDS).json([path for _, path in jobs]).withColumn("_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    rows = rows.join(names, "_file").drop("_file")
    last = rows.groupBy("split", "sample").agg(F.max("job").alias("job"))
    return rows.join(last, ["split", "sample", "job"]).select(*[c.split()[0] for c in RECORDS.split(", ")], "job")


def state(spark: SparkSession, root: str) -> DataFrame:
    """(split, sample, source_hash, status): ``done`` with committed chunks, ``partial`` when only begun."""
    done = chunks(spark, root).select("split", "sample", "source_hash", F.lit("done").alias("status")).distinct()
    begun = [e["samples"] for e in _entries(root, "begin")]
    if not begun:
        return done
    open_ = spark.read.schema("split string, sample string, source_hash string").json(begun).distinct()
    partial = open_.join(done, ["split", "sample", "source_hash"], "left_anti").withColumn("status", F.lit("partial"))
    return done.unionByName(partial)


def to_write(tasks: DataFrame, root: str) -> DataFrame:
    """Samples (split, sample, source_hash) without committed chunks of that hash."""
    done = state(tasks.sparkSession, root).where("status = 'done'")
    return tasks.join(done, ["split", "sample", "source_hash"], "left_anti")


def write(rows: DataFrame, root: str, force: bool = False) -> str:
    """Writes the open samples of ``rows`` (columns of ``POINTS``) as one job and returns its name.

    The samples are logged as begun first; when the job fails they stay ``partial`` and nothing of it is visible.
    """
    spark = rows.sparkSession
    spark.dataSource.register(ChunkStore)
    job = uuid.uuid4().hex
    names = [c.split()[0] for c in POINTS.split(", ")]
    kinds = dict(c.split() for c in POINTS.split(", "))
    rows = rows.select(*[F.col(c).cast(kinds[c]).alias(c) for c in names])
    samples = rows.select("split", "sample", "source_hash").distinct()
    open_ = samples if force else to_write(samples, root)
    system, at = open_fs(root)
    listed = posixpath.join(at, "data", job, "samples")
    scheme = root[: len(root) - len(at)] if root.endswith(at) else ""
    open_.write.json(scheme + listed)
    _publish(system, posixpath.join(at, "_log"), f"{time.time_ns():020d}-{job}.begin.json", {"job": job, "samples": scheme + listed})
    todo = spark.read.schema("split string, sample string, source_hash string").json(scheme + listed)
    part = rows.join(todo, ["split", "sample", "source_hash"], "left_semi")
    place = ["split", "sample", "source_hash", "chunk_idx"]
    part = part.select(*names).repartition(*place).sortWithinPartitions(*place, "point_id")
    part.write.format("chunkstore").option("job", f"{job}-chunks").mode("append").save(root)
    return job


def points(spark: SparkSession, root: str) -> DataFrame:
    """(split, sample, chunk_idx, row, x, y, z, segment, nx, ny, nz) of all committed chunks, arrays checked against their digests."""

    def load(batches):
        for batch in batches:
            for split, sample, idx, folder, n, *want in zip(*(batch[c] for c in ("split", "sample", "chunk_idx", "folder", "n", "coord_sha256", "segment_sha256", "normal_sha256"))):
                system, at = open_fs(folder)
                out = {"split": split, "sample": sample, "chunk_idx": idx, "row": np.arange(n)}
                for (array, (columns, kind)), digest in zip(ARRAYS.items(), want):
                    with system.open_input_stream(posixpath.join(at, f"{array}.npy")) as handle:
                        values = np.load(io.BytesIO(handle.read()), allow_pickle=False)
                    if hashlib.sha256(values.tobytes()).hexdigest() != digest:
                        raise ChunkError(f"{folder}/{array}.npy is not what was written")
                    for i, c in enumerate(columns):
                        out[c] = values[:, i] if values.ndim > 1 else values
                yield pd.DataFrame(out)

    schema = "split string, sample string, chunk_idx int, row long, x float, y float, z float, segment int, nx float, ny float, nz float"
    return chunks(spark, root).mapInPandas(load, schema)
