"""Point files as a Spark data source: ASCII ``.pcd`` and ``.ply`` in ASCII or little-endian binary.

``spark.read.format("pointfile").load(path)`` lists the files, reads each header once while planning, and cuts the
bodies into byte ranges; tasks seek to their range and parse in blocks, so a file of any size spreads over tasks in
bounded memory.  Ranges grow with the input until they have ``SPLIT_BYTES``, so their number does not, and a task reads
little more than its range.  A line belongs to the range in which it begins.  ``read_points`` adds the row check: the same job
counts the records of every file and fails when a file's count is not what its header says.

Every data line must parse: words where numbers are due fail the job, they are never skipped.
"""

from __future__ import annotations

import io
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cloudloom.session import cut
from cloudloom.sources.points import PointFormatError, parse_header

SPLIT_BYTES = 64_000_000
BLOCK_BYTES = 8_000_000
LINE_BYTES = 4096
#: As many ranges are cut, and one more a file, before ranges grow beyond the asked size.
RANGES = 64
ROWS = "file string, split string, sample string, at long, x double, y double, z double, c int, r int, g int, b int"
COUNTS = "file string, split string, sample string, points long, n long"

#: Number types of the PLY format.
PLY_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
CLASS_NAMES = ("classification", "class", "label", "scalar_Label")


def open_fs(path: str):
    """(file system, path) of a local path or a URI."""
    from pyarrow import fs

    path = re.sub(r"^file:/*", "/", path)
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


@dataclass
class Body:
    """What a header says: where records begin, how many there are, and how one is read (no dtype: text)."""

    start: int
    points: int
    columns: list[str]
    dtype: list[tuple[str, str]] | None = None


@dataclass
class Range(InputPartition):
    root: str
    file: str
    body: Body
    lo: int
    hi: int

    def names(self) -> tuple[str, str, str]:
        found = re.search(r"(?:^|/)(training|validation|test)/(?:.*/)?[^/]+$", self.file)
        return self.file, found[1] if found else "", os.path.splitext(os.path.basename(self.file))[0]


def _lines(handle, last: str, name: str) -> tuple[list[str], int]:
    """Header lines up to the one whose first word is ``last``, and the offset behind it."""
    out, size, held = [], 0, b""
    while True:
        end = held.find(b"\n")
        if end < 0:
            more = handle.read(4096)
            if not more:
                raise PointFormatError(f"{name}: no {last} line in the header")
            held += more
            continue
        raw, held = held[: end + 1], held[end + 1 :]
        size += len(raw)
        out.append(raw.decode("utf-8", "replace"))
        if out[-1].lstrip("﻿").split()[:1] == [last]:
            return out, size


def pcd_body(handle, name: str) -> Body:
    lines, start = _lines(handle, "DATA", name)
    try:
        found = parse_header(lines)
    except PointFormatError as e:
        raise PointFormatError(f"{name}: {e}") from None
    return Body(start, found["points"], ["x", "y", "z", "c"])


def ply_body(handle, name: str) -> Body:
    lines, start = _lines(handle, "end_header", name)

    def need(ok: bool, message: str) -> None:
        if not ok:
            raise PointFormatError(f"{name}: {message}")

    words = [w for w in (line.split() for line in lines) if w and w[0] not in ("comment", "obj_info")]
    need(words[0] == ["ply"], "not a PLY file")
    form = next((w[1] for w in words if w[0] == "format"), "")
    need(form in ("ascii", "binary_little_endian"), f"format {form!r} is not read")
    elements = [w for w in words if w[0] == "element"]
    need(bool(elements) and elements[0][1] == "vertex", "vertex must be the first element")
    first = words.index(elements[0])
    after = words.index(elements[1]) if len(elements) > 1 else len(words)
    props = [w for w in words[first + 1 : after] if w[0] == "property"]
    need(all(len(p) == 3 and p[1] in PLY_TYPES for p in props), "vertices must have plain number properties")
    names = [{"red": "r", "green": "g", "blue": "b"}.get(p[2], "c" if p[2] in CLASS_NAMES else p[2]) for p in props]
    need({"x", "y", "z"} <= set(names), "x, y and z are needed")
    points = int(elements[0][2])
    if form == "ascii":
        need(len(elements) == 1 or all(int(e[2]) == 0 for e in elements[1:]), "ASCII files may hold vertices only")
        return Body(start, points, names)
    return Body(start, points, names, [(n, "<" + PLY_TYPES[p[1]]) for n, p in zip(names, props)])


HEADERS = {".pcd": pcd_body, ".ply": ply_body}


def ranges(path: str, split_bytes: int) -> list[Range]:
    """Byte ranges of all point files under ``path``; hidden files and folders are passed over.

    A range has ``split_bytes``, or more where that would make over ``RANGES`` of them, but then no more than ``SPLIT_BYTES``.
    """
    from pyarrow import fs

    system, at = open_fs(path)
    info = system.get_file_info(at)
    files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    wanted = lambda f: f.type == fs.FileType.File and os.path.splitext(f.path)[1] in HEADERS and not re.search(r"(?:^|/)[._]", f.path[len(at) :])
    files = sorted(filter(wanted, files), key=lambda f: f.path)
    split_bytes = max(split_bytes, min(SPLIT_BYTES, -(-sum(f.size for f in files) // RANGES)))
    out = []
    for f in files:
        with system.open_input_stream(f.path) as handle:
            body = HEADERS[os.path.splitext(f.path)[1]](handle, f.path)
        end = f.size
        if body.dtype:
            width = np.dtype(body.dtype).itemsize
            end = body.start + body.points * width
            if f.size < end:
                raise PointFormatError(f"{f.path}: {body.points} points are said, {(f.size - body.start) // width} are there")
            step = max(1, split_bytes // width) * width
        else:
            step = split_bytes
        for lo in range(body.start, max(end, body.start + 1), step):
            out.append(Range(path, f.path, body, lo, min(lo + step, end)))
    return out


def _text_blocks(handle, r: Range) -> Iterator[tuple[int, bytes]]:
    """(offset, whole lines) of a range: from the first line that begins in it to the end of the last one."""
    at = r.lo
    if at > r.body.start:
        handle.seek(at - 1)
        at -= 1
        skip = True
    else:
        handle.seek(at)
        skip = False
    held, ahead = b"", LINE_BYTES
    while True:
        # what is left of the range and the end of its last line, looked for in growing steps
        more = handle.read(min(BLOCK_BYTES, max(r.hi - at - len(held), 0) + ahead))
        ahead = min(2 * ahead, BLOCK_BYTES)
        held += more
        if skip:
            end = held.find(b"\n")
            if end < 0:
                at += len(held)
                held = b""
                if not more:
                    return
                continue
            at, held, skip = at + end + 1, held[end + 1 :], False
        if at >= r.hi:
            return
        if not more:
            if held:
                yield at, held
            return
        # the last line wanted is the one that holds byte hi - 1
        stop = held.find(b"\n", r.hi - 1 - at) if at + len(held) >= r.hi else -1
        if stop >= 0:
            yield at, held[: stop + 1]
            return
        cut = held.rfind(b"\n") + 1
        if at + len(held) < r.hi and cut:
            yield at, held[:cut]
            at, held = at + cut, held[cut:]


def _full_lines(text: bytes) -> np.ndarray:
    """Offsets of the lines that are not blank."""
    buf = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero(buf == 10)
    starts = np.concatenate([[0], ends + 1])
    starts = starts[starts < len(buf)]
    filled = np.concatenate([[0], np.cumsum(buf > 32)])
    return starts[filled[np.append(starts[1:], len(buf))] > filled[starts]]


def _batch(r: Range, at: np.ndarray, cols: dict[str, np.ndarray]) -> pa.RecordBatch:
    n = len(at)
    file, split, sample = r.names()
    fixed = [pa.array([v] * n, pa.string()).dictionary_encode().cast(pa.string()) for v in (file, split, sample)]
    out = [*fixed, pa.array(at, pa.int64()), *[pa.array(np.asarray(cols[a], float)) for a in "xyz"]]
    for name in ("c", "r", "g", "b"):
        out.append(pa.array(np.asarray(cols[name]).astype(np.int32), pa.int32()) if name in cols else pa.nulls(n, pa.int32()))
    return pa.RecordBatch.from_arrays(out, names=["file", "split", "sample", "at", "x", "y", "z", "c", "r", "g", "b"])


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.count = options["path"], options.get("mode", "rows") == "count"
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[Range]:
        return ranges(self.path, self.split_bytes) or [Range(self.path, "", Body(0, 0, []), 0, 0)]

    def read(self, r: Range) -> Iterator[pa.RecordBatch]:
        if not r.file:
            return
        system, _ = open_fs(r.root)
        if self.count:
            n = (r.hi - r.lo) // np.dtype(r.body.dtype).itemsize if r.body.dtype else 0
            if not r.body.dtype:
                with system.open_input_file(r.file) as handle:
                    n = sum(len(_full_lines(text)) for _, text in _text_blocks(handle, r))
            file, split, sample = r.names()
            yield pa.RecordBatch.from_pydict({"file": [file], "split": [split], "sample": [sample], "points": [r.body.points], "n": [n]})
            return
        with system.open_input_file(r.file) as handle:
            if r.body.dtype:
                kind = np.dtype(r.body.dtype)
                step = BLOCK_BYTES // kind.itemsize * kind.itemsize
                for lo in range(r.lo, r.hi, step):
                    handle.seek(lo)
                    rows = np.frombuffer(handle.read(min(step, r.hi - lo)), kind)
                    yield _batch(r, lo + np.arange(len(rows)) * kind.itemsize, {n: rows[n] for n in kind.names})
                return
            names = [n if n in ("x", "y", "z", "c", "r", "g", "b") else None for n in r.body.columns]
            use = [i for i, n in enumerate(names) if n]
            kinds = {i: "float64" if names[i] in "xyz" else "int32" for i in use}
            for at, text in _text_blocks(handle, r):
                starts = _full_lines(text)
                if not len(starts):
                    continue
                try:
                    rows = pd.read_csv(io.BytesIO(text), sep=r"\s+", header=None, usecols=use, dtype=kinds, engine="c")
                except ValueError as e:
                    raise PointFormatError(f"{r.file}: bytes {at} to {at + len(text)}: {e}") from None
                if len(rows) != len(starts):
                    raise PointFormatError(f"{r.file}: bytes {at} to {at + len(text)}: {len(rows)} rows on {len(starts)} lines")
                yield _batch(r, at + starts, {names[i]: rows[i].to_numpy() for i in use})


class PointFiles(DataSource):
    """Options: path, splitBytes, mode (``rows``, or ``count`` for the number of records of each byte range)."""

    @classmethod
    def name(cls) -> str:
        return "pointfile"

    def schema(self) -> str:
        return COUNTS if self.options.get("mode", "rows") == "count" else ROWS

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PointFiles)


def counts(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file, split, sample, points, n): what each header says and how many records there are."""
    register(spark)
    found = spark.read.format("pointfile").option("mode", "count").option("splitBytes", split_bytes).load(path)
    return found.groupBy("file", "split", "sample").agg(F.max("points").alias("points"), F.sum("n").alias("n"))


def read_points(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All points under ``path``: file, split, sample, at (byte offset), x, y, z, c, r, g, b.

    ``split`` is the training, validation or test folder the file lies in, else empty, so equal names in two splits stay
    apart.  The job fails when a file does not hold as many records as its header says.
    """
    register(spark)
    rows = spark.read.format("pointfile").option("splitBytes", split_bytes).load(path)
    wrong = F.format_string("%s: %d points are said, %d are there", "file", "points", "n")
    ok = F.when(F.col("points") == F.col("n"), True).otherwise(F.raise_error(wrong).cast("boolean"))
    checked = counts(spark, path, split_bytes).where(ok).select("file")
    # one row a file, as the planner's list has: the points stay where they were read
    return rows.join(F.broadcast(checked), "file")


def _header(kind: str, n: int) -> str:
    if kind == "pcd":
        return f"# points\nVERSION 0.7\nFIELDS x y z classification rgb\nSIZE 4 4 4 1 4\nTYPE F F F U F\nCOUNT 1 1 1 1 1\nWIDTH {n}\nHEIGHT 1\nPOINTS {n}\nDATA ascii\n"
    form = "ascii" if kind == "ascii_ply" else "binary_little_endian"
    rgb = "".join(f"property uchar {c}\n" for c in ("red", "green", "blue"))
    return f"ply\nformat {form} 1.0\nelement vertex {n}\nproperty float x\nproperty float y\nproperty float z\nproperty uchar classification\n{rgb}end_header\n"


_RECORD = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("c", "u1"), ("r", "u1"), ("g", "u1"), ("b", "u1")])


def _body(kind: str, rows: pd.DataFrame) -> bytes:
    if kind == "ply":
        out = np.empty(len(rows), _RECORD)
        for name in _RECORD.names:
            out[name] = rows[name]
        return out.tobytes()
    tail = "13033652" if kind == "pcd" else None
    cols = [rows[a].map("{:.6f}".format) for a in "xyz"] + [rows["c"].astype(int).astype(str)]
    cols += [tail] if tail else [rows[a].astype(int).astype(str) for a in "rgb"]
    line = cols[0]
    for c in cols[1:]:
        line = line + " " + c
    return ("\n".join(line) + "\n").encode()


def write_points(points: DataFrame, root: str, kind: str = "pcd", file: str = "file") -> DataFrame:
    """Writes x, y, z, c (and r, g, b) of each ``file`` as one point file and returns (file, n), which runs the job.

    ``kind``: pcd, ply (binary) or ascii_ply.  A file is streamed: its body goes to a hidden part beside it, header and body are
    joined once the count is known, and the file appears under its name complete.  ``file`` is a path below ``root``
    without suffix; the caller chooses it so that files have the size they should have.
    """
    if kind not in ("pcd", "ply", "ascii_ply"):
        raise ValueError(f"unknown kind of point file: {kind}")
    suffix = ".pcd" if kind == "pcd" else ".ply"
    colours = [F.col(c).cast("int").alias(c) if c in points.columns else F.lit(0).alias(c) for c in "rgb"]
    rows = points.select(F.col(file).alias("file"), *[F.col(a).cast("double").alias(a) for a in "xyz"], F.col("c").cast("int").alias("c"), *colours)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, at = open_fs(root)
        now, part, handle, n = None, "", None, 0

        def finish() -> Iterator[pd.DataFrame]:
            if now is None:
                return
            handle.close()
            whole = f"{part}.whole"
            with system.open_output_stream(whole) as out, system.open_input_stream(part) as body:
                out.write(_header(kind, n).encode())
                while block := body.read(BLOCK_BYTES):
                    out.write(block)
            system.move(whole, f"{at}/{now}{suffix}")
            system.delete_file(part)
            yield pd.DataFrame({"file": [now], "n": [n]})

        for batch in batches:
            for name, rows_ in batch.groupby("file", sort=False):
                if name != now:
                    yield from finish()
                    folder, _, base = f"{at}/{name}".rpartition("/")
                    system.create_dir(folder, recursive=True)
                    now, part, n = name, f"{folder}/.{base}.{uuid.uuid4().hex}", 0
                    handle = system.open_output_stream(part)
                handle.write(_body(kind, rows_))
                n += len(rows_)
        yield from finish()

    return cut(rows.repartition("file").sortWithinPartitions("file").mapInPandas(run, "file string, n long"))
