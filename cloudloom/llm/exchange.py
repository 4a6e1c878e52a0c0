"""Questions that groups of documents ask of the whole corpus, as packed arrays.

Documents are dealt into groups of about ``GROUP_BYTES`` by a hash of id and text. A group hashes its items, drops its
own repeats and sends what is left to buckets by the hash's leading bits: one row a group and bucket, however many
documents share an item, so no item makes a hot row group. A bucket compares what all groups sent and answers each in
the order in which it asked. The documents' own shuffle is one exchange that Spark reuses for every pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.common import GROUP_BYTES, group_count, id_text, measure, slices
from cloudloom.llm.pack import dealt, unpack
from cloudloom.llm.text import U

ASKED = "bucket long, g long, a binary, b binary"
ANSWERED = "g long, bucket long, a binary, b binary"
_ANSWERED = pa.schema([("g", pa.int64()), ("bucket", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
_ASKED = pa.schema([("bucket", pa.int64()), ("g", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])


class Groups:
    """Documents in groups: ``docs`` has (g, chunk), ``rows`` the rows with their g, not yet moved."""

    def __init__(self, docs: DataFrame, per: int = GROUP_BYTES):
        own = id_text(docs)
        _, size = measure(own)
        self.count = group_count(size, per)
        self.bits = (self.count - 1).bit_length()
        own = self.rows = own.withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(self.count)))

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in dealt(slices(batches, 16_000_000), lambda b: b.column("g").to_numpy()):
                yield batch

        self.docs = own.mapInArrow(send, "g long, chunk binary")

    def ask(self, work: Callable, answers: DataFrame | None = None) -> DataFrame:
        """Rows for buckets; ``work(ids, texts, g, answers)`` yields (bucket, a, b)."""

        def run(g: int, docs: pa.Table, told: pa.Table | None) -> pa.Table:
            rows = list(work(*load(docs), g, told))
            return pa.table({"bucket": [r[0] for r in rows], "g": [g] * len(rows), "a": [r[1] for r in rows], "b": [r[2] for r in rows]}, _ASKED)

        return self._run(run, ASKED, answers)

    def each(self, work: Callable, schema: str, answers: DataFrame | None = None) -> DataFrame:
        """A table of each group: ``work(ids, texts, g, answers)``."""
        return self._run(lambda g, docs, told: work(*load(docs), g, told), schema, answers)

    def _run(self, run: Callable, schema: str, answers: DataFrame | None) -> DataFrame:
        def alone(key: tuple, docs: pa.Table) -> pa.Table:
            out = run(key[0].as_py(), docs, None)
            pa.default_memory_pool().release_unused()
            return out

        def both(key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
            out = run(key[0].as_py(), docs, told)
            pa.default_memory_pool().release_unused()
            return out

        if answers is None:
            return self.docs.groupBy("g").applyInArrow(alone, schema)

        return self.docs.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(both, schema)


def answered(asked: DataFrame, work: Callable) -> DataFrame:
    """``work(bucket, groups, a, b)`` gives the answers (a, b) of one bucket, in the order of its rows."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("g")
        bucket = key[0].as_py()
        out = work(bucket, table.column("g").to_pylist(), table.column("a").to_pylist(), table.column("b").to_pylist())
        return pa.table({"g": table.column("g"), "bucket": [bucket] * table.num_rows, "a": [o[0] for o in out], "b": [o[1] for o in out]}, _ANSWERED)

    return asked.groupBy("bucket").applyInArrow(run, ANSWERED)


def load(docs: pa.Table) -> tuple[list[int | None], list[bytes]]:
    """Ids and texts of a group, by id (null last), then text."""
    if not docs.num_rows:
        return [], []
    t = unpack(docs.column("chunk"))
    ids = t.column("doc_id").to_pylist()
    texts = [x or b"" for x in t.column("text").cast(pa.binary()).to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
    return [ids[i] for i in order], [texts[i] for i in order]


def bounds(ordered: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket's part of sorted hashes begins; one more entry at the end."""
    if not bits:
        return np.array([0, len(ordered)])
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << U(64 - bits)
    return np.concatenate([[0], np.searchsorted(ordered, edges), [len(ordered)]])


def below(h: np.ndarray, bits: int, size: int) -> np.ndarray:
    """The ``size`` bits under the bucket's bits."""
    return (h << U(bits)) >> U(64 - size)


def told_in_order(told: pa.Table | None) -> list[tuple[int, bytes, bytes]]:
    """Answers (bucket, a, b) by bucket."""
    if told is None or not told.num_rows:
        return []
    told = told.sort_by("bucket")
    return list(zip(told.column("bucket").to_pylist(), told.column("a").to_pylist(), told.column("b").to_pylist()))


def firsts(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal entries begins."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)
