"""MinHash fingerprints of documents and of texts edited with their neighbour; near-duplicate groups by bands.

A fingerprint holds the minima of ``PERMUTATIONS`` universal hashes (multiply and add modulo 2**64, odd multipliers)
over the text's ``SHINGLE``-word shingles, 16 bits each. A shorter text is one shingle; no word, no shingle: all ones.
The share of equal places estimates the Jaccard similarity.

``edited`` pairs every document with the next one in descending doc_id: an id-only pass finds the range bounds, then
texts move once, compressed, to their range, and the first document of a range goes to the range before it as well.

Defined results: null text is empty; null ids come last; equal ids are ordered by the hash of their text; rows that
repeat wholly are neighbours of each other; a single document is its own next; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.common import batch_of, group_count, id_text, measure, slices, texts_of
from cloudloom.llm.pack import dealt, unpack
from cloudloom.llm.text import U, Words, distinct, mix, run_starts, runs

SHINGLE = 5
PERMUTATIONS = 128
BANDS = 32
LIKE = 0.8

_RANDOM = np.random.default_rng(20260101)
_MULTIPLY = _RANDOM.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) << U(1) | U(1)
_ADD = _RANDOM.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingles(texts: list[bytes], size: int = SHINGLE, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles (repeats kept), and where each text's begin."""
    w = Words(texts, lower)
    n = w.counts()
    h = runs(w.hash, size)
    inside = run_starts(w.first, size)
    made = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(int(first[-1]), U)
    long = np.repeat(n >= size, made)
    out[long] = h[inside]
    for i in np.flatnonzero((n > 0) & (n < size)):
        out[first[i]] = mix(np.array([np.bitwise_xor.reduce(mix(w.hash[w.first[i] : w.first[i + 1]] + U(7) * np.arange(1, n[i] + 1, dtype=U)))]) + U(int(n[i])))[0]
    return out, first


def signatures(texts: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """One row of PERMUTATIONS 16-bit numbers a text."""
    h, first = shingles(texts, size)
    out = np.full((PERMUTATIONS, len(texts)), 0xFFFF, np.uint16)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        starts, t = first[:-1][some], np.empty_like(h)
        for k in range(PERMUTATIONS):
            np.multiply(h, _MULTIPLY[k], out=t)
            t += _ADD[k]
            out[k, some] = mix(np.minimum.reduceat(t, starts)) & U(0xFFFF)
    return np.ascontiguousarray(out.T)


def edit(text: str, following: str) -> str:
    """The last half (floor) of a text's code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    own = id_text(docs).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("h", F.xxhash64("text"))
    _, size = measure(own)
    heads = own.select("doc_id", "h").repartitionByRange(group_count(size), F.col("doc_id").desc_nulls_last(), F.col("h").desc())
    heads = heads.groupBy(F.spark_partition_id().alias("p")).agg(F.max(F.struct("doc_id", "h")).alias("k")).collect()  # one row a range
    rising = sorted((r["k"]["doc_id"] is not None, r["k"]["doc_id"] or 0, r["k"]["h"]) for r in heads)
    ranges = len(rising)
    schema = pa.schema([(f.split()[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.split()[1]]) for f in _EDITED.split(", ")])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def doubled() -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 4_000_000):
                keys = [(i is not None, i or 0, h) for i, h in zip(batch.column("doc_id").to_pylist(), batch.column("h").to_pylist())]
                at = [bisect_left(rising, k) for k in keys]
                lead = [j for j, k in enumerate(keys) if rising[at[j]] == k]
                rows = pa.array([*range(len(keys)), *lead], pa.int64())
                part = [*at, *((at[j] + 1) % ranges for j in lead)]
                ghost = [False] * len(keys) + [True] * len(lead)
                full = batch.take(rows)
                yield pa.RecordBatch.from_arrays([*full.columns, pa.array(ghost), pa.array(part, pa.int64())], names=[*full.schema.names, "ghost", "part"])

        yield from dealt(doubled(), lambda b: b.column("part").to_numpy(), ("part", "chunk"))

    def work(table: pa.Table) -> pa.Table:
        t = unpack(table.column("chunk"))
        ids, hs, ghost, texts = (t.column(c).to_pylist() for c in ("doc_id", "h", "ghost", "text"))
        order = sorted(range(len(ids)), key=lambda i: (not ghost[i], ids[i] is not None, ids[i] or 0, hs[i]), reverse=True)
        n = ghost.count(False)
        order = order[: n + 1]  # own rows in falling order, then one copy of the next range's first
        out = []
        at = 0
        while at < n:
            to, held = at, 0
            while to < n and (to == at or held < 1_000_000):
                held += len(texts[order[to]])
                to += 1
            part = [texts[i] for i in order[at : to + 1]]
            changed = [edit(a, b) for a, b in zip(part, part[1:])]
            raw = [c.encode() for c in changed]
            sig = signatures([p.encode() for p in part])
            new = signatures(raw)
            out.append(batch_of({
                "doc_id": [ids[i] for i in order[at:to]],
                "n_chars": [len(p) for p in part[:-1]],
                "edited_sha256": [hashlib.sha256(r).hexdigest() for r in raw],
                "fingerprint": [s.tobytes().hex() for s in sig[:-1]],
                "edited_fingerprint": [s.tobytes().hex() for s in new],
                "near_edited": (sig[:-1] == new).mean(1),
                "near_next": (sig[:-1] == sig[1:]).mean(1),
            }, schema))
            at = to
        return pa.Table.from_batches(out, schema)

    return own.mapInArrow(send, "part long, chunk binary").groupBy("part").applyInArrow(work, _EDITED)


def near_duplicates(docs: DataFrame, like: float = LIKE, block: int | None = None) -> DataFrame:
    """(doc_id, group) for every row: the smallest id of the group that bands and verified likeness connect.

    Texts that are equal are one node. Documents that share bands form families, whose sets are searched in blocks as
    in the Jaccard join: links between components are verified on whole sets, whatever the likeness to a band's smallest
    id, and no group's pairs are spelt out. Null ids and wordless texts stand alone (null ids with a null group).
    """
    from cloudloom.llm import jaccard
    from cloudloom.llm.common import keep
    from cloudloom.operators.graph import components

    own = id_text(docs).where("doc_id IS NOT NULL").withColumn("text", F.coalesce("text", F.lit("")))
    same = own.select("doc_id", F.sha2("text", 256).alias("s"), F.xxhash64("text").alias("h"))
    nodes = keep(same.groupBy("s").agg(F.min("doc_id").alias("rep")), "near-nodes")
    schema = "doc_id long, n int, tokens binary, prefix array<long>"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1_000_000):
            texts = texts_of(batch)
            sig = signatures(texts)
            h, first = shingles(texts)
            rows = PERMUTATIONS // BANDS
            bands = []
            for i in range(len(texts)):
                some = first[i + 1] > first[i]
                bands.append([int.from_bytes(hashlib.blake2b(sig[i, b * rows : (b + 1) * rows].tobytes(), digest_size=8, salt=b.to_bytes(2)).digest(), signed=True) for b in range(BANDS)] if some else [])
            parts = [distinct(h[first[i] : first[i + 1]]) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in parts], pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n", "tokens", "prefix"])

    reps = own.join(nodes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    signed = keep(reps.select("doc_id", "text").mapInArrow(sign, schema), "near-signed")
    edges = jaccard.links(signed.where("n > 0"), block or jaccard.BLOCK, round(100 * like, 9))
    groups = components(nodes.select(F.col("rep").alias("node")).distinct(), edges)
    of = nodes.join(groups, F.col("rep") == F.col("node")).select("s", F.col("component").alias("group"))
    found = same.join(of, "s").select("doc_id", "group")
    return found.unionByName(docs.where("doc_id IS NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("group")))
