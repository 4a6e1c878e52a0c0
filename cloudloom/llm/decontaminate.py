"""Benchmark decontamination: Wu-Manber multi-pattern search over word windows.

Patterns are the windows of the benchmark items: ``size`` consecutive words of an item, or all words of a shorter
one.  Documents are searched word-wise: a shift table over blocks of two words tells how far a position can jump, a
shift of nought opens the bucket of patterns that end in that block, the bucket is split by its patterns' first word,
and a comparison of the words confirms.

Patterns go to the executors in blocks of at most ``block_windows`` windows, compressed texts of a few bytes a window;
a worker builds one block at a time, as arrays of word numbers, and searches its documents once for each block.
Documents are never shuffled.

Defined results: null or wordless text has no words and no hits; a null item text has no windows; windows of a null
item_id hit words but name no item; repeated rows are judged each on its own; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cloudloom.llm.common import slices, texts_of, with_columns

WINDOW = 10
BLOCK_WINDOWS = 200_000
_BLANK = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_BLANK).split()


def windows(words: list[bytes], size: int) -> Iterator[tuple[bytes, ...]]:
    for i in range(max(0, len(words) - size) + 1 if words else 0):
        yield tuple(words[i : i + size])


class WuManber:
    """Searches windows of one length, given as rows of word numbers.

    A block of two words is the number ``one * size + other``. Shifts stand in one dict of the blocks that occur, the
    windows themselves in one array sorted by their last block and first word; a bucket is a range of its rows.
    """

    def __init__(self, windows: np.ndarray, size: int):
        self.length, self.size = windows.shape[1], size
        self.block = min(2, self.length)
        self.jump = self.length - self.block + 1
        last, first = self._blocks(windows, self.length), windows[:, 0]
        order = np.lexsort((first, last))
        self.windows, self.order = windows[order], order
        last, first = last[order], first[order].astype(np.int64)
        # the far shifts first, so that nearer ones of the same block stay
        self.shift: dict[int, int] = {}
        for end in range(self.block, self.length + 1):
            self.shift.update(dict.fromkeys(self._blocks(windows, end).tolist(), self.length - end))
        starts = np.flatnonzero(np.concatenate([[True], (last[1:] != last[:-1]) | (first[1:] != first[:-1])]))
        self.bucket = dict(zip(zip(last[starts].tolist(), first[starts].tolist()), zip(starts.tolist(), [*starts[1:].tolist(), len(last)])))

    def _blocks(self, windows: np.ndarray, end: int) -> np.ndarray:
        other = windows[:, end - 1].astype(np.int64)
        return windows[:, end - 2].astype(np.int64) * self.size + other if self.block == 2 else other

    def scan(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """(start, window) of each occurrence in word numbers, -1 for words that no window has."""
        m, n, size, get, jump, two = self.length, len(words), self.size, self.shift.get, self.jump, self.block == 2
        i = m
        while i <= n:
            key = words[i - 1]
            if key < 0:
                i += m
                continue
            if two:
                if words[i - 2] < 0:
                    i += m - 1
                    continue
                key += words[i - 2] * size
            step = get(key, jump)
            if step:
                i += step
                continue
            lo, hi = self.bucket.get((key, words[i - m]), (0, 0))
            for row in range(lo, hi):
                if self.windows[row].tolist() == words[i - m : i]:
                    yield i - m, int(self.order[row])
            i += 1


class Patterns:
    """One block of windows: a searcher for each length, and the items of each window."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], size: int):
        self.number: dict[bytes, int] = {}
        by_length: dict[int, tuple[list, list]] = {}
        for item, words in items:
            row = np.array([self.number.setdefault(w, len(self.number)) for w in words], np.int32)
            if len(row):
                n = min(size, len(row))
                found, owner = by_length.setdefault(n, ([], []))
                found.append(np.lib.stride_tricks.sliding_window_view(row, n))
                owner += [item] * (len(row) - n + 1)
        self.searchers = []
        for n, (found, owner) in sorted(by_length.items()):
            every, back = np.unique(np.concatenate(found), axis=0, return_inverse=True)
            order = np.argsort(back.ravel(), kind="stable")
            edge = np.searchsorted(back.ravel()[order], np.arange(len(every) + 1))
            self.searchers.append((WuManber(every, len(self.number)), [owner[k] for k in order.tolist()], edge))

    def search(self, words: list[bytes], hit: bytearray, found: set) -> None:
        get = self.number.get
        known = [get(w, -1) for w in words]
        for a, owner, edge in self.searchers:
            for at, k in a.scan(known):
                hit[at : at + a.length] = b"\1" * a.length
                found.update(owner[edge[k] : edge[k + 1]])


def item_blocks(benchmark: DataFrame, size: int, block_windows: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items in blocks of at most ``block_windows`` windows; a longer item is cut with overlap."""
    block, room = [], block_windows
    for row in benchmark.select("item_id", "text").toLocalIterator():
        words = words_of((row["text"] or "").encode())
        while words:
            part = words[: room + size - 1]
            block.append((row["item_id"], part))
            room -= max(1, len(part) - size + 1)
            words = words[len(part) - size + 1 :] if len(part) < len(words) else []
            if room <= 0:
                yield block
                block, room = [], block_windows
    if block:
        yield block


def pressed(block: list[tuple[int | None, list[bytes]]]) -> bytes:
    return zlib.compress(pickle.dumps([(item, b" ".join(words)) for item, words in block]))


def loaded(block: bytes, size: int) -> Patterns:
    return Patterns([(item, text.split(b" ")) for item, text in pickle.loads(zlib.decompress(block))], size)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """All columns of ``docs`` and n_words, n_hit, n_items, items_sha256, contaminated."""
    sc = docs.sparkSession.sparkContext
    blocks = [sc.broadcast(pressed(b)) for b in item_blocks(benchmark, size, block_windows)]
    added = {"n_words": T.LongType(), "n_hit": T.LongType(), "n_items": T.LongType(), "items_sha256": T.StringType(), "contaminated": T.BooleanType()}
    shape = T.StructType([f for f in docs.schema if f.name not in added] + [T.StructField(n, t) for n, t in added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = loaded(blocks[0].value, size) if len(blocks) == 1 else None
        for batch in slices(batches, 4_000_000 if only else 32_000_000):
            texts = texts_of(batch)
            counts, hits, found = [0] * len(texts), [bytearray() for _ in texts], [set() for _ in texts]
            # one block of patterns and the words of one text are held at a time
            for k in range(max(1, len(blocks))):
                patterns = only or (loaded(blocks[k].value, size) if blocks else None)
                for i, text in enumerate(texts):
                    words = words_of(text)
                    if k == 0:
                        counts[i], hits[i] = len(words), bytearray(len(words))
                    if patterns:
                        patterns.search(words, hits[i], found[i])
            names = [sorted(str(i) for i in s if i is not None) for s in found]
            n_hit = [h.count(1) for h in hits]
            yield with_columns(batch, {
                "n_words": pa.array(counts, pa.int64()),
                "n_hit": pa.array(n_hit, pa.int64()),
                "n_items": pa.array(list(map(len, names)), pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]),
                "contaminated": pa.array([n > 0 for n in n_hit]),
            })
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, shape)


RESULT = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]

SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS k
      FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
s AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
      FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT r, i, s.n, item_id FROM s JOIN p ON s.k = p.k AND s.n = p.n),
c AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN m USING (r)
"""
