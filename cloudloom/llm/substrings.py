"""Substring dedup over words: fixed-block anchors, every rolling window probed, hits extended to exact repeats.

A window of ``WINDOW`` words contains a whole block of ``BLOCK`` words that starts at a multiple of ``BLOCK`` in its
document, so those blocks index every window. Three passes over the same groups of documents:

1. each group sends the hashes of all its rolling runs of ``BLOCK`` words, marking those that are blocks; a bucket
   answers which of them meet a block in another document (30 hash bits below the bucket's: a chance meeting only lets
   a run through to the second pass);
2. windows all of whose blocks could have hits are extended: the whole window's 64-bit hash goes out with the smallest
   id that has it; a bucket answers where some document of smaller id has the same words;
3. hits are joined to maximal repeats and their words removed.

Whatever number of documents share a passage, each group sends it once, and only group sums meet in a bucket.

Defined results: null text has no words; a null id is larger than all ids and removes nothing from others; rows of equal
id do not remove each other's words; removal is judged on the input; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cloudloom.llm.common import GROUP_BYTES
from cloudloom.llm.exchange import Groups, answered, below, bounds, firsts, told_in_order
from cloudloom.llm.text import U, Words, cover, member, run_starts, runs

WINDOW, BLOCK = 13, 7
NO_ID = np.iinfo(np.int64).max
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


class Probes:
    """The rolling runs of a group's documents: distinct hashes in order, with marks."""

    def __init__(self, words: Words, size: int):
        self.valid = run_starts(words.first, size)
        self.hash = runs(words.hash, size)
        doc = words.doc_of()[: len(self.hash)]
        at = np.flatnonzero(self.valid)
        h = self.hash[at]
        order = np.argsort(h)
        self.at = at[order]
        h = h[order]
        self.first = firsts(h)
        self.h = h[self.first]
        d = doc[self.at]
        self.low = np.minimum.reduceat(d, self.first) if len(d) else d
        self.high = np.maximum.reduceat(d, self.first) if len(d) else d

    def spread(self, flag: np.ndarray) -> np.ndarray:
        """A flag of each distinct hash, put at all its run positions."""
        out = np.zeros(len(self.hash), bool)
        out[self.at] = np.repeat(flag, np.diff(np.append(self.first, len(self.at))))
        return out


def id_keys(ids: list[int | None]) -> np.ndarray:
    return np.array([NO_ID if i is None else i for i in ids], np.int64)


def ask_blocks(bits: int):
    def work(ids: list, texts: list[bytes], g: int, told) -> Iterator[tuple[int, bytes, bytes]]:
        w = Words(texts)
        p = Probes(w, BLOCK)
        if not len(p.h):
            return
        place = p.at - np.repeat(w.first[:-1], w.counts())[p.at]
        block = np.logical_or.reduceat(place % BLOCK == 0, p.first)
        v = (below(p.h, bits, 30) << U(2) | (p.low != p.high).astype(U) << U(1) | block.astype(U)).astype("<u4")
        edge = bounds(p.h, bits)
        for k in np.flatnonzero(np.diff(edge)):
            yield int(k), v[edge[k] : edge[k + 1]].tobytes(), b""

    return work


def answer_blocks(bucket: int, groups: list[int], a: list[bytes], b: list[bytes]) -> list[tuple[bytes, bytes]]:
    each = [np.frombuffer(x, "<u4") for x in a]
    v = np.concatenate(each)
    order = np.argsort(v >> np.uint32(2), kind="stable")
    h = v[order] >> np.uint32(2)
    first = firsts(h)
    n = np.diff(np.append(first, len(h)))
    marks = np.bitwise_or.reduceat(v[order] & np.uint32(3), first)
    live = (marks & 1 > 0) & ((n > 1) | (marks & 2 > 0))
    flag = np.empty(len(v), bool)
    flag[order] = np.repeat(live, n)
    cut = np.cumsum([len(x) for x in each])[:-1]
    return [(np.packbits(f).tobytes(), b"") for f in np.split(flag, cut)]


def ask_windows(bits: int):
    def work(ids: list, texts: list[bytes], g: int, told) -> Iterator[tuple[int, bytes, bytes]]:
        w = Words(texts)
        p = Probes(w, BLOCK)
        if not len(p.h):
            return
        edge = bounds(p.h, bits)
        live = np.zeros(len(p.h), bool)
        for k, flags, _ in told_in_order(told):
            live[edge[k] : edge[k + 1]] = np.unpackbits(np.frombuffer(flags, np.uint8), count=edge[k + 1] - edge[k]).view(bool)
        hit = np.concatenate([[0], np.cumsum(p.spread(live))])
        inside = run_starts(w.first, WINDOW)
        at = np.flatnonzero(inside)
        span = WINDOW - BLOCK + 1
        at = at[hit[at + span] > hit[at]]
        h = runs(w.hash, WINDOW)[at]
        own = id_keys(ids)[w.doc_of()[at]]
        order = np.argsort(h)
        h, own = h[order], own[order]
        first = firsts(h)
        if not len(first):
            return
        low, high = np.minimum.reduceat(own, first), np.maximum.reduceat(own, first)
        h = h[first]
        edge = bounds(h, bits)
        for k in np.flatnonzero(np.diff(edge)):
            some = slice(edge[k], edge[k + 1])
            yield int(k), h[some].tobytes(), pack_ids(low[some], high[some])

    return work


def pack_ids(low: np.ndarray, high: np.ndarray) -> bytes:
    """Two id columns; one is stored where they agree, and ids take the width that their range needs."""
    base = int(low.min())
    apart = np.flatnonzero(high != low)
    top = int(max(low.max(), high[(high != NO_ID)].max(initial=base)))
    width = "<u4" if top - base < (1 << 32) - 1 else "<u8"
    none = np.iinfo(np.dtype(width)).max

    def put(x: np.ndarray) -> bytes:
        return np.where(x == NO_ID, none, (x - base).astype(np.uint64)).astype(width).tobytes()

    if low.max() == NO_ID:
        top_low = low[low != NO_ID]
        width = "<u8" if not len(top_low) or int(top_low.max()) - base >= (1 << 32) - 1 else width
        none = np.iinfo(np.dtype(width)).max
    head = np.array([base, len(low), len(apart), int(width[-1])], "<i8").tobytes()
    return head + put(low) + apart.astype("<u4").tobytes() + put(high[apart])


def unpack_ids(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    base, n, m, size = np.frombuffer(data, "<i8", 4).tolist()
    width = np.dtype(f"<u{size}")

    def take(count: int, at: int) -> np.ndarray:
        x = np.frombuffer(data, width, count, at)
        return np.where(x == np.iinfo(width).max, NO_ID, (x.astype(np.uint64)).astype(np.int64) + base)

    low = take(n, 32)
    apart = np.frombuffer(data, "<u4", m, 32 + n * size)
    high = low.copy()
    high[apart] = take(m, 32 + n * size + 4 * m)
    return low, high


def answer_windows(bucket: int, groups: list[int], a: list[bytes], b: list[bytes]) -> list[tuple[bytes, bytes]]:
    """To each group: the hashes of its windows that a smaller id has, with that id where documents of the group differ."""
    each = [np.frombuffer(x, U) for x in a]
    both = [unpack_ids(x) for x in b]
    h, low = np.concatenate(each), np.concatenate([x[0] for x in both])
    high = np.concatenate([x[1] for x in both])
    order = np.argsort(h)
    first = firsts(h[order])
    least = np.empty(len(h), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(low[order], first), np.diff(np.append(first, len(h))))
    out = []
    at = 0
    for x in each:
        to = at + len(x)
        hit = np.flatnonzero(least[at:to] < high[at:to])
        # a window of which all copies in the group have the same larger id needs no id with it
        plain = hit[least[at:to][hit] < low[at:to][hit]]
        mixed = hit[least[at:to][hit] >= low[at:to][hit]]
        out.append((x[plain].tobytes(), x[mixed].tobytes() + least[at:to][mixed].tobytes()))
        at = to
    return out


def remove(ids: list, texts: list[bytes], g: int, told) -> pa.Table:
    w = Words(texts)
    answers = told_in_order(told)
    plain = np.sort(np.concatenate([np.empty(0, U), *(np.frombuffer(a, U) for _, a, _ in answers)]))
    mixed = [np.frombuffer(b, U) for _, _, b in answers]
    mixed_h = np.concatenate([np.empty(0, U), *(m[: len(m) // 2] for m in mixed)])
    mixed_id = np.concatenate([np.empty(0, np.int64), *(m[len(m) // 2 :].view(np.int64) for m in mixed)])
    order = np.argsort(mixed_h)
    mixed_h, mixed_id = mixed_h[order], mixed_id[order]
    at = np.flatnonzero(run_starts(w.first, WINDOW))
    h = runs(w.hash, WINDOW)[at]
    hit = member(h, plain)
    some = np.flatnonzero(member(h, mixed_h))
    own = id_keys(ids)[w.doc_of()[at[some]]]
    hit[some] |= mixed_id[np.searchsorted(mixed_h, h[some])] < own
    gone = cover(at[hit], WINDOW, int(w.first[-1]))
    n_gone = np.concatenate([[0], np.cumsum(gone)])[w.first]
    out = []
    for i, text in enumerate(texts):
        if n_gone[i + 1] > n_gone[i]:
            lo, hi = w.first[i], w.first[i + 1]
            kept = b" ".join([w.raw[w.start[j] : w.end[j]] for j in (lo + np.flatnonzero(~gone[lo:hi])).tolist()])
        else:
            kept = b" ".join(text.split())
        out.append(hashlib.sha256(kept).hexdigest())
    return pa.table({"doc_id": ids, "n_words": w.counts(), "n_removed": np.diff(n_gone), "kept_sha256": out}, _RESULT)


def dedup_words(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    groups = Groups(docs, group_bytes)
    live = answered(groups.ask(ask_blocks(groups.bits)), answer_blocks)
    found = answered(groups.ask(ask_windows(groups.bits), live), answer_windows)
    return groups.each(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string", found)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, i, array_to_string(w[i : i + 12], ' ') AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) > 12)),
f AS (SELECT k, min(doc_id) AS m FROM s GROUP BY k),
h AS (SELECT r, i FROM s JOIN f USING (k) WHERE m IS NOT NULL AND (doc_id IS NULL OR m < doc_id)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS j FROM h),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS j FROM d WHERE len(w) > 0),
kept AS (SELECT p.r, string_agg(w[p.j], ' ' ORDER BY p.j) AS t FROM p LEFT JOIN gone ON p.r = gone.r AND p.j = gone.j WHERE gone.j IS NULL GROUP BY p.r),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN n USING (r)
"""
