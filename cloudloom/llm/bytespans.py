"""Suffix-array dedup of byte strings: every byte covered by a ``SIZE``-byte string that starts anywhere else too goes.

A window of SIZE bytes names its anchor: the leftmost smallest hash among its ``GRAM``-byte strings, a function of the
window's bytes alone. Windows of one anchor stand side by side; together they are a span of at most 2 * SIZE - GRAM
bytes. So equal windows meet at equal anchors, and only spans need comparing:

1. groups of documents send each distinct (anchor, span digest) with whether it repeats in the group; buckets answer:
   alone - nothing in it repeats; repeated as a whole - all its windows repeat; or its anchor has other spans;
2. spans of the last kind travel once each, with one copy of the whole-repeated spans of their anchor; a bucket builds
   the suffix array of its spans by two-stage sorting, and adjacent common prefixes of SIZE bytes mark the windows. An
   anchor with more than ``CROWD`` distinct spans does not gather in one bucket: its windows are counted one by one by
   their 64-bit digests, spread over all buckets, which decides the same question;
3. marked windows are joined to maximal runs and cut out.

However many documents share a passage, a group sends it once. Long texts are cut in pieces that overlap by SIZE - 1
bytes for anchor search, so memory is bounded by the group, not by the anchors.

Defined results: null text is empty; rows of equal id are different documents, as are rows that repeat wholly (all of
a repeated text of SIZE bytes or more goes); shorter texts keep all; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from cloudloom.llm.common import keep
from cloudloom.llm.exchange import Groups, answered, below, bounds, firsts, told_in_order
from cloudloom.llm.suffixes import repeated
from cloudloom.llm.text import U, _tables, cover, mix, prefix_sums, run_starts

SIZE, GRAM = 200, 100
PIECE = 1 << 20
#: Half of what the word operators take: a group holds its anchors and spans beside its texts.
GROUP_BYTES = 6_000_000
CROWD = 1_000
SORT_BYTES = 2_000_000
ALONE, WHOLE, SENT, WHOLE_SENT, CROWDED, WHOLE_CROWDED = range(6)
_PLACE = U((1 << 24) - 1)
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def pieces(texts: list[bytes], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Batches of about PIECE bytes: document and offset of each piece, and the pieces."""
    docs, offsets, held, total = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - size + 1), PIECE):
            part = t[at : at + PIECE + size - 1]
            if len(part) < size:
                continue
            docs.append(i)
            offsets.append(at)
            held.append(part)
            total += len(part)
            if total >= PIECE:
                yield np.array(docs), np.array(offsets), held
                docs, offsets, held, total = [], [], [], 0
    if held:
        yield np.array(docs), np.array(offsets), held


def least(key: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours (len - width + 1 of them), by block prefixes and suffixes."""
    n = len(key) - width + 1
    rows = -(-len(key) // width)
    full = np.full(rows * width, np.iinfo(np.uint64).max, U)
    full[: len(key)] = key
    full = full.reshape(rows, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


class Anchors:
    """Anchors of a group's documents: where their windows start in the document, how many, and the two hashes."""

    def __init__(self, texts: list[bytes], size: int = SIZE, gram: int = GRAM):
        self.size = size
        parts: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, U)], [np.empty(0, U)]]
        for doc, offset, held in pieces(texts, size):
            buf = np.frombuffer(b"".join(held), np.uint8)
            begin = np.concatenate([[0], np.cumsum([len(h) for h in held])])
            p = prefix_sums(buf)
            _, inverse = _tables(len(buf))
            h = p[gram:] - p[:-gram]
            h *= inverse[: len(h)]
            h = mix(h)
            key = h & ~_PLACE
            key |= np.arange(len(h), dtype=U)
            best = (least(key, size - gram + 1) & _PLACE).astype(np.int64)
            at = np.flatnonzero(run_starts(begin, size))
            a = best[at]
            first = firsts(a)
            lo, hi = at[first], at[np.append(first[1:], len(at)) - 1]
            s = p[hi + size] - p[lo]
            s *= inverse[lo]
            which = np.searchsorted(begin, lo, side="right") - 1
            for into, x in zip(parts, (doc[which], lo - begin[which] + offset[which], hi - lo + 1, h[a[first]], mix(s))):
                into.append(x)
        self.doc, self.lo, self.n, self.h, self.s = (np.concatenate(x) for x in parts)
        order = np.lexsort((self.s, self.h))
        self.order = order
        h, s = self.h[order], self.s[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (s[1:] != s[:-1])]) if len(h) else np.empty(0, bool)
        self.first = np.flatnonzero(new)  # distinct (anchor, span) in order
        self.copies = np.diff(np.append(self.first, len(h)))
        self.dh, self.ds = h[self.first], s[self.first]

    def span(self, texts: list[bytes], k: int) -> bytes:
        """The bytes of the k-th distinct span."""
        i = self.order[self.first[k]]
        return texts[self.doc[i]][self.lo[i] : self.lo[i] + self.n[i] + self.size - 1]

    def states(self, told: pa.Table, bits: int) -> np.ndarray:
        out = np.zeros(len(self.dh), np.uint8)
        edge = bounds(self.dh, bits)
        for k, states, _ in told_in_order(told):
            out[edge[k] : edge[k + 1]] = np.frombuffer(states, np.uint8)
        return out


def window_hashes(span: bytes, size: int) -> np.ndarray:
    buf = np.frombuffer(span, np.uint8)
    p = prefix_sums(buf)
    _, inverse = _tables(len(buf))
    h = p[size:] - p[:-size]
    return mix(h * inverse[: len(h)])


def ask_anchors(bits: int):
    def work(ids: list, texts: list[bytes], g: int, told) -> Iterator[tuple[int, bytes, bytes]]:
        a = Anchors(texts)
        v = below(a.dh, bits, 32).astype("<u4")
        many = a.copies > 1
        edge = bounds(a.dh, bits)
        for k in np.flatnonzero(np.diff(edge)):
            some = slice(edge[k], edge[k + 1])
            yield int(k), v[some].tobytes() + np.packbits(many[some]).tobytes(), a.ds[some].tobytes()

    return work


def answer_anchors(crowd: int):
    def work(bucket: int, groups: list[int], a: list[bytes], b: list[bytes]) -> list[tuple[bytes, bytes]]:
        spans = [np.frombuffer(x, U) for x in b]
        lens = [len(s) for s in spans]
        v = np.concatenate([np.frombuffer(x, "<u4", n) for x, n in zip(a, lens)])
        n = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8, offset=4 * m), count=m) for x, m in zip(a, lens)]).astype(np.int64) + 1
        s = np.concatenate(spans)
        order = np.lexsort((s, v))
        sv, ss = v[order], s[order]
        anchor = firsts(sv)
        new = np.concatenate([[True], (sv[1:] != sv[:-1]) | (ss[1:] != ss[:-1])])
        cls = np.flatnonzero(new)
        copies = np.add.reduceat(n[order], cls)
        of_class = np.cumsum(new) - 1  # class of each ordered entry
        kinds = np.diff(np.append(np.searchsorted(cls, anchor), len(cls)))  # distinct spans of each anchor
        kinds_of = np.repeat(kinds, kinds)
        alone = np.add.reduceat((copies == 1).astype(np.int64), np.searchsorted(cls, anchor))
        alone_of = np.repeat(alone, kinds)
        crowded = kinds_of > crowd
        state = np.where(copies > 1, WHOLE, np.where(kinds_of == 1, ALONE, np.where(crowded, CROWDED, SENT)))
        lead = np.where((copies > 1) & (kinds_of > 1) & (alone_of > 0), np.where(crowded, WHOLE_CROWDED, WHOLE_SENT), state)
        entry = state[of_class]
        entry[cls] = lead  # the first entry of a whole class sends it for all
        out = np.empty(len(v), np.uint8)
        out[order] = entry
        return [(x.tobytes(), b"") for x in np.split(out, np.cumsum(lens)[:-1])]

    return work


def ask_spans(bits: int):
    """Spans go to buckets 0 .. 2**bits - 1, windows of crowded anchors to the same number of buckets after those."""

    def work(ids: list, texts: list[bytes], g: int, told: pa.Table) -> Iterator[tuple[int, bytes, bytes]]:
        a = Anchors(texts)
        state = a.states(told, bits)
        sent = np.flatnonzero((state == SENT) | (state == WHOLE_SENT))
        edge = bounds(a.dh[sent], bits)
        press = zstandard.ZstdCompressor(level=1)
        for k in np.flatnonzero(np.diff(edge)):
            some = sent[edge[k] : edge[k + 1]]
            spans = [a.span(texts, i) for i in some.tolist()]
            yield int(k), press.compress(b"".join(spans)), np.fromiter(map(len, spans), "<u4", len(spans)).tobytes() + a.dh[some].tobytes()
        digests, many = crowded_windows(a, texts, state)
        edge = bounds(digests, bits)
        for k in np.flatnonzero(np.diff(edge)):
            some = slice(edge[k], edge[k + 1])
            yield int(k) + (1 << bits), digests[some].tobytes(), np.packbits(many[some]).tobytes()

    return work


def crowded_windows(a: Anchors, texts: list[bytes], state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct digests of windows under crowded anchors, and whether the group knows that they repeat."""
    digests, known = [np.empty(0, U)], [np.empty(0, bool)]
    for k in np.flatnonzero((state == CROWDED) | (state == WHOLE_CROWDED)).tolist():
        digests.append(window_hashes(a.span(texts, k), a.size))
        known.append(np.full(len(digests[-1]), state[k] == WHOLE_CROWDED))
    h, many = np.concatenate(digests), np.concatenate(known)
    order = np.argsort(h)
    h, many = h[order], many[order]
    first = firsts(h)
    if not len(first):
        return h, many
    return h[first], np.logical_or.reduceat(many, first) | (np.diff(np.append(first, len(h))) > 1)


def answer_spans(bits: int, size: int = SIZE):
    def work(bucket: int, groups: list[int], a: list[bytes], b: list[bytes]) -> list[tuple[bytes, bytes]]:
        return _count_windows(a, b) if bucket >> bits else _sort_spans(a, b, size)

    return work


def _count_windows(a: list[bytes], b: list[bytes]) -> list[tuple[bytes, bytes]]:
    each = [np.frombuffer(x, U) for x in a]
    h = np.concatenate(each)
    n = np.concatenate([np.unpackbits(np.frombuffer(y, np.uint8), count=len(x)) for x, y in zip(each, b)]).astype(np.int64) + 1
    order = np.argsort(h)
    first = firsts(h[order])
    hit = np.empty(len(h), bool)
    hit[order] = np.repeat(np.add.reduceat(n[order], first) > 1, np.diff(np.append(first, len(h))))
    return [(np.packbits(x).tobytes(), b"") for x in np.split(hit, np.cumsum([len(x) for x in each])[:-1])]


def _sort_spans(a: list[bytes], b: list[bytes], size: int) -> list[tuple[bytes, bytes]]:
    read = zstandard.ZstdDecompressor()
    spans: list[bytes] = []
    anchors, counts = [], []
    for x, y in zip(a, b):
        m = len(y) // 12
        raw, at = read.decompress(x), 0
        for n in np.frombuffer(y, "<u4", m).tolist():
            spans.append(raw[at : at + n])
            at += n
        anchors.append(np.frombuffer(y, U, m, 4 * m))
        counts.append(m)
    h = np.concatenate(anchors)
    order = np.argsort(h, kind="stable").tolist()
    marks: list[np.ndarray | None] = [None] * len(spans)
    part: list[int] = []
    held = 0

    def flush() -> None:
        for i, m in zip(part, repeated([spans[i] for i in part], size)):
            marks[i] = m

    for j, i in enumerate(order):
        if held >= SORT_BYTES and h[i] != h[order[j - 1]]:
            flush()
            part, held = [], 0
        part.append(i)
        held += len(spans[i])
    flush()
    out, at = [], 0
    for m in counts:
        out.append((np.packbits(np.concatenate(marks[at : at + m])).tobytes(), b""))
        at += m
    return out


def cut(bits: int):
    def work(ids: list, texts: list[bytes], g: int, told: pa.Table) -> pa.Table:
        a = Anchors(texts)
        half = 1 << bits
        bucket = told.column("bucket")
        state = a.states(told.filter(pc.less(bucket, half)), bits)
        spans = {k - half: x for k, x, _ in told_in_order(told.filter(pc.and_(pc.greater_equal(bucket, half), pc.less(bucket, 2 * half))))}
        windows = {k - 2 * half: x for k, x, _ in told_in_order(told.filter(pc.greater_equal(bucket, 2 * half)))}
        starts: list[list[np.ndarray]] = [[] for _ in texts]

        def mark(k: int, hits: np.ndarray | None) -> None:
            for i in a.order[a.first[k] : a.first[k] + a.copies[k]].tolist():
                starts[a.doc[i]].append(a.lo[i] + (np.arange(a.n[i]) if hits is None else hits))

        for k in np.flatnonzero((state == WHOLE) | (state == WHOLE_SENT) | (state == WHOLE_CROWDED)).tolist():
            mark(k, None)
        sent = np.flatnonzero((state == SENT) | (state == WHOLE_SENT))
        edge = bounds(a.dh[sent], bits)
        for k in np.flatnonzero(np.diff(edge)).tolist():
            some = sent[edge[k] : edge[k + 1]]
            n = a.n[a.order[a.first[some]]]
            hit = np.unpackbits(np.frombuffer(spans[k], np.uint8), count=int(n.sum())).view(bool)
            for j, x in zip(some.tolist(), np.split(hit, np.cumsum(n)[:-1])):
                if state[j] == SENT and x.any():
                    mark(j, np.flatnonzero(x))
        digests, _ = crowded_windows(a, texts, state)
        edge = bounds(digests, bits)
        again = np.zeros(len(digests), bool)
        for k, x in windows.items():
            again[edge[k] : edge[k + 1]] = np.unpackbits(np.frombuffer(x, np.uint8), count=edge[k + 1] - edge[k]).view(bool)
        for k in np.flatnonzero(state == CROWDED).tolist():
            x = again[np.searchsorted(digests, window_hashes(a.span(texts, k), a.size))]
            if x.any():
                mark(k, np.flatnonzero(x))
        n_gone, n_runs, kept = [], [], []
        for t, at in zip(texts, starts):
            if not at:
                n_gone.append(0)
                n_runs.append(0)
                kept.append(hashlib.sha256(t).hexdigest())
                continue
            gone = cover(np.concatenate(at), a.size, len(t))
            n_gone.append(int(gone.sum()))
            n_runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            kept.append(hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())
        return pa.table({"doc_id": ids, "n_bytes": [len(t) for t in texts], "n_removed": n_gone, "n_spans": n_runs, "kept_sha256": kept}, _RESULT)

    return work


def dedup_bytes(docs: DataFrame, crowd: int = CROWD, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    from pyspark.sql import functions as F

    groups = Groups(docs, group_bytes)
    bits = groups.bits
    states = keep(answered(groups.ask(ask_anchors(bits)), answer_anchors(crowd)), "suffix-states")
    marks = answered(groups.ask(ask_spans(bits), states), answer_spans(bits))
    told = states.unionByName(marks.withColumn("bucket", F.col("bucket") + F.lit(1 << bits)))
    return groups.each(cut(bits), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", told)
