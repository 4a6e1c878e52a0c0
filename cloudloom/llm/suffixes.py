"""Two-stage suffix sorting and adjacent common prefixes, on bytes in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Ends every string; UTF-8 has no such byte.
STOP = 0xFF


def words8(buf: np.ndarray, pad: int) -> np.ndarray:
    """The 8 bytes from every position as one big-endian number; after the end come zeros, below all."""
    full = np.concatenate([buf, np.zeros(pad + 8, np.uint8)]).astype(U)
    out = full[: len(full) - 7].copy()
    for j in range(1, 8):
        out <<= U(8)
        out |= full[j : len(full) - 7 + j]
    return out


def smaller(buf: np.ndarray) -> np.ndarray:
    """Mask of suffixes smaller than their successor; the last one is larger than the empty suffix."""
    n = len(buf)
    differs = np.append(buf[1:] != buf[:-1], True)
    up = np.append(buf[:-1] < buf[1:], False)
    at = np.where(differs, np.arange(n), n)
    return up[np.minimum.accumulate(at[::-1])[::-1]]


def sort_direct(key: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by their first ``depth`` bytes, 8 bytes a round; only ties go on."""
    order = at[np.argsort(key[at], kind="stable")]
    k = key[order]
    group = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])]) if len(k) else np.empty(0, np.int64)
    slot = np.arange(len(order))
    for level in range(8, depth, 8):
        if not len(slot):
            break
        same = group[1:] == group[:-1]
        tied = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        slot, group = slot[tied], group[tied]
        if not len(slot):
            break
        part = order[slot]
        k = key[part + level]
        o = np.lexsort((k, group))
        order[slot] = part[o]
        k = k[o]
        group = np.concatenate([[0], np.cumsum((group[1:] != group[:-1]) | (k[1:] != k[:-1]))])
    return order


def suffix_array(buf: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in the order of (at least) their first ``depth`` bytes, and the 8-byte words.

    Stage one sorts the suffixes that are smaller than their successors. Stage two walks the buckets of first bytes in
    order: a bucket holds first its larger suffixes, put there by the walk, then its smaller ones; the predecessors of
    what it holds, if larger, go to the ends of their own buckets.
    """
    n = len(buf)
    key = words8(buf, depth + 8)
    small = smaller(buf)
    direct = sort_direct(key, np.flatnonzero(small), depth)
    edge = np.searchsorted(buf[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n:
        waiting[buf[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        larger = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        wave = larger
        while len(wave):
            before = wave[wave > 0] - 1
            wave = before[(buf[before] == c) & ~small[before]]
            if len(wave):
                larger = np.concatenate([larger, wave])
        bucket = np.concatenate([larger, direct[edge[c] : edge[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(buf[before] > c) & ~small[before]]
        if len(before):
            first = buf[before]
            order = np.argsort(first, kind="stable")
            names, cut = np.unique(first[order], return_index=True)
            for d, part in zip(names.tolist(), np.split(before[order], cut[1:])):
                waiting[d].append(part)
    return np.concatenate(out) if out else np.empty(0, np.int64), key


def common(key: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Mask of position pairs whose first ``size`` bytes agree: their common prefix, 8 bytes a step."""
    alive = np.arange(len(a))
    for level in range(0, size, 8):
        x, y = key[a[alive] + level], key[b[alive] + level]
        rest = min(8, size - level)
        if rest < 8:
            x, y = x >> U(8 * (8 - rest)), y >> U(8 * (8 - rest))
        alive = alive[x == y]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def repeated(spans: list[bytes], size: int) -> list[np.ndarray]:
    """For every span, a mask of its starts whose ``size`` bytes also begin at another start of any span."""
    buf = np.frombuffer(bytes([STOP]).join(spans) + bytes([STOP]), np.uint8)
    lens = np.fromiter(map(len, spans), np.int64, len(spans))
    begin = np.concatenate([[0], np.cumsum(lens + 1)])[:-1]
    starts = np.zeros(len(buf) + 1, np.int32)
    full = lens >= size
    np.add.at(starts, begin[full], 1)
    np.add.at(starts, (begin + lens - size + 1)[full], -1)
    valid = np.cumsum(starts)[:-1] > 0
    order, key = suffix_array(buf, size)
    order = order[valid[order]]
    same = common(key, order[:-1], order[1:], size)
    hit = np.zeros(len(buf), bool)
    hit[order[:-1][same]] = True
    hit[order[1:][same]] = True
    return [hit[b : b + max(0, n - size + 1)] for b, n in zip(begin.tolist(), lens.tolist())]
