"""Vectorised text work inside tasks: word bounds and hashes of many documents at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes whose hashes are computed at once; bounds the memory of the power tables.
PIECE = 1 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACES = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        for i, base in enumerate((_BASE, _INVERSE)):
            full = np.full(n + 1, base, U)
            full[0] = 1
            _powers[i] = np.cumprod(full, dtype=U)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (in place)."""
    h ^= h >> U(33)
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] = base**s * hash of buf[s:e], modulo 2**64."""
    power, _ = _tables(max(PIECE, len(buf)))
    p = np.empty(len(buf) + 1, U)
    p[0] = 0
    term = buf.astype(U)
    term += U(1)
    term *= power[: len(buf)]
    np.cumsum(term, out=p[1:])
    return p


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal byte spans get equal 64-bit hashes, wherever they stand. Spans are sorted and do not overlap."""
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, lo + PIECE, side="right")))
        s, e = starts[at:to] - lo, ends[at:to] - lo
        p = prefix_sums(buf[lo : lo + int(e[-1])])
        _, inverse = _tables(PIECE)
        h = p[e] - p[s]
        h *= inverse[s]
        out[at:to] = mix(h)
        at = to
    return out


class Words:
    """The white-space separated words of a list of texts, as hashes, in document order.

    ``first[i]:first[i + 1]`` are the words of text i in ``hash``, ``start`` and ``end``.
    """

    def __init__(self, texts: Sequence[bytes], lower: bool = False):
        raw = b" " + b" ".join(texts) + b" "
        self.raw = raw.translate(_LOWER) if lower else raw
        self.buf = np.frombuffer(self.raw, np.uint8)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.concatenate([[0], np.cumsum(lens + 1)]) + 1
        space = _SPACES[self.buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.begin)
        self.hash = span_hashes(self.buf, self.start, self.end)
        self.docs = len(texts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), self.counts())

    def word(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]]


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive entries (len - size + 1 of them)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, U)
    out = np.zeros(n, U)
    for j in range(size):
        out += hashes[j : j + n] * U((pow(_BASE, 2 * j + 3, 1 << 64) ^ 0x5851F42D4C957F2D) | 1)
    return mix(out)


def run_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Mask over run positions: the run lies inside one document."""
    total = int(first[-1])
    n = max(0, total - size + 1)
    ok = np.zeros(total + 1, np.int32)
    lens = np.diff(first)
    full = lens >= size
    np.add.at(ok, first[:-1][full], 1)
    np.add.at(ok, (first[1:] - size + 1)[full], -1)
    return np.cumsum(ok)[:n] > 0


def cover(starts: np.ndarray, size: int, total: int) -> np.ndarray:
    """Mask of positions inside [s, s + size) for any s."""
    d = np.zeros(total + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + size, total), -1)
    return np.cumsum(d)[:total] > 0


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Mask of values found in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    s = np.sort(values)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s
