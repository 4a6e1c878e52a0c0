"""A wavelet matrix over token ids in one compressed file.

File: magic, header (JSON length, JSON), then one frame a block of each bit-plane, then the rank directory. A plane is
the ids' bits at one level, from the highest; below it the ids are reordered stably, those with bit 0 first. ``rank``
and ``select`` on planes give access, counting and occurrences without decoding the file: each reads the frames it
needs and keeps a few.
"""

from __future__ import annotations

import json
import struct
from collections import OrderedDict

import numpy as np
import zstandard

MAGIC = b"CLWM0001"
BLOCK_BITS = 1 << 18
CACHED_FRAMES = 64


def encode(ids: np.ndarray, doc_lens: np.ndarray) -> bytes:
    """The file's bytes. Document lengths are kept beside the planes."""
    a = ids.astype(np.uint16 if not len(ids) or int(ids.max()) < 1 << 16 else np.uint32)
    levels = max(1, int(a.max()).bit_length()) if len(a) else 1
    pack = zstandard.ZstdCompressor(level=1)
    frames, sizes, zeros, ranks = [], [], [], []
    for level in range(levels - 1, -1, -1):
        mask, low, high, marks = a.dtype.type(1 << level), [], [], []
        for at in range(0, len(a), BLOCK_BITS):
            part = a[at : at + BLOCK_BITS]
            bit = (part & mask) != 0
            frames.append(pack.compress(np.packbits(bit).tobytes()))
            sizes.append(len(frames[-1]))
            high.append(part[np.flatnonzero(bit)])
            low.append(part[np.flatnonzero(~bit)])
            marks.append(len(high[-1]))
        ranks.append(np.concatenate([[0], np.cumsum(marks)]).astype("<u8"))
        zeros.append(len(a) - sum(marks))
        if level:
            a = np.concatenate(low + high) if len(a) else a
    lens = pack.compress(doc_lens.astype("<u8").tobytes())
    directory = pack.compress(np.concatenate(ranks).astype("<u8").tobytes() + np.array(sizes, "<u4").tobytes())
    head = json.dumps({"n": len(ids), "levels": levels, "zeros": zeros, "docs": len(doc_lens), "lens": len(lens), "directory": len(directory)}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, lens, directory, *frames])


class WaveletFile:
    """Reads a file through a seekable object."""

    def __init__(self, file):
        self.file = file
        if file.read(8) != MAGIC:
            raise ValueError("not a wavelet matrix file")
        (size,) = struct.unpack("<I", file.read(4))
        head = json.loads(file.read(size))
        self.n, self.levels, self.zeros, self.docs = head["n"], head["levels"], head["zeros"], head["docs"]
        unpack = zstandard.ZstdDecompressor()
        self.doc_lens = np.frombuffer(unpack.decompress(file.read(head["lens"])), "<u8").astype(np.int64)
        directory = unpack.decompress(file.read(head["directory"]))
        self.blocks = -(-self.n // BLOCK_BITS)
        cut = self.levels * (self.blocks + 1) * 8
        self.ranks = np.frombuffer(directory[:cut], "<u8").astype(np.int64).reshape(self.levels, self.blocks + 1)
        sizes = np.frombuffer(directory[cut:], "<u4").astype(np.int64)
        self.offsets = 12 + size + head["lens"] + head["directory"] + np.concatenate([[0], np.cumsum(sizes)])
        self._unpack = unpack
        self._held: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()

    def _packed(self, level: int, block: int) -> bytes:
        k = level * self.blocks + block
        self.file.seek(int(self.offsets[k]))
        return self._unpack.decompress(self.file.read(int(self.offsets[k + 1] - self.offsets[k])))

    def _bits(self, level: int, block: int) -> np.ndarray:
        key = (level, block)
        if key not in self._held:
            self._held[key] = np.unpackbits(np.frombuffer(self._packed(level, block), np.uint8))
            if len(self._held) > CACHED_FRAMES:
                self._held.popitem(last=False)
        self._held.move_to_end(key)
        return self._held[key]

    def rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, rest = divmod(i, BLOCK_BITS)
        if not rest:
            return int(self.ranks[level, block])
        return int(self.ranks[level, block]) + int(self._bits(level, block)[:rest].sum())

    def select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of that value in a plane."""
        ones = self.ranks[level]
        seen = ones if bit else np.minimum(np.arange(self.blocks + 1) * BLOCK_BITS, self.n) - ones
        block = int(np.searchsorted(seen, k, side="right")) - 1
        inside = self._bits(level, block)[: min(BLOCK_BITS, self.n - block * BLOCK_BITS)]
        return block * BLOCK_BITS + int(np.flatnonzero(inside == bit)[k - int(seen[block])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            bit = int(self._bits(level, i // BLOCK_BITS)[i % BLOCK_BITS])
            value = value << 1 | bit
            ones = self.rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the occurrences of a token in [lo, hi) stand below the last plane."""
        if token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            a, b = self.rank1(level, lo), self.rank1(level, hi)
            if token >> self.levels - 1 - level & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        lo, hi = self._range(token, lo, self.n if hi is None else hi)
        return max(0, hi - lo)

    def occurrence(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of a token."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(self.levels - 1, -1, -1):
            bit = token >> self.levels - 1 - level & 1
            i = self.select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def ids(self) -> np.ndarray:
        """All ids in order, from the lowest plane up."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            up = np.empty(self.n, kind)
            for block in range(self.blocks):
                at, n = block * BLOCK_BITS, min(BLOCK_BITS, self.n - block * BLOCK_BITS)
                bit = np.unpackbits(np.frombuffer(self._packed(level, block), np.uint8), count=n).view(bool)
                ones, to = int(self.ranks[level, block]), int(self.ranks[level, block + 1])
                part = up[at : at + n]
                part[np.flatnonzero(~bit)] = out[at - ones : at + n - to]
                part[np.flatnonzero(bit)] = out[self.zeros[level] + ones : self.zeros[level] + to] | kind(1 << self.levels - 1 - level)
            out = up
        return out
