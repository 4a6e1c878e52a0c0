"""Tokens of many texts as integer codes over one dictionary, split and encoded in bounded pieces."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Text bytes that are split into Python objects at once.
PIECE_BYTES = 2_000_000


def pieces(text: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """The text cut at spaces into pieces of about ``size`` bytes; a longer word stays whole."""
    at = 0
    while len(text) - at > size:
        to = text.find(b" ", at + size)
        if to < 0:
            break
        yield text[at:to]
        at = to
    yield text[at:] if at else text


def encode(texts: Sequence[bytes], table: bytes) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of all tokens in order, the dictionary, and the number of tokens of each text.

    ``table`` maps every byte: letters to what they count as, all else to a space.
    """
    chunks, held, size = [], [], 0
    lens = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        for piece in pieces(text.translate(table)):
            words = piece.split()
            lens[i] += len(words)
            held += words
            size += len(piece)
            if size >= PIECE_BYTES:
                chunks.append(pa.array(held, pa.binary()))
                held, size = [], 0
    chunks.append(pa.array(held, pa.binary()))
    return *coded(chunks), lens


def coded(chunks: list[pa.Array]) -> tuple[np.ndarray, pa.Array]:
    """Codes and their dictionary, as strings."""
    found = pa.chunked_array(chunks, pa.binary()).dictionary_encode().unify_dictionaries()
    codes = np.concatenate([np.empty(0, np.int64), *(c.indices.to_numpy() for c in found.chunks)]).astype(np.int64)
    last = found.chunk(found.num_chunks - 1).dictionary if found.num_chunks else pa.array([], pa.binary())
    return codes, last.cast(pa.string())
