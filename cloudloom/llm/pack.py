"""Rows of documents as compressed chunks, so that a text shuffle moves less than the texts' size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard


def pack(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return zstandard.ZstdCompressor(level=3).compress(out.getvalue())


def unpack(chunks: pa.ChunkedArray | pa.Array) -> pa.Table:
    read = zstandard.ZstdDecompressor()
    return pa.concat_tables([pa.ipc.open_stream(read.decompress(c)).read_all() for c in chunks.to_pylist()])


def by_key(batch: pa.RecordBatch, key: np.ndarray) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batch's rows of each key."""
    order = np.argsort(key, kind="stable")
    found, at = np.unique(key[order], return_index=True)
    for k, rows in zip(found.tolist(), np.split(order, at[1:])):
        yield k, batch.take(pa.array(rows)) if len(found) > 1 else batch


def dealt(batches: Iterator[pa.RecordBatch], of, names: tuple[str, str] = ("g", "chunk")) -> Iterator[pa.RecordBatch]:
    """(key, chunk) rows: each batch cut by the keys that ``of(batch)`` gives its rows."""
    for batch in batches:
        keys, chunks = [], []
        for k, part in by_key(batch, of(batch)):
            keys.append(k)
            chunks.append(pack(part))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(chunks, pa.binary())], names=list(names))


def filled(column: pa.ChunkedArray | pa.Array, value) -> np.ndarray:
    return pc.fill_null(column, value).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else pc.fill_null(column, value).to_numpy()
