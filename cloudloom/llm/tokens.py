"""Token ids of documents in wavelet matrix shards, in ascending doc_id order.

Documents are range-partitioned by (doc_id, hash of text), encoded where they land and written in shards of about
``SHARD_IDS`` ids; a shard ends with a document. A retried task writes new files, and only those that the finished task
names count. The catalogue, one row a shard, gives the number of ids before each.

Encoding a text equals joining the encodings of its pieces between blanks and line ends: no rule of the tokenizer
reaches across those. So a piece is encoded once and remembered, up to a bound.  Pieces made of plain letters and
closing marks go to the library's model by part, all others to the whole tokenizer.

Defined results: null text is empty and has only its end id; null ids come first; equal ids are ordered by the hash of
their text, then the text; an empty table writes no shard.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.llm.common import batch_of, group_count, id_text, keep, measure, shared_dir, slices

END_ID = 2
SHARD_IDS = 1 << 21
SHARD_BYTES = 12_000_000
REMEMBERED = 600_000

_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?%$&*#]*)")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Texts to ids, remembering pieces."""

    def __init__(self, path: str, end_id: int = END_ID, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.end_id, self.remembered = end_id, remembered
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.part: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        self.code: dict[str, int] = {"": 0}
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.first, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _of_part(self, part: str) -> bytes:
        if not part:
            return b""
        ids = self.part.get(part)
        if ids is None:
            ids = self.part[part] = array("I", [t.id for t in self.model.tokenize(part.encode().decode("latin1").translate(self.letters))]).tobytes()
        return ids

    def _of_piece(self, piece: str) -> bytes:
        plain = _PLAIN.fullmatch(piece)
        if plain:
            return self._of_part(plain[1].lower()) + self._of_part(plain[2])
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def _learn(self, pieces: list[str]) -> None:
        if len(self.part) > self.remembered:
            self.part = {}
        found = [self._of_piece(p) for p in pieces]
        lens = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = np.frombuffer(b"".join(found), np.uint32)
        at, n = len(self.code), len(found)
        while at + n > len(self.first):
            self.first, self.size = np.concatenate([self.first, np.zeros_like(self.first)]), np.concatenate([self.size, np.zeros_like(self.size)])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[at : at + n] = lens
        self.first[at : at + n] = self.used + np.cumsum(lens) - lens
        self.used += len(ids)
        self.code.update(zip(pieces, range(at, at + n)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end id, and each text's number of ids."""
        if len(self.code) > self.remembered:
            self._forget()
        pieces: list[str] = []
        ends = np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            pieces += t.replace("\n", " ").split(" ")
            ends[i] = len(pieces)
        new = [p for p in set(pieces) if p not in self.code]
        if new:
            self._learn(new)
        codes = np.fromiter(map(self.code.__getitem__, pieces), np.int64, len(pieces))
        lens = self.size[codes]
        lens[ends - 1] += 1  # the end id, written after the text's last piece
        total = np.cumsum(lens)
        n = int(total[-1]) if len(total) else 0
        at = np.arange(n) + np.repeat(self.first[codes] - (total - lens), lens)
        last = total[ends - 1] - 1
        at[last] = 0
        ids = self.flat[at]
        ids[last] = self.end_id
        return ids, np.diff(np.concatenate([[0], total[ends - 1]])) if len(texts) else np.empty(0, np.int64)


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One a Python worker, kept between its tasks."""
    return _ENCODERS.setdefault((path, end_id), None) or _ENCODERS.update({(path, end_id): Encoder(path, end_id)}) or _ENCODERS[path, end_id]


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith(("file:", "/")) else f"file://{uri}")


def _shard_schema() -> pa.Schema:
    return pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])


SHARD_DDL = "part int, seq int, path string, n_docs long, n_ids long, n_bytes long"


def write_tokens(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the shards under ``folder``; the catalogue (part, seq, path, n_docs, n_ids, n_bytes), a table there too."""
    from pyspark import TaskContext

    spark = docs.sparkSession
    own = id_text(docs)
    _, size = measure(own)
    vocabulary = vocabulary or vocabulary_path()
    order = ["doc_id", "h", "text"]
    dealt = own.withColumn("h", F.xxhash64("text")).repartitionByRange(group_count(size, SHARD_BYTES), "doc_id", "h").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        code = encoder(vocabulary, end_id)
        held: list[tuple[np.ndarray, np.ndarray, list]] = []
        seq = waiting = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, waiting, seq
            ids, lens = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            path = f"{root}/{part:06d}-{seq:06d}-{uuid.uuid4().hex}.clwm"
            from cloudloom.llm.wavelet import encode as pack

            data = pack(ids, lens)
            names = pa.BufferOutputStream()
            doc_ids = pa.record_batch({"doc_id": pa.array([i for h in held for i in h[2]], pa.int64())})
            with pa.ipc.new_stream(names, doc_ids.schema) as w:
                w.write_batch(doc_ids)
            with store.open_output_stream(path) as out:
                out.write(data)
            with store.open_output_stream(path + ".ids") as out:
                out.write(names.getvalue())
            row = batch_of({"part": [part], "seq": [seq], "path": [path], "n_docs": [len(lens)], "n_ids": [len(ids)], "n_bytes": [len(data)]}, _shard_schema())
            held, waiting, seq = [], 0, seq + 1
            return row

        for batch in slices(batches, 1_000_000):
            ids, lens = code.encode([t or "" for t in batch.column("text").to_pylist()])
            held.append((ids, lens, batch.column("doc_id").to_pylist()))
            waiting += len(ids)
            if waiting >= shard_ids:
                yield flush()
        if held:
            yield flush()

    return keep(dealt.select("doc_id", "text").mapInArrow(run, SHARD_DDL), "tokens-catalogue")


def read_tokens(spark: SparkSession, folder: str, catalogue: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the shards' files."""
    rows = catalogue.orderBy("part", "seq").collect()  # one row a shard
    starts = np.concatenate([[0], np.cumsum([r["n_ids"] for r in rows])]).astype(int).tolist()
    listed = spark.createDataFrame([(r["path"], s) for r, s in zip(rows, starts)], "path string, start long")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from cloudloom.llm.wavelet import WaveletFile

        store, _ = _store(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(path) as f:
                    shard = WaveletFile(f)
                    ids = shard.ids().astype("<u4")
                with store.open_input_stream(path + ".ids") as f:
                    doc_ids = pa.ipc.open_stream(f.read()).read_all().column("doc_id")
                ends = np.cumsum(shard.doc_lens)
                begins = ends - shard.doc_lens
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield batch_of({"doc_id": doc_ids.combine_chunks(), "start": start + begins, "n_tokens": shard.doc_lens, "ids_crc32": crc}, schema)

    return listed.repartition(max(1, len(rows))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, vocabulary: str | None = None, folder: str | None = None) -> DataFrame:
    """Write shards and the catalogue, then read every document's ids back."""
    folder = folder or shared_dir(docs.sparkSession, "tokens")
    return read_tokens(docs.sparkSession, folder, write_tokens(docs, folder, vocabulary))
