"""Language identification in two steps: the family first, then one-versus-one linear machines inside it.

Features are the shares of letter trigrams (UTF-8 bytes, case folded, every other byte a blank, blanks joined), hashed to
``FEATURES`` bins. Families are told apart by one-versus-one machines over families, languages inside a family by
one-versus-one machines over its languages; votes decide, the sum of margins breaks ties.

The models learn from at most ``PER_LANGUAGE`` labelled texts a language: those whose md5 of the id comes first. Their
whole texts become shares in Spark tasks, at most ``FEATURES`` numbers a row. Prediction reads whole texts, too.

Defined results: null text, or text without a letter, is ``und`` with score 0; null lang is never learned from; without
any labelled row all are ``und``; with one language all other texts get it with score 1; repeated rows agree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudloom.llm import svm
from cloudloom.llm.common import batch_of, crc32_of_id, slices, texts_of, with_columns

FEATURES = 1 << 15
PER_LANGUAGE = 600
UNKNOWN = "und"
#: Families of languages; one that is not listed is a family of its own.
FAMILIES = {
    "da": "germanic", "de": "germanic", "en": "germanic", "nl": "germanic", "no": "germanic", "sv": "germanic",
    "ca": "romance", "es": "romance", "fr": "romance", "it": "romance", "pt": "romance", "ro": "romance",
    "bg": "slavic", "cs": "slavic", "pl": "slavic", "ru": "slavic", "sk": "slavic", "uk": "slavic",
}

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256)], np.uint8)


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each trigram, and where each text's begin (one more entry at the end)."""
    buf = _FOLD[np.frombuffer(b"   ".join([b"", *texts, b""]), np.uint8)]
    if len(buf) < 3:
        return np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    h = buf[:-2].astype(np.uint32)
    h *= np.uint32(0x9E3779B1)
    h += buf[1:-1]
    h *= np.uint32(0x85EBCA6B)
    h += buf[2:]
    h *= np.uint32(0xC2B2AE35)
    h >>= np.uint32(32 - FEATURES.bit_length() + 1)
    at = np.cumsum(np.fromiter((len(t) + 3 for t in texts), np.int64, len(texts)))
    return h, np.concatenate([[0], at]) + 1


def shares(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of trigram shares, scaled to unit length."""
    first, index, value = [0], [], []
    for t in texts:
        n = np.bincount(trigrams([t])[0][1:], minlength=FEATURES)
        at = np.flatnonzero(n)
        v = n[at] / max(1, n.sum())
        index.append(at)
        value.append(v / max(1e-12, float(np.sqrt(v @ v))))
        first.append(first[-1] + len(at))
    return np.array(first), np.concatenate(index), np.concatenate(value)


class Tree:
    """The fitted machines: pairs of names with weights, for families and inside each family."""

    def __init__(self, names: list[str], families: dict[str, str]):
        self.names = sorted(names)
        self.family = {n: families.get(n, n) for n in self.names}
        self.families = sorted(set(self.family.values()))
        self.pairs: list[tuple[str, str, str]] = []  # (level, one, other)
        self.weights = np.empty((0, FEATURES + 1))

    def learn(self, first: np.ndarray, index: np.ndarray, value: np.ndarray, langs: list[str]) -> "Tree":
        """Fit on sparse rows of shares and their languages."""
        langs_of = np.array(langs)
        family_of = np.array([self.family[x] for x in langs])
        weights = []

        def machine(level: str, who: np.ndarray, a: str, b: str) -> None:
            rows = np.flatnonzero((who == a) | (who == b))
            part = np.concatenate([np.arange(first[r], first[r + 1]) for r in rows])
            starts = np.concatenate([[0], np.cumsum(np.diff(first)[rows])])
            w = svm.fit(starts, index[part], value[part], np.where(who[rows] == a, 1.0, -1.0), FEATURES, cost=10.0)
            self.pairs.append((level, a, b))
            weights.append(w)

        for a, b in combinations(self.families, 2):
            machine("", family_of, a, b)
        for f in self.families:
            for a, b in combinations([n for n in self.names if self.family[n] == f], 2):
                machine(f, langs_of, a, b)
        self.weights = np.array(weights).reshape(len(weights), FEATURES + 1)
        return self

    def _vote(self, level: str, names: list[str], margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index into names, and how sure: the weakest of the winner's duels."""
        n = margin.shape[1]
        votes, total, sure = np.zeros((len(names), n)), np.zeros((len(names), n)), np.full((len(names), n), np.inf)
        for k, (where, a, b) in enumerate(self.pairs):
            if where != level:
                continue
            for name, m in ((a, margin[k]), (b, -margin[k])):
                i = names.index(name)
                votes[i] += m > 0
                total[i] += m
                sure[i] = np.minimum(sure[i], m)
        best = np.argmax(votes + svm.squash(total) * 0.5, axis=0)
        return best, svm.squash(np.where(np.isinf(sure), 60.0, sure)[best, np.arange(n)], 4.0)

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        if not self.names or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        bins, at = trigrams(texts)
        bins = bins[: at[-1]].astype(np.int64)
        margin = np.empty((len(self.pairs), len(texts)))
        # the length of the vector of shares, for unit scaling, is the root of the sum of squared counts
        norm = np.empty(len(texts))
        for i in range(len(texts)):
            n = np.bincount(bins[at[i] : at[i + 1]], minlength=1)
            norm[i] = max(1.0, np.sqrt(n @ n))
        for k, w in enumerate(self.weights):
            margin[k] = np.add.reduceat(w[bins], at[:-1]) / norm + w[FEATURES]
        family, sure = self._vote("", self.families, margin)
        out, score = [""] * len(texts), sure
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            inside = [n for n in self.names if self.family[n] == name]
            best, s = self._vote(name, inside, margin[:, rows])
            for r, b in zip(rows, best):
                out[r] = inside[b]
            score[rows] *= s
        return out, score


_SHARES = pa.schema([("lang", pa.string()), ("key", pa.string()), ("h", pa.int64()), ("copies", pa.int64()), ("at", pa.binary()), ("value", pa.binary())])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shares of each whole text that has a letter."""
    for batch in slices(batches, 1_000_000):
        some = pa.array([bool(_LETTER.search(t)) for t in batch.column("text").to_pylist()], pa.bool_())
        batch = batch.filter(some)
        if batch.num_rows:
            first, index, value = shares(texts_of(batch))
            packed = {"at": [index[a:b].astype("<i4").tobytes() for a, b in zip(first, first[1:])], "value": [value[a:b].astype("<f8").tobytes() for a, b in zip(first, first[1:])]}
            yield batch_of({**{n: batch.column(n) for n in ("lang", "key", "h", "copies")}, **packed}, _SHARES)


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, families: dict[str, str] | None = None) -> Tree:
    """Fit on (doc_id, text, lang): at most ``per_language`` rows of each language."""
    key = F.md5(F.concat(F.lit("lang|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    known = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", key.alias("key"), F.xxhash64("text").alias("h"), "text")
    # ids that come first in the order of their digests: a salted first cut keeps the ranking small for a hot language
    salted = known.drop("text").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(64)))
    for part in (["lang", "salt"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*part).orderBy("key", "h"))
        salted = salted.withColumn("rank", rank).where(F.col("rank") <= per_language)
    # at most per_language keys a language; a row that repeats is read once and counts as often as it was drawn
    drawn = salted.groupBy("lang", "key", "h").agg(F.count("*").alias("copies"))
    texts = known.join(F.broadcast(drawn), ["lang", "key", "h"]).dropDuplicates(["lang", "key", "h"]).select("lang", "key", "h", "copies", "text")
    found = texts.mapInArrow(_shared, "lang string, key string, h long, copies long, at binary, value binary").collect()
    rows = [r for r in sorted(found, key=lambda r: (r["lang"], r["key"], r["h"])) for _ in range(r["copies"])]
    tree = Tree(sorted({r["lang"] for r in rows}), FAMILIES if families is None else families)
    if not rows:
        return tree
    at = [np.frombuffer(r["at"], "<i4") for r in rows]
    value = np.concatenate([np.frombuffer(r["value"], "<f8") for r in rows])
    return tree.learn(np.concatenate([[0], np.cumsum([len(x) for x in at])]), np.concatenate(at).astype(np.int64), value, [r["lang"] for r in rows])


def identify(docs: DataFrame, tree: Tree) -> DataFrame:
    """All columns of ``docs`` and lang_pred, score."""
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    shape = T.StructType([f for f in docs.schema if f.name not in ("lang_pred", "score")] + added)
    held = docs.sparkSession.sparkContext.broadcast(tree)  # pairs of languages times FEATURES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1_000_000):
            texts = texts_of(batch)
            langs, score = held.value.predict(texts)
            for i, t in enumerate(batch.column("text").to_pylist()):
                if t is None or not _LETTER.search(t):
                    langs[i], score[i] = UNKNOWN, 0.0
            yield with_columns(batch, {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(np.asarray(score, float), pa.float64())})

    return docs.mapInArrow(run, shape)


HELD_OUT, FOLDS = 2, 4


def held_out(col: str = "doc_id"):
    return F.coalesce(F.pmod(crc32_of_id(col), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def learn_from(docs: DataFrame) -> Tree:
    """The tree of the learning fold: text and lang of rows that are not held out."""
    return train(docs.where(~held_out()).select("doc_id", "text", "lang"))


