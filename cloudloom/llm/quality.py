"""Quality classifier: naive Bayes log-count ratios scale n-gram indicators, a linear hinge-loss machine weighs them.

Features are words and pairs of neighbouring words, hashed to ``FEATURES`` bins, each present or not. The log-count
ratios come from all labelled rows of the learning folds, counted in Spark: every task adds up its documents' bins
before anything moves. The machine, fitted by dual coordinate descent, sees at most ``PER_CLASS`` rows a class, those
whose md5 of the id comes first. Their whole texts become bins in Spark tasks, at most ``FEATURES`` numbers a row. A
logistic curve fitted on those rows turns margins into scores. Scoring reads whole texts.

Defined results: null and empty text have no feature and get the score of the bias; rows without label, or with a null
id, are not learned from; with fewer than two classes every score is the share of class 1 (0.5 without any label);
repeated labels of an id each count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudloom.llm import svm
from cloudloom.llm.common import batch_of, crc32_of_id, slices, texts_of, with_columns
from cloudloom.llm.text import U, Words, distinct, mix

FEATURES = 1 << 18
PER_CLASS = 2_000
SMOOTH = 1.0
FOLDS, HELD_OUT = 5, 0
CUT = 0.3


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct bins of each text, joined, and where each text's begin."""
    w = Words(texts)
    bits = U(64 - FEATURES.bit_length() + 1)
    one = (w.hash >> bits).astype(np.int64)
    two = np.empty(0, np.int64)
    if len(w.hash) > 1:
        two = (mix(w.hash[:-1] * U(3) + w.hash[1:]) >> bits).astype(np.int64)
    doc = w.doc_of()
    inner = doc[1:] == doc[:-1]
    key = distinct(np.concatenate([doc * FEATURES + one, doc[1:][inner] * FEATURES + two[inner]]))
    return key % FEATURES, np.searchsorted(key, np.arange(len(texts) + 1) * FEATURES)


@dataclass
class Model:
    weight: np.ndarray  # ratio times machine weight, one a bin
    bias: float
    slope: float
    shift: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        bins, first = features(texts)
        sums = np.concatenate([[0.0], np.cumsum(self.weight[bins])])
        n = np.diff(first)
        margin = (sums[first[1:]] - sums[first[:-1]]) / np.sqrt(np.maximum(n, 1)) + self.bias
        return svm.squash(margin, self.slope, self.shift)


def count_bins(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents that have a bin, for label 1 and label 0. Two numbers for each of FEATURES bins reach the driver."""
    schema = pa.schema([("bin", pa.int32()), ("up", pa.int64()), ("down", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, FEATURES), np.int64)
        for batch in slices(batches, 1_000_000):
            bins, first = features(texts_of(batch))
            label = np.repeat(batch.column("label").to_numpy(zero_copy_only=False) > 0, np.diff(first))
            seen[0] += np.bincount(bins[label], minlength=FEATURES)
            seen[1] += np.bincount(bins[~label], minlength=FEATURES)
        at = np.flatnonzero(seen.any(0))
        yield batch_of({"bin": at, "up": seen[0][at], "down": seen[1][at]}, schema)

    table = labelled.select("text", "label").mapInArrow(run, "bin int, up long, down long").groupBy("bin").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    found = table.toPandas()
    up, down = np.zeros(FEATURES), np.zeros(FEATURES)
    up[found["bin"]], down[found["bin"]] = found["up"], found["down"]
    return up, down


_BINNED = pa.schema([("label", pa.int32()), ("key", pa.string()), ("bins", pa.binary())])


def _binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bins of each whole text."""
    for batch in slices(batches, 1_000_000):
        bins, first = features(texts_of(batch))
        own = bins.astype("<i4")
        yield batch_of({"label": batch.column("label"), "key": batch.column("key"), "bins": [own[a:b].tobytes() for a, b in zip(first, first[1:])]}, _BINNED)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on documents (doc_id, text) and their labels (doc_id, label), label 0 or 1. Texts move once, for the counts, at every size."""
    known = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").select(F.col("doc_id").alias("of"), F.col("label").cast("int").alias("label"))
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    match = F.col("doc_id") == F.col("of")
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    up, down = count_bins(texts.join(known.hint("merge"), match).select("text", "label"))
    ratio = np.log((up + SMOOTH) / (up + SMOOTH).sum()) - np.log((down + SMOOTH) / (down + SMOOTH).sum())
    few = known.withColumn("key", F.md5(F.concat(F.lit("quality|"), F.col("of").cast("string")).cast("binary"))).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(64)))
    for part in (["label", "salt"], ["label"]):
        few = few.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy("key"))).where(F.col("rank") <= per_class)
    # at most 2 * per_class ids
    drawn = texts.join(F.broadcast(few.select("of", "label", "key")), match).select("label", "key", "text")
    drawn = drawn.mapInArrow(_binned, "label int, key string, bins binary").orderBy("key", "bins").limit(4 * per_class)
    rows = sorted((r["label"], bytes(r["bins"])) for r in drawn.collect())
    label = np.array([1.0 if r[0] else -1.0 for r in rows])
    if len(set(label)) < 2:
        share = 0.5 if not len(label) else float(label[0] > 0)
        return Model(np.zeros(FEATURES), 0.0, 0.0, {0.0: -60.0, 0.5: 0.0, 1.0: 60.0}[share])
    each = [np.frombuffer(r[1], "<i4") for r in rows]
    bins, first = np.concatenate(each).astype(np.int64), np.concatenate([[0], np.cumsum([len(b) for b in each])])
    value = ratio[bins] / np.sqrt(np.maximum(1, np.repeat(np.diff(first), np.diff(first))))
    w = svm.fit(first, bins, value, label, FEATURES, cost=1.0)
    margin = np.add.reduceat(np.append(w[bins] * value, 0.0), np.minimum(first[:-1], len(bins))) * (np.diff(first) > 0) + w[FEATURES]
    slope, shift = svm.sigmoid_of(margin, label)
    # the learning rows are drawn by class; move the curve to the classes' shares among all labelled rows
    shift += float(np.log(totals[1] / totals[0]) - np.log((label > 0).sum() / (label < 0).sum()))
    return Model(ratio * w[:FEATURES], float(w[FEATURES]), slope, shift)


def score(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """All columns of ``docs`` and score, predicted."""
    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    shape = T.StructType([f for f in docs.schema if f.name not in ("score", "predicted")] + added)
    held = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1_000_000):
            s = held.value.score(texts_of(batch))
            yield with_columns(batch, {"score": pa.array(s, pa.float64()), "predicted": pa.array((s >= cut).astype(np.int32), pa.int32())})

    return docs.mapInArrow(run, shape)


def held_out(col: str = "doc_id"):
    return F.coalesce(F.pmod(crc32_of_id(col), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def learn_from(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """The model of the learning folds: text and label of rows that are not held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).select("doc_id", F.col(label).alias("label"))
    return train(docs.where(~held_out()), known)
