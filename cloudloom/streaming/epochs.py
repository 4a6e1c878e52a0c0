"""The epoch table of training logs as a stateful stream.

State is kept by log: the open epoch and the one before it, each with its Val line, the last Train line and the last
batch line that count for it, and the batch line seen since.  A batch puts out every epoch that it closes, the open one
as it stands, and the one before when a late Train line reaches it; ``version`` is the last line number that was known,
so ``settled`` keeps the newest row of each epoch.  Lines of a log arrive in order between batches, in any order inside
one, except Train lines, which may come one epoch late.

Needs the RocksDB state store: ``spark.sql.streaming.stateStore.providerClass``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cloudloom.operators import logs

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = "epoch int, at long, val string, train string, train_at long, batch string"
OUT = "log long, epoch int, val string, train string, batch string, closed boolean, version long"


class EpochProcessor(StatefulProcessor):
    def __init__(self, kind: str):
        self.kind = kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", EPOCH)
        self.before = handle.getValueState("before", EPOCH)
        self.batch = handle.getValueState("batch", "value string")
        self.val, self.step = re.compile(logs.VAL_SUMMARY), re.compile(logs.VAL_BATCH)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        lines = sorted((int(n), v) for part in rows for n, v in zip(part["line_no"], part["value"]))
        now = list(self.open.get()) if self.open.exists() else None
        old = list(self.before.get()) if self.before.exists() else None
        batch = self.batch.get()[0] if self.batch.exists() else None
        out, late = [], False
        for n, line in lines:
            is_batch = self.kind != "support_only" and "Val/Test:" in line
            if is_batch:
                if self.step.search(line):
                    batch = line
            elif self.val.search(line):
                if now:
                    out.append((*now[:1], *now[2:4], now[5], True, n))
                old, now, batch, late = now, [now[0] + 1 if now else 1, n, line, None, None, batch], None, False
            elif "Train result:" in line and now:
                row = now if n > now[1] else old
                if row and n > row[1] and (row[4] is None or n > row[4]):
                    row[3], row[4] = line, n
                    late |= row is old
        last = lines[-1][0]
        if late:
            out.append((old[0], old[2], old[3], old[5], True, max(last, now[1])))
        if now:
            out.append((now[0], now[2], now[3], now[5], False, last))
            self.open.update(tuple(now))
        if old:
            self.before.update(tuple(old))
        if batch is None:
            self.batch.clear()
        else:
            self.batch.update((batch,))
        if out:
            yield pd.DataFrame([(key[0], *o) for o in out], columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def epoch_stream(lines: DataFrame, kind: str) -> DataFrame:
    """Rows of ``OUT`` from a stream of (log, line_no, value)."""
    v = F.col("value")
    telling = lines.where(v.contains("Val/Test:") | v.contains("Train result:") | v.contains("Val result:")).select("log", "line_no", "value")
    return telling.groupBy("log").transformWithStateInPandas(EpochProcessor(kind), OUT, "Append", "None")


def settled(rows: DataFrame, kind: str) -> DataFrame:
    """The epoch table of what a stream put out, in the columns of ``logs.epoch_table``."""
    last = rows.groupBy("log", "epoch").agg(F.max_by(F.struct("val", "train", "batch"), F.struct("version", "closed")).alias("_l"))
    found = [F.regexp_extract("_l.val", logs.VAL_SUMMARY, i + 1).alias(c) for i, c in enumerate(("val_mIoU", "val_mAcc", "val_allAcc"))]
    kv = last.withColumn("_m", logs.key_values(F.col("_l.train")))
    got = F.col("_l.train").isNotNull()
    found += [F.when(got, F.coalesce(F.try_element_at("_m", F.lit(m)), F.lit(""))).alias(f"train_{m}") for m in logs.TRAIN_METRICS[kind]]
    if kind != "support_only":
        for m in logs.BATCH_METRICS:
            value = F.regexp_extract("_l.batch", f"{m}: {logs.NUMBER}", 1)
            found.append(F.when(value != "", value).alias(m))
    return kv.select("log", "epoch", *found)
