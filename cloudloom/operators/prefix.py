"""Exact running totals over a value order without one big window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.session import cut


def totals_above(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """Adds ``<v>_above``: the sum of ``v`` over rows with a larger ``order`` value.

    ``order`` is unique per key.  Rows are range partitioned by key and value, so
    a key of any size spreads over even, contiguous ranges; only the totals of
    ranges and the rows of one range are ever ordered.  The ranges come from a
    sample, so they are checkpointed before they are read twice.
    """
    keys = list(keys)
    ranged = df.repartitionByRange(*keys, order).withColumn("_b", F.spark_partition_id())
    out = cut(ranged)
    per_range = out.groupBy(*keys, "_b").agg(*[F.sum(v).alias(f"_t{v}") for v in values])
    down = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(F.desc("_b"))
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    per_range = per_range.select(*keys, "_b", *[F.coalesce(F.sum(f"_t{v}").over(before), F.lit(0)).alias(f"_o{v}") for v in values])
    inner = Window.partitionBy(*keys, "_b").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    out = out.join(per_range, [*keys, "_b"])
    return out.withColumns({f"{v}_above": F.col(f"_o{v}") + F.coalesce(F.sum(v).over(inner), F.lit(0)) for v in values}).drop(
        "_b", *[f"_o{v}" for v in values]
    )


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Adds ``out``: the position 0, 1, ... of each row within its key; ``order`` is unique per key."""
    one = [*keys, "_key"]
    rows = totals_above(df.withColumns({"_key": F.lit(1), "_n": F.lit(1), "_at": F.struct(*order)}), one, "_at", ["_n"])
    size = rows.groupBy(*one).agg(F.max("_n_above").alias("_last"))
    return rows.join(size, one).withColumn(out, F.col("_last") - F.col("_n_above")).drop("_key", "_n", "_at", "_n_above", "_last")
