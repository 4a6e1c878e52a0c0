"""Recursive splitting of many point groups at data-dependent gaps.

A split changes the axis and spacing of both halves, so it has to be repeated
on the results.  Every round cuts all groups at once by distributed
aggregations.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.session import cut


def split_recursively(
    points: DataFrame, keys: Sequence[str], ident: str, min_size: int, distributed: Callable[[DataFrame, list[str]], DataFrame],
) -> DataFrame:
    """Adds ``path``: the turns each row took; NULL for rows of fragments below ``min_size``.

    ``distributed(rows, key)`` returns ``key..., ident, _left`` for the groups it
    cuts; groups below twice ``min_size`` are not offered to it.  Only ids, paths
    and flags are checkpointed between rounds, never the rows themselves.
    """
    keys = list(keys)
    key = [*keys, "path"]
    state = cut(points.select(*keys, ident).withColumn("path", F.lit("")).withColumn("_done", F.lit(False)))
    while True:
        live = state.where(~F.col("_done") & F.col("path").isNotNull())
        wide = live.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") >= 2 * min_size).drop("_n")
        live = cut(live.join(wide, key).drop("_done").select(*keys, ident, "path"))
        if live.isEmpty():
            break
        moved = distributed(points.join(live, [*keys, ident]), key)
        moved = cut(moved.select(*keys, ident, F.concat("path", F.when(F.col("_left"), "0").otherwise("1")).alias("_to")))
        size = moved.groupBy(*keys, "_to").agg(F.count("*").alias("_k"))
        moved = moved.join(size, [*keys, "_to"]).select(*keys, ident, F.when(F.col("_k") >= min_size, F.col("_to")).alias("_to"), F.lit(True).alias("_hit"))
        out = state.join(moved, [*keys, ident], "left")
        state = cut(out.select(*keys, ident, F.when(F.col("_hit"), F.col("_to")).otherwise(F.col("path")).alias("path"), F.col("_hit").isNull().alias("_done")))
    return points.join(state.drop("_done"), [*keys, ident])
