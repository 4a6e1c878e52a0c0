"""Content digests as hash trees: constant fan-out, levels until one root is left, and the search for what changed.

A node of level 0 hashes the rows of ``fan`` consecutive ids, a node above hashes its ``fan`` children, so no row of
any level holds more than one fan-out of entries, and a changed row changes one node a level.  Two trees are compared
from their roots down: only children of nodes that differ are looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.session import cut

FAN = 256


def _joined(items: str) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(F.col(items)), lambda s: s["t"]), "|"), 256)


def digest_tree(df: DataFrame, keys: Sequence[str], order: str, row: Column, fan: int = FAN) -> DataFrame:
    """(keys..., level, node, digest, rows): every node of every key's tree; the root is the one of the largest level.

    ``order`` is a whole number, unique per key.
    """
    keys = list(keys)
    up = lambda c: F.floor(F.col(c) / fan).cast("long")
    leaves = df.groupBy(*keys, up(order).alias("node")).agg(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("t"))).alias("_r"), F.count("*").alias("rows"))
    level = cut(leaves.select(*keys, F.lit(0).alias("level"), "node", _joined("_r").alias("digest"), "rows"))
    levels = [level]
    while True:
        several = level.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys)
        open_ = level.join(several, keys, "left_semi")
        grown = open_.groupBy(*keys, up("node").alias("_up")).agg(F.collect_list(F.struct(F.col("node").alias("o"), F.col("digest").alias("t"))).alias("_r"), F.sum("rows").alias("rows"))
        level = cut(grown.select(*keys, F.lit(len(levels)).alias("level"), F.col("_up").alias("node"), _joined("_r").alias("digest"), "rows"))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        levels.append(level)


def roots(tree: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., levels, digest, rows) of every key."""
    return tree.groupBy(*keys).agg((F.max("level") + 1).alias("levels"), F.max_by("digest", "level").alias("digest"), F.max_by("rows", "level").alias("rows"))


def changed_nodes(old: DataFrame, new: DataFrame, keys: Sequence[str], fan: int = FAN) -> DataFrame:
    """(keys..., node, change): level-0 nodes that differ; ``change`` is added, removed or changed.

    Trees of different height are compared from the lower one's root level down.
    """
    keys = list(keys)
    top = roots(old, keys).select(*keys, F.col("levels").alias("_a")).join(roots(new, keys).select(*keys, F.col("levels").alias("_b")), keys, "full")
    # a key on one side only is compared from its own root
    start = cut(top.select(*keys, (F.least("_a", "_b") - 1).alias("_start")))
    high = start.agg(F.max("_start")).first()[0]
    if high is None:
        return old.select(*keys, "node", F.lit("").alias("change")).where("false")
    frontier = None
    for at in range(high, -1, -1):
        a = old.where(F.col("level") == at).select(*keys, "node", F.col("digest").alias("_a"))
        b = new.where(F.col("level") == at).select(*keys, "node", F.col("digest").alias("_b"))
        begun = start.where(F.col("_start") == at).select(*keys)
        if frontier is None:
            a, b = a.join(begun, keys, "left_semi"), b.join(begun, keys, "left_semi")
        else:
            under = frontier.select(*keys, F.col("node").alias("_up"))
            inside = lambda t: t.withColumn("_up", F.floor(F.col("node") / fan).cast("long")).join(under, [*keys, "_up"], "left_semi").drop("_up")
            a = inside(a).unionByName(a.join(begun, keys, "left_semi"))
            b = inside(b).unionByName(b.join(begun, keys, "left_semi"))
        both = a.join(b, [*keys, "node"], "full").where(~F.equal_null("_a", "_b"))
        change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
        frontier = cut(both.select(*keys, "node", change.alias("change")))
    return frontier
