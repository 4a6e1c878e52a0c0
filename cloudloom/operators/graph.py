"""Connected components by alternating star contraction."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.session import cut

#: Tasks that share the edges of one node; a hub may hold a third of all edges.
SALTS = 16
#: Edges that one task aims at, so that a small edge set is not dealt over thousands of nearly empty files every round.
EDGES_PER_TASK, LEAST_TASKS = 50_000, 4


def components(nodes: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., node, component): the smallest node id reachable from each node.

    Large-star / small-star rounds: every round links each node to the smallest
    node it knows, so a long chain shrinks by a factor per round instead of one
    step.  Both stars are plain aggregations and no neighbour list is collected.
    Only nodes whose edges really change are joined, with the edges of one node
    dealt over ``SALTS`` tasks.  Before the first round each task replaces its edges, ``EDGES_PER_TASK``
    at a time, by stars that connect the same nodes; the rounds end when all is stars.
    """
    by = list(by)
    e = edges.select(*by, F.col("src").alias("u"), F.col("dst").alias("v")).where("u <> v")
    e = e.select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = cut(e.mapInArrow(_stars(by), e.schema).distinct())
    while (seen := _shape(e, by))["open"]:
        parts = max(LEAST_TASKS, -(-seen["n"] // EDGES_PER_TASK))
        e = e.coalesce(parts)
        both = e.unionByName(e.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*by, "u").agg(F.min("v").alias("m"), F.max("v").alias("top")).where("m < u").coalesce(parts)
        # large star: neighbours above a node go to its smallest neighbour; a node without smaller ones keeps them
        between = _salted(low.where("top > u").select(*by, F.col("u").alias("v"), "m"))
        large = e.withColumn("_salt", _salt("u")).join(between, [*by, "v", "_salt"], "left").select(*by, "u", F.coalesce("m", "v").alias("v")).coalesce(parts)
        large = large.unionByName(low.select(*by, "u", F.col("m").alias("v"))).where("u <> v").distinct().coalesce(parts)
        # small star: neighbours below a node, and the node, go to the smallest of them
        least = large.groupBy(*by, "u").agg(F.min("v").alias("m"), F.max("v").alias("top")).coalesce(parts)
        several = _salted(least.where("m < top").select(*by, "u", "m"))
        small = large.withColumn("_salt", _salt("v")).join(several, [*by, "u", "_salt"]).select(*by, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(parts)
        e = cut(small.unionByName(least.select(*by, "u", F.col("m").alias("v"))).distinct().coalesce(parts))
    return _attach(nodes, e.groupBy(*by, F.col("u").alias("node")).agg(F.min("v").alias("component")), by)


def _salt(col: str) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(SALTS))


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def _attach(nodes: DataFrame, root: DataFrame, by: list[str]) -> DataFrame:
    return nodes.join(root, [*by, "node"], "left").withColumn("component", F.coalesce("component", "node"))


def _stars(by: Sequence[str]):
    """Edges of a task -> one edge from each node to the smallest that these edges join it with."""

    def contract(table: pa.Table) -> pa.RecordBatch:
        part = list(zip(*(table.column(c).to_pylist() for c in by))) if by else [()] * table.num_rows
        root: dict[tuple, int] = {}  # (group, node) -> a smaller node, or itself
        for key, u, v in zip(part, table.column("u").to_pylist(), table.column("v").to_pylist()):
            low, high = sorted((find(root, key, u), find(root, key, v)))
            root[key, high] = low
        rows = [(*key, node, low) for key, node in root if (low := find(root, key, node)) != node]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(table.schema), table.schema)], schema=table.schema)

    def find(root: dict[tuple, int], key: tuple, node: int) -> int:
        while (up := root.setdefault((key, node), node)) != node:
            root[key, node] = root[key, up]
            node = up
        return node

    def run(batches):
        waiting, rows = [], 0
        for batch in batches:
            waiting, rows = [*waiting, batch], rows + batch.num_rows
            if rows >= EDGES_PER_TASK:
                yield contract(pa.Table.from_batches(waiting))
                waiting, rows = [], 0
        if rows:
            yield contract(pa.Table.from_batches(waiting))

    return run


def _shape(e: DataFrame, by: Sequence[str]):
    """Number of edges, and whether any node but the end of stars is left: one with two edges down, or one down and one up."""
    ends = [F.struct(F.col(c).alias("node"), F.lit(down).alias("down")) for c, down in (("u", 1), ("v", 0))]
    at = e.select(*by, F.explode(F.array(*ends)).alias("_end")).select(*by, "_end.*").groupBy(*by, "node").agg(F.sum("down").alias("down"), F.count("*").alias("all"))
    between = (F.col("down") > 1) | ((F.col("down") == 1) & (F.col("all") > 1))
    return at.agg(F.sum("down").alias("n"), F.coalesce(F.max(between), F.lit(False)).alias("open")).first()
