"""Consistent normal signs: minimum spanning forest of the neighbour graph, then signs along it.

Borůvka rounds on edges between components.  Every round takes the lightest edge
of each component, hooks the component to the one on the other side, and shortens
the chains of hooks by pointer doubling.  A hook carries a sign: +1 when the two
normals at its edge agree as seen from the components' representatives, -1 when
one side has to be turned.  Doubling multiplies signs as it adds up steps, so after
the last round each point knows its component's representative and its own sign
towards it; no tree is ever walked.  Components at least halve each round.

Edges are ordered by (weight, u, v), so the forest is unique.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.functions import geometry as g
from cloudloom.operators.neighbors import k_nearest
from cloudloom.session import cut

#: Tasks that share the edges of one component; the last component may hold them all.
SALTS = 16
WEIGHT_DIGITS = 9


def tangent_graph(points: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """Undirected edges (by..., u, v, w, s), u < v, to the ``k`` nearest: w = 1 - |cos| of the normals, s = sign of cos."""
    near = k_nearest(points, points, k, by=by, exclude_self=True, carry=["nx", "ny", "nz"], keep=["nx", "ny", "nz"])
    n, m = g.unit_or_zero(g.vec("n")), g.unit_or_zero(tuple(F.col(f"nbr_n{a}") for a in "xyz"))
    cos = F.round(g.dot(n, m), WEIGHT_DIGITS)
    ends = near.select(*by, F.least("point_id", "nbr_id").alias("u"), F.greatest("point_id", "nbr_id").alias("v"), cos.alias("_c"))
    both = ends.groupBy(*by, "u", "v").agg(F.min("_c").alias("_c"))
    return both.select(*by, "u", "v", (1 - F.abs("_c")).alias("w"), F.when(F.col("_c") < 0, -1).otherwise(1).alias("s"))


def _salt(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS))


def _renamed(edges: DataFrame, root: DataFrame, by: list[str], side: str) -> DataFrame:
    """One end of the edges moved to its component's new representative, the sign with it; edges of one end over ``SALTS`` tasks."""
    spread = root.select(*by, F.col("node").alias(side), F.col("up").alias("_to"), F.col("sign").alias("_by"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
    joined = edges.withColumn("_salt", _salt("u", "v")).join(spread, [*by, side, "_salt"], "left").drop("_salt")
    return joined.withColumns({side: F.coalesce("_to", side), "s": F.col("s") * F.coalesce("_by", F.lit(1))}).drop("_to", "_by")


def _hooks(edges: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The lightest edge of every component: (by, node, up, sign) with one end of each mutual pair as root, and the edges taken."""
    pick = F.struct("w", "u", "v")
    out = edges.select(*by, F.col("a").alias("node"), F.col("b").alias("up"), "w", "u", "v", "s").unionByName(
        edges.select(*by, F.col("b").alias("node"), F.col("a").alias("up"), "w", "u", "v", "s"))
    least = cut(out.groupBy(*by, "node").agg(F.min_by(F.struct("up", "s", "u", "v"), pick).alias("_e")).select(*by, "node", "_e.*"))
    taken = least.select(*by, "u", "v").distinct()
    back = least.select(*by, F.col("node").alias("up"), F.col("up").alias("_back"))
    hook = least.join(back, [*by, "up"])
    top = (F.col("_back") == F.col("node")) & (F.col("node") < F.col("up"))
    return hook.select(*by, "node", F.when(top, F.col("node")).otherwise(F.col("up")).alias("up"), F.when(top, 1).otherwise(F.col("s")).alias("sign")), taken


def _doubled(hook: DataFrame, by: list[str]) -> DataFrame:
    """Follows hooks to the roots: each step joins the table with itself, so a chain of n hooks takes log2(n) steps."""
    hook = cut(hook)
    while True:
        above = hook.select(*by, F.col("node").alias("up"), F.col("up").alias("_up"), F.col("sign").alias("_sign"))
        nxt = hook.join(above, [*by, "up"]).select(*by, "node", F.col("_up").alias("up"), (F.col("sign") * F.col("_sign")).alias("sign"), (F.col("_up") != F.col("up")).alias("_moved"))
        nxt = cut(nxt)
        moved = not nxt.where("_moved").isEmpty()
        hook = nxt.drop("_moved")
        if not moved:
            return hook


def spanning_forest(nodes: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Signs of all nodes and the forest's edges.

    ``nodes``: (by..., node); ``edges``: (by..., u, v, w, s), u < v.  Returns (by..., node, component, sign), the component
    named by its representative, and (by..., u, v).
    """
    by = list(by)
    state = cut(nodes.select(*by, "node", F.col("node").alias("component"), F.lit(1).alias("sign")))
    left = cut(edges.where("u <> v").select(*by, F.col("u").alias("a"), F.col("v").alias("b"), "w", "u", "v", "s"))
    forest = None
    while not left.isEmpty():
        hook, taken = _hooks(left, by)
        taken = cut(taken)
        forest = taken if forest is None else forest.unionByName(taken)
        root = _doubled(hook, by)
        moved = root.select(*by, F.col("node").alias("component"), F.col("up").alias("_to"), F.col("sign").alias("_by"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
        state = state.withColumn("_salt", _salt("node")).join(moved, [*by, "component", "_salt"], "left").select(
            *by, "node", F.coalesce("_to", "component").alias("component"), (F.col("sign") * F.coalesce("_by", F.lit(1))).alias("sign"))
        state = cut(state)
        left = _renamed(_renamed(left, root, by, "a"), root, by, "b").where("a <> b")
        # of the edges between two components only the lightest can ever be taken
        left = left.withColumns({"_lo": F.least("a", "b"), "_hi": F.greatest("a", "b")}).groupBy(*by, "_lo", "_hi").agg(F.min(F.struct("w", "u", "v", "s")).alias("_e"))
        left = cut(left.select(*by, F.col("_lo").alias("a"), F.col("_hi").alias("b"), "_e.*"))
    if forest is None:
        forest = edges.select(*by, "u", "v").where("false")
    return state, forest


def oriented(points: DataFrame, by: Sequence[str], k: int = 30, up: str = "z") -> tuple[DataFrame, DataFrame]:
    """Points with normals of one sign along the forest, and the forest (by..., u, v).

    Each component is turned so that the normal at its point of largest ``up`` (ties: smallest id) does not point down.
    Adds ``component``.  Points without normals, or alone, keep their own sign apart from that rule.
    """
    by = list(by)
    points = cut(points)
    graph = cut(tangent_graph(points, by, k))
    state, forest = spanning_forest(points.select(*by, F.col("point_id").alias("node")), graph, by)
    signed = points.join(state.withColumnRenamed("node", "point_id"), [*by, "point_id"])
    top = signed.groupBy(*by, "component").agg(F.max_by(F.when(F.col(f"n{up}") * F.col("sign") < 0, -1).otherwise(1), F.struct(F.col(up), -F.col("point_id"))).alias("_turn"))
    out = signed.join(top, [*by, "component"])
    turn = F.col("sign") * F.col("_turn")
    return out.withColumns({f"n{a}": F.col(f"n{a}") * turn for a in "xyz"}).drop("sign", "_turn"), forest
