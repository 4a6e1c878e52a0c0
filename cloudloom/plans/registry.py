"""Registry of named queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}

# Oracle views matching cloudloom.sources.tables
VIEWS = {
    "pts": """pts AS (SELECT vec_id % 4 AS scene_id, vec_id AS point_id,
        CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z,
        label AS segment, CAST(embedding[14] AS DOUBLE) AS nx, CAST(embedding[15] AS DOUBLE) AS ny,
        CAST(embedding[16] AS DOUBLE) AS nz FROM embeddings)""",
    "lat": """lat AS (SELECT l_suppkey % 5 AS sample, l_quantity AS x, round(l_discount * 100) AS y,
        round(l_tax * 100) AS z, CAST((l_partkey + l_linenumber) % 17 AS INTEGER) AS c FROM lineitem)""",
    "pred": """pred AS (SELECT vec_id % 4 AS scene_id, vec_id AS point_id, vec_id % 8 AS batch_id,
        CASE WHEN label >= 8 THEN -1 ELSE label END AS truth,
        least(CASE WHEN vec_id % 3 = 0 THEN (label + 1) % 10 ELSE label END, 7) AS pred,
        [CAST(v AS DOUBLE) * 10 FOR v IN embedding[4:11]] AS logits,
        CAST(embedding[17] AS DOUBLE) AS vx, CAST(embedding[18] AS DOUBLE) AS vy, CAST(embedding[19] AS DOUBLE) AS vz,
        least(abs(CAST(embedding[12] AS DOUBLE)) * 4, 1.0::DOUBLE) AS support,
        CASE WHEN CAST(embedding[13] AS DOUBLE) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS valid,
        CAST(embedding[21] AS DOUBLE) AS px, CAST(embedding[22] AS DOUBLE) AS py, CAST(embedding[23] AS DOUBLE) AS pz,
        CAST(embedding[24] AS DOUBLE) * 10 AS support_logit, abs(CAST(embedding[25] AS DOUBLE)) AS dist_pred,
        CAST(embedding[26] AS DOUBLE) * 10 AS side_logit,
        CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z
        FROM embeddings)""",
}


def query(name: str, oracle: str | None = None, views: str = "") -> Callable[[Builder], Builder]:
    """Register a query; ``views`` names the oracle views its SQL builds on."""

    def wrap(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if oracle is not None:
            with_list = [VIEWS[v] for v in views.split()]
            text = oracle.strip()
            if with_list:
                rest = text[5:].lstrip() if text[:5].upper() == "WITH " else None
                head = "WITH "
                if rest and rest.upper().startswith("RECURSIVE "):
                    head, rest = "WITH RECURSIVE ", rest[10:]
                text = head + ", ".join(with_list) + (", " + rest if rest else " " + text)
            ORACLES[name] = text
        return fn

    return wrap


def r6(col: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison across engines; never returns -0.0."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("double"), digits) + F.lit(0.0)


def q6(text: str, digits: int = 6) -> str:
    """The same rounding as ``r6`` in oracle SQL."""
    return f"(round(CAST({text} AS DOUBLE), {digits}) + 0.0::DOUBLE)"
