"""Clusters, supports and segments derived from the given tables, with their oracle text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.sources.tables import scan_points

# 25 consecutive points form a cluster; every fifth is a vertex of its polyline.
SIZE = 25

SUP_SQL = f"""vtx AS (SELECT point_id // {SIZE} AS support_id, point_id, segment, x, y, z FROM pts WHERE point_id % 5 = 0),
 seg0 AS (SELECT support_id, CAST(row_number() OVER w - 1 AS INTEGER) AS seg, x AS ax, y AS ay, z AS az, lead(x) OVER w AS bx, lead(y) OVER w AS by_, lead(z) OVER w AS bz
   FROM vtx WINDOW w AS (PARTITION BY support_id ORDER BY point_id)),
 seg AS (SELECT * FROM seg0 WHERE bx IS NOT NULL),
 sup AS (SELECT support_id, arg_min(segment, point_id) AS l0 FROM vtx GROUP BY 1),
 supp AS (SELECT support_id, least(l0, (l0 + 1) % 10) AS label_a, greatest(l0, (l0 + 1) % 10) AS label_b, support_id AS cluster_id FROM sup)"""

SEGD = """((x-(ax+t*(bx-ax)))*(x-(ax+t*(bx-ax))) + (y-(ay+t*(by_-ay)))*(y-(ay+t*(by_-ay))) + (z-(az+t*(bz-az)))*(z-(az+t*(bz-az))))"""


def support_tables(spark, root) -> tuple[DataFrame, DataFrame]:
    pts = scan_points(spark, root)
    vertices = pts.where(F.col("point_id") % 5 == 0).withColumn("support_id", F.floor(F.col("point_id") / SIZE))
    w = Window.partitionBy("support_id").orderBy("point_id")  # five rows per support
    segs = vertices.select(
        "support_id", (F.row_number().over(w) - 1).alias("seg"),
        *[F.col(a).alias(f"a{a}") for a in "xyz"], *[F.lead(a).over(w).alias(f"b{a}") for a in "xyz"],
    ).where(F.col("bx").isNotNull())
    sup = vertices.groupBy("support_id").agg(F.min_by("segment", "point_id").alias("l0"))
    other = (F.col("l0") + 1) % 10
    sup = sup.select("support_id", F.least("l0", other).alias("label_a"), F.greatest("l0", other).alias("label_b"), F.col("support_id").alias("cluster_id"))
    return sup, segs


def cluster_members(spark, root) -> DataFrame:
    """Every point is a centre of its 25-point cluster; the normal columns are its tangent."""
    return scan_points(spark, root).select(
        F.floor(F.col("point_id") / SIZE).alias("cluster_id"), F.col("point_id").alias("center_id"), "x", "y", "z",
        F.col("nx").alias("tx"), F.col("ny").alias("ty"), F.col("nz").alias("tz"), "segment",
    )
