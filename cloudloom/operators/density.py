"""Density diagnostics: spacing, buckets, survival and yield."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.functions.weights import density_bucket
from cloudloom.operators.neighbors import k_nearest
from cloudloom.operators.stats import median, quantiles
from cloudloom.session import cut


def knn_density(points: DataFrame, by: Sequence[str], k: int = 10) -> DataFrame:
    """Mean distance to the ``k`` nearest neighbours of every point."""
    near = k_nearest(points, points, k, by=by, exclude_self=True)
    return near.groupBy(*by, "point_id").agg(F.avg("distance").alias("density"))


def spacing(points: DataFrame, by: Sequence[str], k: int, default: float = 0.01, ident: str = "point_id") -> DataFrame:
    """Median neighbour distance per group; ``default`` for groups with fewer than two points."""
    near = k_nearest(points, points, k, by=by, query_id=ident, base_id=ident, exclude_self=True)
    med = median(near, by, "distance", "spacing")
    groups = points.select(*by).distinct()
    return groups.join(med, list(by), "left").withColumn("spacing", F.coalesce("spacing", F.lit(default)))


def bucketed(density: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds ``bucket`` from the 25th and 75th percentile of the group."""
    density = cut(density)
    out = density.join(quantiles(density, by, "density", [0.25, 0.75]), list(by))
    return out.withColumn("bucket", density_bucket(F.col("density"), F.col("q0"), F.col("q1"))).drop("q0", "q1")


def _all_buckets(df: DataFrame, by: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(b) for b in ("dense", "mid", "sparse")])
    return df.select(*by).distinct().withColumn("bucket", F.explode(names))


def survival(buckets: DataFrame, members: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per bucket: points, points in a cluster, rate, noise, mean size of their clusters."""
    sizes = members.groupBy(*by, "cluster_id").agg(F.count("*").alias("size"))
    member = members.join(sizes, [*by, "cluster_id"]).select(*by, "point_id", "size")
    joined = buckets.join(member, [*by, "point_id"], "left")
    stats = joined.groupBy(*by, "bucket").agg(
        F.count("*").alias("total"), F.count("size").alias("survived"), F.avg("size").alias("mean_size")
    )
    out = _all_buckets(buckets, by).join(stats, [*by, "bucket"], "left").fillna(0, ["total", "survived", "mean_size"])
    rate = F.col("survived") / F.greatest(F.col("total"), F.lit(1))
    return out.withColumn("rate", rate).withColumn("noise", F.col("total") - F.col("survived"))


def edge_yield(buckets: DataFrame, edge: DataFrame, by: Sequence[str], high: float = 0.5) -> DataFrame:
    """Per bucket: valid rate, mean weight of valid points, rate of high weights."""
    joined = buckets.join(edge, [*by, "point_id"])
    valid = F.col("valid") > 0.5
    return joined.groupBy(*by, "bucket").agg(
        F.count("*").alias("total"),
        F.avg(F.when(valid, 1.0).otherwise(0.0)).alias("valid_rate"),
        F.coalesce(F.avg(F.when(valid, F.col("support"))), F.lit(0.0)).alias("mean_weight"),
        F.avg(F.when(valid & (F.col("support") >= high), 1.0).otherwise(0.0)).alias("high_rate"),
    )


def dense_sparse_gap(stats: DataFrame, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """dense minus sparse, per measure."""
    def pick(bucket, m):
        return F.max(F.when(F.col("bucket") == bucket, F.col(m)))

    return stats.groupBy(*by).agg(*[(pick("dense", m) - pick("sparse", m)).alias(f"{m}_gap") for m in measures])


def agreement(df: DataFrame, thresholds: Sequence[float], by: Sequence[str] = (), mask="knn_edge", support="support") -> DataFrame:
    """Overlap, IoU and the two recalls of a mask against support thresholds."""
    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    m = F.col(mask)
    counts = []
    for i, t in enumerate(thresholds):
        p = F.col(support) > F.lit(float(t))
        counts += [F.count_if(m & p).alias(f"b{i}"), F.count_if(p).alias(f"p{i}")]
    wide = df.groupBy(*by).agg(F.count_if(m).alias("mask"), *counts)
    rows = F.array(*[F.struct(levels[i].alias("threshold"), F.col(f"b{i}").alias("both"), F.col(f"p{i}").alias("proxy"), F.col("mask"))
                     for i in range(len(thresholds))])
    out = wide.select(*by, F.inline(rows))
    union = F.col("mask") + F.col("proxy") - F.col("both")
    one = F.lit(1)
    return out.select(
        *by, "threshold", "proxy", "mask", "both",
        (F.col("both") / F.greatest(union, one)).alias("iou"),
        (F.col("both") / F.greatest(F.col("proxy"), one)).alias("recall_proxy"),
        (F.col("both") / F.greatest(F.col("mask"), one)).alias("recall_mask"),
    )
