"""Views of the given tables in the shapes the operators expect.

``embeddings`` stands for a small labelled scan (its first three dimensions are
the position), ``lineitem`` for a large lattice cloud with many points per
voxel.  Only the columns a view needs are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def _dim(i: int) -> Column:
    return F.col("embedding")[i].cast("double")


def scan_points(spark: SparkSession, root: str) -> DataFrame:
    """scene_id, point_id, x, y, z, segment (0..9), nx, ny, nz."""
    return table(spark, root, "embeddings").select(
        (F.col("vec_id") % 4).alias("scene_id"),
        F.col("vec_id").alias("point_id"),
        *[_dim(i).alias(n) for i, n in enumerate("xyz")],
        F.col("label").alias("segment"),
        *[_dim(13 + i).alias(n) for i, n in enumerate(("nx", "ny", "nz"))],
    )


def lattice_points(spark: SparkSession, root: str) -> DataFrame:
    """sample, x, y, z, c (0..16): the raw, unvoxelised cloud."""
    return table(spark, root, "lineitem").select(
        (F.col("l_suppkey") % 5).alias("sample"),
        F.col("l_quantity").alias("x"),
        F.round(F.col("l_discount") * 100).alias("y"),
        F.round(F.col("l_tax") * 100).alias("z"),
        ((F.col("l_partkey") + F.col("l_linenumber")) % 17).cast("int").alias("c"),
    )


def predictions(spark: SparkSession, root: str) -> DataFrame:
    """One row per point: 8 logits, truth (-1 is ignored), edge truth and edge prediction."""
    label = F.col("label")
    truth = F.when(label >= 8, F.lit(-1)).otherwise(label)
    guess = F.when(F.col("vec_id") % 3 == 0, (label + 1) % 10).otherwise(label)
    return table(spark, root, "embeddings").select(
        (F.col("vec_id") % 4).alias("scene_id"),
        F.col("vec_id").alias("point_id"),
        (F.col("vec_id") % 8).alias("batch_id"),
        truth.cast("int").alias("truth"),
        F.least(guess, F.lit(7)).cast("int").alias("pred"),
        F.transform(F.slice("embedding", 4, 8), lambda v: v.cast("double") * 10).alias("logits"),
        *[_dim(16 + i).alias(n) for i, n in enumerate(("vx", "vy", "vz"))],
        F.least(F.abs(_dim(11)) * 4, F.lit(1.0)).alias("support"),
        F.when(_dim(12) > 0, 1.0).otherwise(0.0).alias("valid"),
        *[_dim(20 + i).alias(n) for i, n in enumerate(("px", "py", "pz"))],
        (_dim(23) * 10).alias("support_logit"),
        F.abs(_dim(24)).alias("dist_pred"),
        (_dim(25) * 10).alias("side_logit"),
        *[_dim(i).alias(n) for i, n in enumerate("xyz")],
    )
