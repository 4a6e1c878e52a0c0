"""Stage tables: explicit schemas, flat export of ragged supports, parquet reading and writing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_D, _L, _I = T.DoubleType(), T.LongType(), T.IntegerType()


def _schema(**cols) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in cols.items()])


CENTERS = _schema(scene_id=_L, center_id=_L, label_a=_I, label_b=_I, x=_D, y=_D, z=_D, tx=_D, ty=_D, tz=_D, confidence=_D)
MEMBERS = _schema(scene_id=_L, center_id=_L, cluster_id=_L)
SEGMENT = _schema(seg=_I, ax=_D, ay=_D, az=_D, bx=_D, by=_D, bz=_D)
SUPPORTS = _schema(
    scene_id=_L, support_id=_L, support_type=_I, label_a=_I, label_b=_I, cluster_id=_L, confidence=_D, residual=_D, coverage=_D,
    segments=T.ArrayType(SEGMENT),
)
STAGES = {"boundary_centers": CENTERS, "local_clusters": MEMBERS, "supports": SUPPORTS}


def read_stage(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stage table with its fixed schema; missing or mistyped columns fail."""
    want = STAGES[name]
    df = spark.read.parquet(f"{root}/{name}")
    have = {f.name: f.dataType for f in df.schema.fields}
    for f in want.fields:
        if f.name not in have:
            raise ValueError(f"{name}: missing column {f.name}")
        if have[f.name].simpleString() != f.dataType.simpleString():
            raise ValueError(f"{name}.{f.name}: {have[f.name].simpleString()} instead of {f.dataType.simpleString()}")
    return df.select(*[f.name for f in want.fields])


def write_stage(df: DataFrame, root: str, name: str) -> None:
    want = STAGES[name]
    df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in want.fields]).write.mode("overwrite").parquet(f"{root}/{name}")


def flat_supports(supports: DataFrame, order: Sequence[str], scene: Sequence[str] = ()) -> DataFrame:
    """Numbers the supports of a scene and gives each its range in the flat segment list.

    One row per support, far fewer than points; numbered within a scene.
    """
    w = (Window.partitionBy(*scene) if scene else Window.partitionBy(F.lit(0))).orderBy(*order)
    n = F.coalesce(F.size("segments"), F.lit(0))
    n = F.greatest(n, F.lit(0))
    return supports.withColumn("support_id", F.row_number().over(w) - 1).withColumn("segment_length", n).withColumn(
        "segment_offset", F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
