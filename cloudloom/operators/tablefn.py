"""Table functions for SQL: samples along segments, and padded bounds of each chunk of a table argument."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn


class SegmentSamples:
    """``segment_samples(ax, ay, az, bx, by, bz, step)``: (i, x, y, z), evenly spaced, both ends included."""

    @staticmethod
    def analyze(*args: AnalyzeArgument) -> AnalyzeResult:
        if len(args) != 7:
            raise ValueError("segment_samples takes the six coordinates of a segment and a step")
        step = args[6]
        if step.isConstantExpression and (step.value is None or not float(step.value) > 0):
            raise ValueError("the step of segment_samples must be above 0")
        return AnalyzeResult(StructType([StructField("i", IntegerType()), *[StructField(a, DoubleType()) for a in "xyz"]]))

    def eval(self, *args) -> Iterator[tuple]:
        ends = [None if v is None else float(v) for v in args]
        if any(v is None or not math.isfinite(v) for v in ends):
            return
        a, b, step = ends[:3], ends[3:6], ends[6]
        n = max(math.ceil(math.dist(a, b) / step) + 1, 2)
        for i in range(n):
            t = i / (n - 1)
            yield (i, *[p + t * (q - p) for p, q in zip(a, b)])


class PaddedBounds:
    """``padded_bounds(TABLE(points), key, pad)``: box and size of each value of the column named ``key``, widened by ``pad``.

    The function itself asks for its table to be partitioned by that column, so the caller needs no PARTITION BY. Rows
    stream; the state is one box.
    """

    def __init__(self, found=None):
        self.lo, self.hi, self.n, self.key, self.pad = [math.inf] * 3, [-math.inf] * 3, 0, None, 0.0

    @staticmethod
    def analyze(points: AnalyzeArgument, key: AnalyzeArgument, pad: AnalyzeArgument) -> AnalyzeResult:
        if not points.isTable:
            raise ValueError("padded_bounds takes a table first")
        fields = {f.name: f for f in points.dataType.fields}
        missing = [c for c in ("x", "y", "z", key.value) if c not in fields]
        if missing:
            raise ValueError(f"padded_bounds: the table has no column {', '.join(map(str, missing))}")
        out = [StructField(key.value, fields[key.value].dataType), StructField("n", LongType())]
        out += [StructField(f"{a}_{e}", DoubleType()) for a in "xyz" for e in ("min", "max")]
        return AnalyzeResult(StructType(out), partitionBy=[PartitioningColumn(key.value)])

    def eval(self, points: Row, key: str, pad: float) -> None:
        self.key, self.pad = points[key], float(pad)
        self.n += 1
        for i, a in enumerate("xyz"):
            self.lo[i], self.hi[i] = min(self.lo[i], points[a]), max(self.hi[i], points[a])

    def terminate(self) -> Iterator[tuple]:
        if self.n:
            yield (self.key, self.n, *[v for lo, hi in zip(self.lo, self.hi) for v in (lo - self.pad, hi + self.pad)])


def register(spark: SparkSession) -> None:
    """Makes the functions callable from SQL text of this session."""
    spark.udtf.register("segment_samples", udtf(SegmentSamples))
    spark.udtf.register("padded_bounds", udtf(PaddedBounds))
