"""The composed edge pipeline: points -> centres -> clusters -> supports -> supervision."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.operators import boundary, clustering, supervise
from cloudloom.operators.prefix import numbered
from cloudloom.operators.supports import SupportConfig, fit_supports
from cloudloom.session import cut


@dataclass(frozen=True)
class EdgeConfig:
    """Defaults of the four stages."""

    k: int = 32
    min_cross_ratio: float = 0.15
    min_side_points: int = 4
    ignore: int = -1
    line_residual: float = 0.01
    polyline_residual: float = 0.04
    min_size: int = 4
    max_vertices: int = 32
    min_density: float = 15.0
    radius: float = 0.08
    sigma: float = 0.02


def boundary_stage(points: DataFrame, scene: Sequence[str], cfg: EdgeConfig) -> DataFrame:
    m = boundary.label_moments(points, cfg.k, scene, cfg.ignore, normals="nx" in points.columns)
    cands = boundary.candidates(m, cfg.min_cross_ratio, cfg.ignore)
    centers = boundary.boundary_centers(cands, scene, cfg.min_side_points, normals="nx" in points.columns)
    return centers.select(
        *scene, F.col("point_id").alias("center_id"), "label_a", "label_b", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"),
        "tx", "ty", "tz", "confidence",
    )


def build_edge_supervision(points: DataFrame, scene: Sequence[str], cfg: EdgeConfig = EdgeConfig()) -> DataFrame:
    """Every point with dist, dir, valid, support_id, vec and support.

    Each stage is materialised once; it feeds several joins of the next.
    """
    scene = list(scene)
    centers = cut(boundary_stage(points, scene, cfg))
    members = cut(clustering.cluster_centers(centers, scene).where(F.col("cluster").isNotNull()).withColumnRenamed("cluster", "cluster_id"))
    key = [*scene, "label_a", "label_b", "cluster_id"]
    fit = SupportConfig(cfg.line_residual, cfg.polyline_residual, cfg.min_size, cfg.max_vertices, cfg.min_density)
    fitted = fit_supports(members, key, fit)
    # supports are numbered inside their scene; on ties the first one wins
    sup = cut(numbered(fitted, scene, [*key[len(scene):], "path"], "support_id"))
    segs = cut(supervise.segments_of(sup.select(*scene, "support_id", F.transform("segments", lambda s: s.dropFields("seg")).alias("segments")), scene))
    bad = supervise.bad_supports(sup.withColumn("cluster_id", F.struct(*key[len(scene):])), segs, members.withColumn("cluster_id", F.struct(*key[len(scene):])), scene)
    skip = cut(bad.select(*scene, "support_id"))
    return supervise.supervise(points, sup, segs, cfg.radius, cfg.sigma, cfg.ignore, skip, scene)
