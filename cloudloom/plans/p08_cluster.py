"""Clustering and the composed edge pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.operators import clustering
from cloudloom.operators.axes import mean_tangent
from cloudloom.plans.derived import SIZE, cluster_members
from cloudloom.plans.p03_joins import D2
from cloudloom.plans.registry import q6, query, r6
from cloudloom.sources.tables import scan_points

EPS = 0.09


def _centers(spark, root):
    return scan_points(spark, root).select(
        "scene_id", F.col("point_id").alias("center_id"), (F.col("segment") % 2).alias("label_a"), (F.col("segment") % 2 + 2).alias("label_b"),
        "x", "y", "z", F.col("nx").alias("tx"), F.col("ny").alias("ty"), F.col("nz").alias("tz"),
    )


DB_SQL = f"""RECURSIVE e AS (SELECT a.scene_id, a.segment % 2 AS la, a.point_id AS s, b.point_id AS t FROM pts a JOIN pts b ON a.scene_id = b.scene_id AND a.segment % 2 = b.segment % 2 AND sqrt({D2}) <= {EPS}),
 core AS (SELECT s AS id FROM e GROUP BY 1 HAVING count(*) >= 3), ce AS (SELECT s, t FROM e WHERE s IN (SELECT id FROM core) AND t IN (SELECT id FROM core)),
 r AS (SELECT id, id AS root FROM core UNION SELECT ce.t, r.root FROM r JOIN ce ON r.id = ce.s), c AS (SELECT id, min(root) AS cluster FROM r GROUP BY 1),
 b AS (SELECT e.s AS id, min(c.cluster) AS cluster FROM e JOIN c ON e.t = c.id WHERE e.s NOT IN (SELECT id FROM core) GROUP BY 1)"""


@query("cl_dbscan", f"WITH {DB_SQL} SELECT point_id AS center_id, coalesce(c.cluster, b.cluster, -1) AS cluster FROM pts LEFT JOIN c ON c.id = point_id LEFT JOIN b ON b.id = point_id", "pts")
def cl_dbscan(spark, root):
    out = clustering.dbscan(_centers(spark, root), EPS, 3, ["scene_id", "label_a", "label_b"])
    return out.select("center_id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


@query("cl_tangent_groups")
def cl_tangent_groups(spark, root):
    out = clustering.tangent_groups(cluster_members(spark, root), ["cluster_id"], clustering.ClusterConfig().cos_th)
    return out.select("cluster_id", "center_id", "dir_group")


@query("cl_lateral_split")
def cl_lateral_split(spark, root):
    grouped = clustering.tangent_groups(cluster_members(spark, root), ["cluster_id"], clustering.ClusterConfig().cos_th)
    out = clustering.lateral_split(grouped, ["cluster_id", "dir_group"], 0.1, 4)
    return out.select("cluster_id", "dir_group", "center_id", "path")


@query(
    "cl_mean_tangent",
    f"""WITH u AS (SELECT point_id // {SIZE} AS cluster_id, point_id, nx/sqrt(nx*nx+ny*ny+nz*nz) AS x, ny/sqrt(nx*nx+ny*ny+nz*nz) AS y, nz/sqrt(nx*nx+ny*ny+nz*nz) AS z FROM pts),
        f AS (SELECT cluster_id, arg_min(x, point_id) AS fx, arg_min(y, point_id) AS fy, arg_min(z, point_id) AS fz FROM u GROUP BY 1),
        m AS (SELECT cluster_id, avg(CASE WHEN x*fx+y*fy+z*fz >= 0 THEN x ELSE -x END) AS x, avg(CASE WHEN x*fx+y*fy+z*fz >= 0 THEN y ELSE -y END) AS y, avg(CASE WHEN x*fx+y*fy+z*fz >= 0 THEN z ELSE -z END) AS z FROM u JOIN f USING (cluster_id) GROUP BY 1)
        SELECT cluster_id, {q6('x/sqrt(x*x+y*y+z*z)')} AS mtx, {q6('y/sqrt(x*x+y*y+z*z)')} AS mty, {q6('z/sqrt(x*x+y*y+z*z)')} AS mtz FROM m""",
    "pts",
)
def cl_mean_tangent(spark, root):
    out = mean_tangent(cluster_members(spark, root), ["cluster_id"], "center_id")
    return out.select("cluster_id", *[r6(f"mt{a}").alias(f"mt{a}") for a in "xyz"])


@query("cl_merge")
def cl_merge(spark, root):
    micro = clustering.dbscan(_centers(spark, root), EPS, 3, ["scene_id", "label_a", "label_b"])
    out = clustering.merge(micro, ["scene_id", "label_a", "label_b"], 0.03, clustering.ClusterConfig())
    return out.select("center_id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


@query("cl_stage2")
def cl_stage2(spark, root):
    out = clustering.cluster_centers(_centers(spark, root), ["scene_id"], spacing=0.03)
    return out.select("scene_id", "center_id", F.coalesce("cluster", F.lit(-1)).alias("cluster"), "rescued")


@query("edge_supervision")
def edge_supervision(spark, root):
    """Labelled points -> centres -> clusters -> supports -> per-point supervision."""
    from cloudloom.operators.edge import EdgeConfig, build_edge_supervision

    cfg = EdgeConfig(k=16, min_density=1.0, line_residual=0.2, polyline_residual=0.5, radius=0.08)
    edge = build_edge_supervision(scan_points(spark, root), ["scene_id"], cfg)
    return edge.select("scene_id", "point_id", "valid", "support_id", r6("dist", 4).alias("dist"), r6("support", 4).alias("support"))
