"""Denoise, normals and fitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.functions import geometry as g
from cloudloom.operators import boundary, denoise, supervise, supports
from cloudloom.plans.derived import SEGD, SIZE, SUP_SQL, cluster_members, support_tables
from cloudloom.plans.p03_joins import D2, knn_sql
from cloudloom.plans.p04_stats import CENTER_SQL, SCENE, moments
from cloudloom.plans.registry import q6, query, r6
from cloudloom.sources.tables import scan_points


@query("dn_sor", f"WITH {knn_sql(30)}, m AS (SELECT scene_id, point_id, avg(dist) AS d FROM knn GROUP BY 1, 2), l AS (SELECT scene_id, avg(d) + 1.0 * stddev_samp(d) AS lim FROM m GROUP BY 1) SELECT scene_id, point_id FROM m JOIN l USING (scene_id) WHERE d <= lim", "pts")
def dn_sor(spark, root):
    return denoise.statistical(scan_points(spark, root), SCENE, 30, 1.0).select("scene_id", "point_id")


@query("dn_radius", f"SELECT a.scene_id, a.point_id FROM pts a JOIN pts b ON a.scene_id = b.scene_id AND a.point_id <> b.point_id AND {D2} <= 0.12::DOUBLE * 0.12::DOUBLE GROUP BY 1, 2 HAVING count(*) >= 8", "pts")
def dn_radius(spark, root):
    return denoise.radius(scan_points(spark, root), SCENE, 8, 0.12).select("scene_id", "point_id")


@query("dn_mls", f"WITH {knn_sql(19)}, u AS (SELECT point_id, bx, by_, bz FROM knn UNION ALL SELECT point_id, x, y, z FROM pts) SELECT point_id, {q6('avg(bx)')} AS x, {q6('avg(by_)')} AS y, {q6('avg(bz)')} AS z FROM u GROUP BY 1", "pts")
def dn_mls(spark, root):
    return denoise.moving_average(scan_points(spark, root), SCENE, 20).select("point_id", *[r6(a).alias(a) for a in "xyz"])


@query("dn_ransac")
def dn_ransac(spark, root):
    kept = denoise.plane(scan_points(spark, root), SCENE, threshold=0.02, iterations=200, seed=42)
    return kept.groupBy("scene_id").agg(F.count("*").alias("inliers"))


@query("dn_dispatch", f"WITH {knn_sql(30)}, m AS (SELECT scene_id, point_id, avg(dist) AS d FROM knn GROUP BY 1, 2), l AS (SELECT scene_id, avg(d) + 2.0 * stddev_samp(d) AS lim FROM m GROUP BY 1) SELECT scene_id, count(*) AS n_before, count_if(d <= lim)::BIGINT AS n_after, {q6('1 - count_if(d <= lim) / count(*)')} AS dropped FROM m JOIN l USING (scene_id) GROUP BY 1", "pts")
def dn_dispatch(spark, root):
    pts = scan_points(spark, root)
    kept = denoise.denoise(pts, [("sor", {"nb": 30, "ratio": 2.0})], SCENE, cap=0.25)
    return denoise.drop_fraction(pts, kept, SCENE).select("scene_id", "n_before", "n_after", r6("dropped").alias("dropped"))


@query("nrm_pca")
def nrm_pca(spark, root):
    n = denoise.normals(scan_points(spark, root), SCENE, 30)
    return n.select("scene_id", "point_id", *[r6(f"n{a}", 4).alias(f"n{a}") for a in "xyz"])


@query("fit_tangent")
def fit_tangent(spark, root):
    c = boundary.boundary_centers(boundary.candidates(moments(spark, root, normals=True), 0.15, ignore=9), SCENE, normals=True)
    return c.select("point_id", "label_a", "label_b", *[r6(f"t{a}", 4).alias(f"t{a}") for a in "xyz"], r6("tangent_score", 4).alias("tangent_score"), r6("confidence", 4).alias("confidence"))


@query(
    "fit_tangent_fb",
    f"""WITH {CENTER_SQL}, u AS (SELECT point_id, (bx-ax)/sep AS nx, (by_-ay)/sep AS ny, (bz-az)/sep AS nz, mx/sqrt(mx*mx+my*my+mz*mz) AS sx, my/sqrt(mx*mx+my*my+mz*mz) AS sy, mz/sqrt(mx*mx+my*my+mz*mz) AS sz FROM cent),
        c AS (SELECT point_id, sy*nz - sz*ny AS x, sz*nx - sx*nz AS y, sx*ny - sy*nx AS z FROM u)
        SELECT point_id, {q6('x/sqrt(x*x+y*y+z*z)', 4)} AS tx, {q6('y/sqrt(x*x+y*y+z*z)', 4)} AS ty, {q6('z/sqrt(x*x+y*y+z*z)', 4)} AS tz FROM c""",
    "pts",
)
def fit_tangent_fb(spark, root):
    from cloudloom.operators.boundary import fallback_tangents

    cands = boundary.candidates(moments(spark, root, normals=True), 0.15, ignore=9)
    return fallback_tangents(cands, SCENE).select("point_id", *[r6(f"t{a}", 4).alias(f"t{a}") for a in "xyz"])


@query("fit_line")
def fit_line(spark, root):
    lines = supports.fit_lines(cluster_members(spark, root), ["cluster_id"])
    return lines.select("cluster_id", "n", *[r6(c).alias(c) for c in ("residual", "coverage", "length")])


@query("fit_polyline")
def fit_polyline(spark, root):
    _, stats = supports.fit_polylines(cluster_members(spark, root), ["cluster_id"])
    return stats.select("cluster_id", "n", "vertices", r6("residual").alias("residual"), r6("coverage").alias("coverage"))


_LOOSE = supports.SupportConfig(line_residual=0.12, polyline_residual=0.5, min_density=1.0, gap_ratio=0.4)


@query("fit_support")
def fit_support(spark, root):
    members = cluster_members(spark, root).withColumn("confidence", F.abs("tx"))
    s = supports.fit_supports(members, ["cluster_id"], _LOOSE)
    return s.select("cluster_id", "path", "support_type", "n", r6("residual").alias("residual"), F.size("segments").alias("segments"), r6("confidence").alias("confidence"))


@query("fit_payload")
def fit_payload(spark, root):
    from cloudloom.sources.stage import flat_supports

    members = cluster_members(spark, root).withColumn("confidence", F.abs("tx"))
    return flat_supports(supports.fit_supports(members, ["cluster_id"], _LOOSE), ["cluster_id", "path"]).select(
        "support_id", "cluster_id", "support_type", "segment_offset", "segment_length"
    )


BAD_SQL = f"""{SUP_SQL}, ln AS (SELECT *, sqrt((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)+(bz-az)*(bz-az)) AS len FROM seg),
 ar AS (SELECT *, sum(len) OVER (PARTITION BY support_id ORDER BY seg) - len AS a0, sum(len) OVER (PARTITION BY support_id) AS tot FROM ln),
 mt AS (SELECT p.point_id, p.x, p.y, p.z, p.nx, p.ny, p.nz, a.*, greatest(0.0, least(1.0, ((x-ax)*(bx-ax)+(y-ay)*(by_-ay)+(z-az)*(bz-az)) / (len*len))) AS t FROM pts p JOIN ar a ON a.support_id = p.point_id // {SIZE}),
 pm AS (SELECT support_id, point_id, arg_min((a0 + t*len)/tot, ({SEGD}, seg)) AS w, any_value(nx) AS nx, any_value(ny) AS ny, any_value(nz) AS nz, any_value(tot) AS tot FROM mt GROUP BY 1, 2),
 en AS (SELECT support_id, arg_max(bx, seg) - arg_min(ax, seg) AS ex, arg_max(by_, seg) - arg_min(ay, seg) AS ey, arg_max(bz, seg) - arg_min(az, seg) AS ez FROM seg GROUP BY 1),
 st AS (SELECT support_id, count(*) AS n, any_value(tot) AS tot, avg(CASE WHEN w BETWEEN 0.2 AND 0.8 THEN 1.0 ELSE 0.0 END) AS middle,
   avg(abs(nx*ex+ny*ey+nz*ez) / (sqrt(nx*nx+ny*ny+nz*nz) * sqrt(ex*ex+ey*ey+ez*ez))) AS al FROM pm JOIN en USING (support_id) GROUP BY 1)"""


@query("fit_bad_support", f"WITH {BAD_SQL} SELECT support_id, CASE WHEN tot >= 0.05 AND middle <= 0.4 THEN 'hollow' ELSE 'diagonal' END AS problem, n, {q6('middle')} AS middle, {q6('al')} AS alignment FROM st WHERE n >= 2 AND ((tot >= 0.05 AND middle <= 0.4) OR al < 0.5)", "pts")
def fit_bad_support(spark, root):
    sup, segs = support_tables(spark, root)
    bad = supervise.bad_supports(sup, segs, cluster_members(spark, root), max_middle=0.4)
    return bad.select("support_id", "problem", "n", r6("middle").alias("middle"), r6("alignment").alias("alignment"))
