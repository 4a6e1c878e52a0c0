"""Spatial and relational joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.functions import grid, weights
from cloudloom.operators import boundary, chunking, pairs, supervise
from cloudloom.operators.neighbors import k_nearest
from cloudloom.plans.derived import SEGD, SIZE, SUP_SQL, cluster_members, support_tables
from cloudloom.plans.p01_scalar import KEY_SQL
from cloudloom.plans.registry import q6, query, r6
from cloudloom.sources.tables import predictions, scan_points, table

D2 = "((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))"


def knn_sql(k: int, name: str = "knn") -> str:
    return f"""{name} AS (SELECT a.scene_id, a.point_id, a.segment, a.x, a.y, a.z, b.point_id AS nbr_id, b.segment AS nbr_segment, b.x AS bx, b.y AS by_, b.z AS bz,
      b.nx AS bnx, b.ny AS bny, b.nz AS bnz, sqrt({D2}) AS dist, CAST(row_number() OVER (PARTITION BY a.point_id ORDER BY {D2}, b.point_id) AS INTEGER) AS rank
      FROM pts a JOIN pts b ON a.scene_id = b.scene_id AND a.point_id <> b.point_id QUALIFY rank <= {k})"""


@query("jn_knn_self", f"WITH {knn_sql(32)} SELECT scene_id, point_id, nbr_id, rank, {q6('dist')} AS dist FROM knn", "pts")
def jn_knn_self(spark, root):
    pts = scan_points(spark, root)
    out = k_nearest(pts, pts, 32, by=["scene_id"], exclude_self=True)
    return out.select("scene_id", "point_id", "nbr_id", "rank", r6("distance").alias("dist"))


OTHER_SQL = f"oth AS (SELECT a.scene_id, a.point_id, min(sqrt({D2})) AS other_dist FROM pts a LEFT JOIN pts b ON a.scene_id = b.scene_id AND a.segment <> b.segment GROUP BY 1, 2)"


@query(
    "jn_radius_self",
    f"SELECT a.scene_id, a.point_id, EXISTS (SELECT 1 FROM pts b WHERE a.scene_id = b.scene_id AND a.segment <> b.segment AND {D2} <= 0.06::DOUBLE * 0.06::DOUBLE) AS boundary_mask FROM pts a",
    "pts",
)
def jn_radius_self(spark, root):
    return boundary.radius_mask(scan_points(spark, root), 0.06, ["scene_id"]).select("scene_id", "point_id", "boundary_mask")


@query(
    "jn_nn_other_class",
    f"WITH {OTHER_SQL} SELECT scene_id, point_id, {q6('other_dist')} AS other_dist, {q6('CASE WHEN other_dist <= 0.06 THEN 1 WHEN other_dist <= 0.12 THEN exp(-3.0::DOUBLE * (other_dist - 0.06) / 0.06) ELSE 0 END')} AS s_weight FROM oth",
    "pts",
)
def jn_nn_other_class(spark, root):
    out = boundary.nearest_other_class(scan_points(spark, root), ["scene_id"])
    return out.select("scene_id", "point_id", r6("other_dist").alias("other_dist"), r6(weights.decay_weight(F.col("other_dist"))).alias("s_weight"))


@query(
    "jn_nn_rescue",
    f"""WITH a AS (SELECT * FROM pts WHERE point_id % 3 = 0), b AS (SELECT * FROM pts WHERE point_id % 3 <> 0)
        SELECT a.point_id, b.point_id AS nbr_id, b.point_id // {SIZE} AS cluster_id FROM a JOIN b ON a.scene_id = b.scene_id AND sqrt({D2}) <= 0.1
        QUALIFY row_number() OVER (PARTITION BY a.point_id ORDER BY {D2}, b.point_id) = 1""",
    "pts",
)
def jn_nn_rescue(spark, root):
    pts = scan_points(spark, root).withColumn("cluster_id", F.floor(F.col("point_id") / SIZE))
    noise, kept = pts.where("point_id % 3 = 0"), pts.where("point_id % 3 <> 0")
    out = k_nearest(noise, kept, 1, by=["scene_id"], rmax=0.1, carry=["cluster_id"])
    return out.select("point_id", "nbr_id", F.col("nbr_cluster_id").alias("cluster_id"))


@query("jn_label_support", f"WITH {SUP_SQL} SELECT l AS segment, count(*) AS n_supports, min(support_id) AS first_support FROM (SELECT DISTINCT support_id, unnest([label_a, label_b]) AS l FROM supp) GROUP BY 1", "pts")
def jn_label_support(spark, root):
    sup, _ = support_tables(spark, root)
    return supervise.label_index(sup).groupBy("segment").agg(F.count("*").alias("n_supports"), F.min("support_id").alias("first_support"))


NEAREST_SQL = f"""{SUP_SQL}, cand AS (SELECT p.point_id, s.support_id, s.seg, x, y, z, ax, ay, az, bx, by_, bz,
   (bx-ax)*(bx-ax) + (by_-ay)*(by_-ay) + (bz-az)*(bz-az) AS l2, (x-ax)*(bx-ax) + (y-ay)*(by_-ay) + (z-az)*(bz-az) AS dt
   FROM pts p JOIN supp u ON p.segment IN (u.label_a, u.label_b) JOIN seg s USING (support_id)),
 tt AS (SELECT *, CASE WHEN l2 < 1e-8 THEN 0.0 ELSE greatest(0.0, least(1.0, dt / l2)) END AS t FROM cand),
 best AS (SELECT point_id, support_id, sqrt({SEGD}) AS dist, ax+t*(bx-ax)-x AS vx, ay+t*(by_-ay)-y AS vy, az+t*(bz-az)-z AS vz FROM tt
   WHERE sqrt({SEGD}) <= 0.08 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY sqrt({SEGD}), support_id, seg) = 1)"""


@query(
    "jn_nearest_support",
    f"""WITH {NEAREST_SQL} SELECT p.point_id, coalesce(b.support_id, -1) AS support_id, b.point_id IS NOT NULL AS valid,
        CASE WHEN b.point_id IS NULL THEN CAST('Infinity' AS DOUBLE) ELSE {q6('dist')} END AS dist, {q6('coalesce(vx, 0)')} AS vx, {q6('coalesce(vy, 0)')} AS vy, {q6('coalesce(vz, 0)')} AS vz,
        {q6('coalesce(exp(-(dist*dist)/(2*0.02*0.02)), 0)')} AS support FROM pts p LEFT JOIN best b USING (point_id)""",
    "pts",
)
def jn_nearest_support(spark, root):
    sup, segs = support_tables(spark, root)
    out = supervise.supervise(scan_points(spark, root), sup, segs, radius=0.08, sigma=0.02)
    return out.select("point_id", "support_id", "valid", r6("dist").alias("dist"), *[r6(f"vec_{a}").alias(f"v{a}") for a in "xyz"], r6("support").alias("support"))


CEN_SQL = f"cen AS (SELECT point_id // {SIZE} AS cluster_id, count(*) AS size, sum(x)/count(*) AS x, sum(y)/count(*) AS y, sum(z)/count(*) AS z FROM pts GROUP BY 1)"


def _centroids(spark, root):
    return cluster_members(spark, root).groupBy("cluster_id").agg(
        F.count("*").alias("size"), *[(F.sum(a) / F.count("*")).alias(a) for a in "xyz"]
    )


@query("jn_micro_adjacency", f"WITH {CEN_SQL} SELECT a.cluster_id AS cluster_id_i, b.cluster_id AS cluster_id_j, {q6('sqrt' + D2)} AS dist FROM cen a JOIN cen b ON a.cluster_id < b.cluster_id AND {D2} <= 0.06::DOUBLE * 0.06::DOUBLE", "pts")
def jn_micro_adjacency(spark, root):
    out = pairs.radius_pairs(_centroids(spark, root), 0.06, [], "cluster_id")
    return out.select("cluster_id_i", "cluster_id_j", r6(F.sqrt("d2")).alias("dist"))


TILES_SQL = """bb AS (SELECT sample, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM lat GROUP BY 1),
 nn AS (SELECT *, CASE WHEN x1-x0 <= 20 THEN 1 ELSE CAST(ceil((x1-x0-20)/15) AS INTEGER) + 1 END AS nx, CASE WHEN y1-y0 <= 20 THEN 1 ELSE CAST(ceil((y1-y0-20)/15) AS INTEGER) + 1 END AS ny FROM bb),
 xt AS (SELECT *, unnest(range(nx)) AS ix FROM nn), yt AS (SELECT *, unnest(range(ny)) AS iy FROM xt),
 tile AS (SELECT sample, CAST(ix * ny + iy AS INTEGER) AS chunk_idx, CAST(ix AS INTEGER) AS x_tile, CAST(iy AS INTEGER) AS y_tile,
  CASE WHEN nx = 1 THEN x0 WHEN ix = nx-1 THEN least(x0 + ix*15, x1-20) ELSE x0 + ix*15 END AS x_lo, CASE WHEN ix = nx-1 THEN x1 ELSE x0 + ix*15 + 20 END AS x_hi,
  CASE WHEN ny = 1 THEN y0 WHEN iy = ny-1 THEN least(y0 + iy*15, y1-20) ELSE y0 + iy*15 END AS y_lo, CASE WHEN iy = ny-1 THEN y1 ELSE y0 + iy*15 + 20 END AS y_hi FROM yt)"""


@query("jn_chunk_assign", f"WITH {TILES_SQL} SELECT t.sample, chunk_idx, count(*) AS n, {q6('sum(x)', 3)} AS sum_x FROM lat l JOIN tile t ON l.sample = t.sample AND x BETWEEN x_lo AND x_hi AND y BETWEEN y_lo AND y_hi GROUP BY 1, 2", "lat")
def jn_chunk_assign(spark, root):
    from cloudloom.sources.tables import lattice_points

    pts = lattice_points(spark, root)
    assigned = chunking.assign_tiles(pts, 20.0, 5.0, ["sample"])
    return assigned.groupBy("sample", "chunk_idx").agg(F.count("*").alias("n"), r6(F.sum("x"), 3).alias("sum_x"))


@query(
    "jn_nearest_occupied",
    """WITH c AS (SELECT DISTINCT CAST(floor((x + 1) / 0.05) AS BIGINT) AS gx, CAST(floor((y + 1) / 0.05) AS BIGINT) AS gy, segment < 3 AS occ FROM pts),
       o AS (SELECT DISTINCT gx, gy FROM c WHERE occ), e AS (SELECT DISTINCT gx, gy FROM c WHERE (gx, gy) NOT IN (SELECT (gx, gy) FROM o))
       SELECT e.gx, e.gy, o.gx AS near_gx, o.gy AS near_gy FROM e, o QUALIFY row_number() OVER (PARTITION BY e.gx, e.gy ORDER BY (e.gx-o.gx)*(e.gx-o.gx) + (e.gy-o.gy)*(e.gy-o.gy), o.gx, o.gy) = 1""",
    "pts",
)
def jn_nearest_occupied(spark, root):
    cells = scan_points(spark, root).groupBy(
        F.floor((F.col("x") + 1) / 0.05).alias("gx"), F.floor((F.col("y") + 1) / 0.05).alias("gy")
    ).agg(F.bool_or(F.col("segment") < 3).alias("occ"))
    return chunking.nearest_occupied(cells.where(~F.col("occ")).drop("occ"), cells.where("occ").drop("occ"), [])


_VOXF = "vx AS (SELECT CAST(floor(x/0.08::DOUBLE) AS BIGINT) AS gx, CAST(floor(y/0.08::DOUBLE) AS BIGINT) AS gy, CAST(floor(z/0.08::DOUBLE) AS BIGINT) AS gz, bool_or(segment < 5) AS pos FROM pts GROUP BY 1, 2, 3)"


def _voxel_flags(spark, root):
    return scan_points(spark, root).groupBy(*[grid.grid_index(F.col(a), 0.08).alias(f"g{a}") for a in "xyz"]).agg(F.bool_or(F.col("segment") < 5).alias("pos"))


@query(
    "jn_linf_negative",
    f"WITH {_VOXF} SELECT a.gx, a.gy, a.gz, CAST(coalesce(min(greatest(abs(a.gx-b.gx), abs(a.gy-b.gy), abs(a.gz-b.gz))), 99) AS BIGINT) AS depth FROM vx a LEFT JOIN vx b ON NOT b.pos WHERE a.pos GROUP BY 1, 2, 3",
    "pts",
)
def jn_linf_negative(spark, root):
    v = _voxel_flags(spark, root)
    positive = v.where("pos").drop("pos")
    return chunking.shell_depth(positive, v.drop("pos"), [])


@query("jn_setdiff_rows", f"WITH {_VOXF} SELECT gx, gy, gz FROM vx EXCEPT SELECT gx, gy, gz FROM vx WHERE pos", "pts")
def jn_setdiff_rows(spark, root):
    v = _voxel_flags(spark, root)
    return v.select("gx", "gy", "gz").join(v.where("pos").select("gx", "gy", "gz"), ["gx", "gy", "gz"], "left_anti")


@query("jn_inverse", f"WITH k AS (SELECT point_id, {KEY_SQL.format(g='0.1')} AS key, segment FROM pts), v AS (SELECT key, arg_min(segment, point_id) AS voxel_pred FROM k GROUP BY 1) SELECT point_id, key, voxel_pred FROM k JOIN v USING (key)", "pts")
def jn_inverse(spark, root):
    keyed = scan_points(spark, root).select("point_id", grid.voxel_key(F.col("x"), F.col("y"), F.col("z"), 0.1).alias("key"), "segment")
    voxel_pred = keyed.groupBy("key").agg(F.min_by("segment", "point_id").alias("voxel_pred"))
    return keyed.drop("segment").join(voxel_pred, "key")


@query(
    "jn_fragment_vote",
    f"""WITH f AS (SELECT vec_id // 3 AS point_id, i, [CAST(v AS DOUBLE) * 10 FOR v IN embedding[4 + 8*i:11 + 8*i]] AS l FROM embeddings, range(3) r(i)),
        p AS (SELECT point_id, unnest(l) AS v, unnest(range(8)) AS c, list_max(l) AS m, list_sum([exp(w - list_max(l)) FOR w IN l]) AS s FROM f),
        s AS (SELECT point_id, c, sum(exp(v - m) / s) AS prob FROM p GROUP BY 1, 2)
        SELECT point_id, CAST(arg_max(c, (round(prob, 9), -c)) AS INTEGER) AS pred, {q6('max(prob)')} AS prob FROM s GROUP BY 1""",
)
def jn_fragment_vote(spark, root):
    from cloudloom.operators.metrics import fragment_vote

    frag = table(spark, root, "embeddings").select(
        F.floor(F.col("vec_id") / 3).alias("point_id"),
        F.explode(F.array(*[F.slice("embedding", 4 + 8 * i, 8) for i in range(3)])).alias("raw"),
    ).select("point_id", F.transform("raw", lambda v: v.cast("double") * 10).alias("logits"))
    return fragment_vote(frag, ["point_id"], 8).select("point_id", "pred", r6("prob").alias("prob"))


@query("jn_center_cluster", f"WITH s AS (SELECT point_id // {SIZE} AS cluster_id, count(*) AS size FROM pts GROUP BY 1) SELECT point_id AS center_id, cluster_id, size FROM pts JOIN s ON point_id // {SIZE} = cluster_id", "pts")
def jn_center_cluster(spark, root):
    members = cluster_members(spark, root).select("center_id", "cluster_id")
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    return members.join(sizes, "cluster_id").select("center_id", "cluster_id", "size")


@query("jn_support_members", f"WITH {SUP_SQL} SELECT support_id, point_id AS center_id, label_a, label_b FROM supp JOIN pts ON cluster_id = point_id // {SIZE}", "pts")
def jn_support_members(spark, root):
    sup, _ = support_tables(spark, root)
    return sup.join(cluster_members(spark, root), "cluster_id").select("support_id", "center_id", "label_a", "label_b")


@query(
    "jn_coverage",
    """SELECT c_custkey, 'missing' AS problem FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
       UNION ALL SELECT DISTINCT o_custkey, 'unexpected' FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey NOT IN (SELECT c_custkey FROM customer)""",
)
def jn_coverage(spark, root):
    done = table(spark, root, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return pairs.coverage(table(spark, root, "customer"), done, "c_custkey")


# all narrow-band points, each against its 16 nearest ones; a pair found from both sides counts once
ORDINAL_SQL = f"""nb AS (SELECT *, 1/(1+exp(-support_logit)) AS prob, sqrt(vx*vx+vy*vy+vz*vz) AS dist FROM pred WHERE valid > 0.5 AND support > 0.1 QUALIFY count(*) OVER (PARTITION BY scene_id) >= 4),
 orp AS (SELECT a.scene_id, CASE WHEN a.dist < b.dist THEN a.prob - b.prob ELSE b.prob - a.prob END AS gap FROM nb a JOIN nb b ON a.scene_id = b.scene_id AND a.point_id < b.point_id
   WHERE sqrt({D2}) < 0.15::DOUBLE AND abs(a.dist - b.dist) > 0.02::DOUBLE),
 ord AS (SELECT scene_id, count(*) AS pairs, avg(greatest(0, 0.05::DOUBLE - gap)) AS loss FROM orp GROUP BY 1)"""


@query(
    "jn_ordinal_pairs",
    f"WITH {ORDINAL_SQL} SELECT scene_id, pairs, {q6('loss')} AS loss FROM ord",
    "pred",
)
def jn_ordinal_pairs(spark, root):
    from cloudloom.operators.losses import ordinal_pairs

    out = ordinal_pairs(predictions(spark, root))
    return out.select("scene_id", "pairs", r6("loss").alias("loss"))


_BASIN = """bs AS (SELECT *, point_id % 7 AS basin, px/greatest(sqrt(px*px+py*py+pz*pz),1e-6) AS ux, py/greatest(sqrt(px*px+py*py+pz*pz),1e-6) AS uy, pz/greatest(sqrt(px*px+py*py+pz*pz),1e-6) AS uz
   FROM pred WHERE valid > 0.5 AND sqrt(vx*vx+vy*vy+vz*vz) > 0.001)"""
BASIN_NN = f"""{_BASIN}, nnb AS (SELECT a.scene_id, a.basin, a.point_id, b.point_id AS nbr_id, a.ux*b.ux+a.uy*b.uy+a.uz*b.uz AS cos FROM bs a JOIN bs b ON a.scene_id = b.scene_id AND a.basin = b.basin AND a.point_id <> b.point_id
   QUALIFY row_number() OVER (PARTITION BY a.point_id ORDER BY {D2}, b.point_id) = 1 AND {D2} < 0.30::DOUBLE * 0.30::DOUBLE)"""


@query("jn_basin_nn", f"WITH {BASIN_NN} SELECT scene_id, basin, point_id, nbr_id, {q6('cos')} AS cos FROM nnb", "pred")
def jn_basin_nn(spark, root):
    from cloudloom.operators.losses import basin_neighbours

    out = basin_neighbours(predictions(spark, root).withColumn("basin", F.col("point_id") % 7))
    return out.select("scene_id", "basin", "point_id", "nbr_id", r6("cos").alias("cos"))


PATCH_SQL = """pa AS (SELECT *, point_id // 48 AS patch, px/greatest(sqrt(px*px+py*py+pz*pz),1e-6) AS ux, py/greatest(sqrt(px*px+py*py+pz*pz),1e-6) AS uy, pz/greatest(sqrt(px*px+py*py+pz*pz),1e-6) AS uz FROM pred),
 pp AS (SELECT a.scene_id, a.patch, a.ux*b.ux+a.uy*b.uy+a.uz*b.uz AS cos FROM pa a JOIN pa b ON a.scene_id = b.scene_id AND a.patch = b.patch AND a.truth = b.truth AND a.truth >= 0 AND a.point_id <> b.point_id)"""


@query("jn_patch_pairs", f"WITH {PATCH_SQL} SELECT scene_id, patch, count(*) AS pairs, {q6('sum(1 - cos)', 5)} AS loss_sum FROM pp GROUP BY 1, 2", "pred")
def jn_patch_pairs(spark, root):
    from cloudloom.operators.losses import patch_pairs

    return patch_pairs(predictions(spark, root), ["scene_id"]).select("scene_id", "patch", "pairs", r6("loss_sum", 5).alias("loss_sum"))
