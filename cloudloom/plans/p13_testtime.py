"""Oriented normals, test-time fragments with the rotation vote, shifts and crops."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.operators import orient, testtime
from cloudloom.plans.p03_joins import knn_sql
from cloudloom.plans.registry import q6, query, r6
from cloudloom.sources.tables import lattice_points, predictions, scan_points, table

SCENE = ["scene_id"]
_U = "sqrt(nx*nx+ny*ny+nz*nz)"
_DOT = "round(a.nx*b.nx+a.ny*b.ny+a.nz*b.nz, 9)"

# an edge belongs to the forest unless its ends are joined by lighter ones; along the forest each pair has one path and one sign
FOREST_SQL = f"""RECURSIVE un AS (SELECT scene_id, point_id, z, nx/{_U} AS nx, ny/{_U} AS ny, nz/{_U} AS nz FROM pts), {knn_sql(6)},
 raw AS (SELECT DISTINCT scene_id, least(point_id, nbr_id) AS u, greatest(point_id, nbr_id) AS v FROM knn),
 e AS (SELECT r.*, 1 - abs({_DOT}) AS w, CASE WHEN {_DOT} < 0 THEN -1 ELSE 1 END AS s FROM raw r JOIN un a ON a.point_id = u JOIN un b ON b.point_id = v),
 o AS (SELECT *, row_number() OVER (ORDER BY scene_id, w, u, v) AS k FROM e),
 ad AS (SELECT k, u AS p, v AS q, s FROM o UNION ALL SELECT k, v, u, s FROM o),
 re AS (SELECT k, u AS p FROM o UNION SELECT re.k, ad.q FROM re JOIN ad ON ad.p = re.p AND ad.k < re.k),
 tree AS (SELECT u, v, s FROM o WHERE NOT EXISTS (SELECT 1 FROM re WHERE re.k = o.k AND re.p = o.v)),
 tad AS (SELECT u AS p, v AS q, s FROM tree UNION ALL SELECT v, u, s FROM tree),
 pa AS (SELECT point_id AS a, point_id AS b, 1 AS s FROM un UNION SELECT pa.a, tad.q, pa.s * tad.s FROM pa JOIN tad ON tad.p = pa.b),
 seed AS (SELECT a, arg_max(b, (z, -b)) AS top FROM pa JOIN un ON point_id = b GROUP BY 1),
 sg AS (SELECT seed.a AS point_id, top, pa.s * CASE WHEN t.nz < 0 THEN -1 ELSE 1 END AS s FROM seed JOIN pa ON pa.a = seed.a AND pa.b = top JOIN un t ON t.point_id = top)"""


def _oriented(spark, root):
    return orient.oriented(scan_points(spark, root), SCENE, 6)


@query("nrm_oriented", f"WITH {FOREST_SQL} SELECT p.scene_id, p.point_id, {q6('p.nx * s')} AS nx, {q6('p.ny * s')} AS ny, {q6('p.nz * s')} AS nz FROM pts p JOIN sg USING (point_id)", "pts")
def nrm_oriented(spark, root):
    out, _ = _oriented(spark, root)
    return out.select("scene_id", "point_id", *[r6(f"n{a}").alias(f"n{a}") for a in "xyz"])


@query("nrm_forest", f"WITH {FOREST_SQL} SELECT u, v FROM tree", "pts")
def nrm_forest(spark, root):
    return _oriented(spark, root)[1].select("u", "v")


@query("prj_center_shift", f"WITH b AS (SELECT scene_id, (min(x)+max(x))/2 AS cx, (min(y)+max(y))/2 AS cy, min(z) AS cz FROM pts GROUP BY 1) SELECT scene_id, point_id, {q6('x-cx')} AS x, {q6('y-cy')} AS y, {q6('z-cz')} AS z FROM pts JOIN b USING (scene_id)", "pts")
def prj_center_shift(spark, root):
    out = testtime.center_shift(scan_points(spark, root), SCENE)
    return out.select("scene_id", "point_id", *[r6(a).alias(a) for a in "xyz"])


# the lattice cloud has many points a voxel; rows get an id that is unique in the table
_LAT = """la AS (SELECT l_suppkey % 5 AS sample, l_orderkey * 8 + l_linenumber AS point_id, l_quantity AS x, round(l_discount * 100) AS y, round(l_tax * 100) AS z FROM lineitem)"""


def _lattice(spark, root):
    rows = lattice_points(spark, root)
    ident = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("point_id")
    return table(spark, root, "lineitem").select(
        (F.col("l_suppkey") % 5).alias("sample"), ident, F.col("l_quantity").alias("x"), F.round(F.col("l_discount") * 100).alias("y"), F.round(F.col("l_tax") * 100).alias("z")
    ).select("sample", "point_id", *[F.col(a).cast(rows.schema[a].dataType).alias(a) for a in "xyz"])


_COVER = f"""{_LAT}, vx AS (SELECT *, CAST(floor(x / 5) AS BIGINT) AS vx, CAST(floor(y / 5) AS BIGINT) AS vy, CAST(floor(z / 5) AS BIGINT) AS vz FROM la),
 rk AS (SELECT *, row_number() OVER (PARTITION BY sample, vx, vy, vz ORDER BY point_id) - 1 AS r, count(*) OVER (PARTITION BY sample, vx, vy, vz) AS n FROM vx),
 cv AS (SELECT *, max(n) OVER (PARTITION BY sample) AS fragments FROM rk)"""


@query("tt_cover", f"WITH {_COVER} SELECT sample, point_id, r, n, fragments, CAST((fragments - 1 - r) // n + 1 AS BIGINT) AS repeats FROM cv")
def tt_cover(spark, root):
    """Each point with the fragments that hold it, on the crowded lattice cloud."""
    cover = testtime.cyclic_cover(_lattice(spark, root), ["sample"], 5.0)
    return cover.select("sample", "point_id", "r", "n", "fragments", testtime.repeats().alias("repeats"))


@query("tt_fragment", f"WITH {_COVER} SELECT i AS fragment, sample, count(*) AS points, CAST(sum(point_id) AS BIGINT) AS ids FROM cv, (SELECT unnest([0, 1, 7]) AS i) WHERE fragments > i AND r = i % n GROUP BY 1, 2")
def tt_fragment(spark, root):
    """Three fragments of every sample: one point a voxel each."""
    cover = testtime.cyclic_cover(_lattice(spark, root), ["sample"], 5.0).withColumn("fragment", F.explode(F.array(*[F.lit(i) for i in (0, 1, 7)])))
    return testtime.fragment(cover, F.col("fragment")).groupBy("fragment", "sample").agg(F.count("*").alias("points"), F.sum("point_id").alias("ids"))


_TURN = "(VALUES (0, 1.0::DOUBLE, 0.0::DOUBLE), (1, 0.0::DOUBLE, 1.0::DOUBLE), (2, -1.0::DOUBLE, 0.0::DOUBLE), (3, 0.0::DOUBLE, -1.0::DOUBLE)) t(rotation, c, s)"


@query(
    "tt_vote",
    f"""WITH ro AS (SELECT scene_id, point_id, rotation, c * x - s * y AS x, s * x + c * y AS y, z, [v + rotation * (i - 4) / 8 FOR v, i IN logits] AS l FROM pred, {_TURN}),
        vo AS (SELECT *, floor(x / 0.2::DOUBLE) AS vx, floor(y / 0.2::DOUBLE) AS vy, floor(z / 0.2::DOUBLE) AS vz FROM ro),
        rk AS (SELECT *, row_number() OVER (PARTITION BY scene_id, rotation, vx, vy, vz ORDER BY point_id) - 1 AS r, count(*) OVER (PARTITION BY scene_id, rotation, vx, vy, vz) AS n FROM vo),
        cv AS (SELECT *, (max(n) OVER (PARTITION BY scene_id, rotation) - 1 - r) // n + 1 AS k FROM rk),
        p AS (SELECT scene_id, point_id, k, unnest(l) AS v, unnest(range(8)) AS c, list_max(l) AS m, list_sum([exp(w - list_max(l)) FOR w IN l]) AS s FROM cv),
        q AS (SELECT scene_id, point_id, c, round(sum(k * exp(v - m) / s), 9) AS prob, sum(k) AS votes FROM p GROUP BY 1, 2, 3)
        SELECT scene_id, point_id, CAST(arg_max(c, (prob, -c)) AS INTEGER) AS pred, {q6('max(prob)')} AS prob, CAST(max(votes) AS DOUBLE) AS votes FROM q GROUP BY 1, 2""",
    "pred",
)
def tt_vote(spark, root):
    """Four turns, each cut into fragments of its own voxels; a point's softmax is summed over all fragments that hold it."""
    pts = predictions(spark, root).select("scene_id", "point_id", "x", "y", "z", "logits")
    turned = testtime.rotated(pts)
    seen = turned.withColumn("logits", F.transform("logits", lambda v, i: v + F.col("rotation") * (i + 1 - 4) / 8))
    cover = testtime.cyclic_cover(seen, ["scene_id", "rotation"], 0.2)
    out = testtime.vote(cover, ["scene_id", "point_id"], 8, weight=testtime.repeats())
    return out.select("scene_id", "point_id", "pred", r6("prob").alias("prob"), "votes")


_CROP = "ce AS (SELECT scene_id, arg_min([x, y, z], (md5('crop|' || point_id), point_id)) AS c FROM pts GROUP BY 1), di AS (SELECT scene_id, point_id, (x-c[1])*(x-c[1]) + (y-c[2])*(y-c[2]) + (z-c[3])*(z-c[3]) AS d FROM pts JOIN ce USING (scene_id)), rk AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY d, point_id) AS r, count(*) OVER (PARTITION BY scene_id) AS n FROM di)"


@query("crop_sphere", f"WITH {_CROP} SELECT scene_id, point_id FROM rk WHERE r <= 40", "pts")
def crop_sphere(spark, root):
    return testtime.sphere_crop(scan_points(spark, root), SCENE, point_max=40).select("scene_id", "point_id")


@query("crop_sphere_rate", f"WITH {_CROP} SELECT scene_id, point_id FROM rk WHERE r <= floor(n * 0.6::DOUBLE)", "pts")
def crop_sphere_rate(spark, root):
    return testtime.sphere_crop(scan_points(spark, root), SCENE, sample_rate=0.6).select("scene_id", "point_id")


_TIES = f"""{_LAT}, ce AS (SELECT sample, arg_min([x, y, z], (md5('crop|' || point_id), point_id)) AS c FROM la GROUP BY 1),
 di AS (SELECT sample, point_id, (x-c[1])*(x-c[1]) + (y-c[2])*(y-c[2]) + (z-c[3])*(z-c[3]) AS d FROM la JOIN ce USING (sample)), rk AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY d, point_id) AS r FROM di)"""


@query("crop_sphere_ties", f"WITH {_TIES} SELECT sample, point_id FROM rk WHERE r <= 1000")
def crop_sphere_ties(spark, root):
    """The lattice cloud: many points at the same distance, so the border is a border of ids."""
    return testtime.sphere_crop(_lattice(spark, root), ["sample"], point_max=1000).select("sample", "point_id")
