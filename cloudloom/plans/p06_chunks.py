"""Spatial chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.operators import chunking
from cloudloom.operators.graph import components
from cloudloom.operators.voxel import bounding_box
from cloudloom.plans.p03_joins import TILES_SQL
from cloudloom.plans.registry import query, r6
from cloudloom.sources.tables import lattice_points, scan_points


def _tiles(spark, root, z_band=None):
    return chunking.tile_grid(bounding_box(lattice_points(spark, root), ["sample"]), 20.0, 5.0, ["sample"], z_band)


@query("chk_edges", f"WITH {TILES_SQL} SELECT DISTINCT sample, x_tile, x_lo, x_hi FROM tile", "lat")
def chk_edges(spark, root):
    return _tiles(spark, root).select("sample", "x_tile", "x_lo", "x_hi").distinct()


@query(
    "chk_grid",
    f"""WITH {TILES_SQL}, zb AS (SELECT sample, min(z) AS z0, max(z) AS z1 FROM lat GROUP BY 1), zn AS (SELECT *, CASE WHEN z1-z0 <= 3 THEN 1 ELSE CAST(ceil((z1-z0-3)/3) AS INTEGER) + 1 END AS nz FROM zb),
        zt AS (SELECT *, unnest(range(nz)) AS iz FROM zn)
        SELECT t.sample, CAST(chunk_idx * nz + iz AS INTEGER) AS chunk_idx, x_tile, y_tile, CAST(iz AS INTEGER) AS z_tile, x_lo, x_hi, y_lo, y_hi,
        CASE WHEN nz = 1 THEN z0 WHEN iz = nz-1 THEN least(z0 + iz*3, z1-3) ELSE z0 + iz*3 END AS z_lo, CASE WHEN iz = nz-1 THEN z1 ELSE z0 + iz*3 + 3 END AS z_hi FROM tile t JOIN zt USING (sample)""",
    "lat",
)
def chk_grid(spark, root):
    return _tiles(spark, root, 3.0)


OCC_SQL = """mn AS (SELECT scene_id, min(x) AS mx, min(y) AS my FROM pts GROUP BY 1),
 cl AS (SELECT p.scene_id, point_id, x, y, segment, CAST(trunc((x-mx)/0.08) AS INTEGER) AS gx, CAST(trunc((y-my)/0.08) AS INTEGER) AS gy FROM pts p JOIN mn USING (scene_id)),
 occ AS (SELECT DISTINCT scene_id, gx, gy FROM cl WHERE segment IN (0, 1, 2, 3))"""
FACADE = (0, 1, 2, 3)


def _occ(spark, root):
    return chunking.occupancy(scan_points(spark, root), 0.08, ["scene_id"], FACADE)


@query("chk_occupancy", f"WITH {OCC_SQL} SELECT * FROM occ", "pts")
def chk_occupancy(spark, root):
    return _occ(spark, root)


COMP_SQL = f"""RECURSIVE {OCC_SQL}, nd AS (SELECT scene_id, gx, gy, gx::BIGINT * 100000 + gy AS node FROM occ),
 ed AS (SELECT a.scene_id, a.node AS s, b.node AS t FROM nd a JOIN nd b ON a.scene_id = b.scene_id AND abs(a.gx-b.gx) + abs(a.gy-b.gy) = 1),
 rc AS (SELECT scene_id, node, node AS root FROM nd UNION SELECT rc.scene_id, ed.t, rc.root FROM rc JOIN ed ON rc.scene_id = ed.scene_id AND rc.node = ed.s),
 co AS (SELECT scene_id, node, min(root) AS root FROM rc GROUP BY 1, 2),
 lb AS (SELECT scene_id, node // 100000 AS gx, node % 100000 AS gy, CAST(dense_rank() OVER (PARTITION BY scene_id ORDER BY root) AS INTEGER) AS label FROM co)"""


@query("chk_components", f"WITH {COMP_SQL} SELECT scene_id, CAST(gx AS INTEGER) AS gx, CAST(gy AS INTEGER) AS gy, label FROM lb", "pts")
def chk_components(spark, root):
    return chunking.facade_components(_occ(spark, root), ["scene_id"])


@query(
    "chk_assign",
    f"""WITH {COMP_SQL}, all_c AS (SELECT DISTINCT scene_id, gx, gy FROM cl),
       nr AS (SELECT c.scene_id, c.gx, c.gy, l.label FROM all_c c JOIN lb l ON c.scene_id = l.scene_id
         QUALIFY row_number() OVER (PARTITION BY c.scene_id, c.gx, c.gy ORDER BY (c.gx-l.gx)*(c.gx-l.gx)+(c.gy-l.gy)*(c.gy-l.gy), l.gx, l.gy) = 1)
       SELECT cl.scene_id, label, count(*) AS n FROM cl JOIN nr USING (scene_id, gx, gy) GROUP BY 1, 2""",
    "pts",
)
def chk_assign(spark, root):
    from cloudloom.operators.chunking import component_of_points

    owned = component_of_points(scan_points(spark, root), ["scene_id"], 0.08, FACADE)
    return owned.groupBy("scene_id", "label").agg(F.count("*").alias("n"))


@query("gr_components", f"WITH {COMP_SQL} SELECT scene_id, root AS component, count(*) AS n FROM co GROUP BY 1, 2", "pts")
def gr_components(spark, root):
    node = F.col("gx").cast("bigint") * 100000 + F.col("gy")
    cells = _occ(spark, root).withColumn("node", node)
    right = cells.select("scene_id", (F.col("gx") - 1).alias("gx"), "gy", F.col("node").alias("dst"))
    up = cells.select("scene_id", "gx", (F.col("gy") - 1).alias("gy"), F.col("node").alias("dst"))
    edges = cells.join(right.unionByName(up), ["scene_id", "gx", "gy"]).select("scene_id", F.col("node").alias("src"), "dst")
    comp = components(cells.select("scene_id", "node"), edges, ["scene_id"])
    return comp.groupBy("scene_id", "component").agg(F.count("*").alias("n"))


@query("chk_bisect")
def chk_bisect(spark, root):
    out = chunking.bisect(scan_points(spark, root), ["scene_id"], budget=40, min_points=5)
    return out.groupBy("scene_id", "path").agg(F.count("*").alias("n"), r6(F.min("x")).alias("x_min"), r6(F.max("x")).alias("x_max"))


@query(
    "chk_bisect_level",
    """WITH s AS (SELECT scene_id, max(x)-min(x) >= max(y)-min(y) AS on_x, median(x) AS mx, median(y) AS my FROM pts GROUP BY 1)
       SELECT p.scene_id, CASE WHEN CASE WHEN on_x THEN x <= mx ELSE y <= my END THEN '0' ELSE '1' END AS path, count(*) AS n FROM pts p JOIN s USING (scene_id) GROUP BY 1, 2""",
    "pts",
)
def chk_bisect_level(spark, root):
    """One level: the budget lets exactly the first cut happen, whatever the table size."""
    pts = scan_points(spark, root)
    largest = pts.groupBy("scene_id").count().agg(F.max("count"), F.min("count")).first()
    out = chunking.bisect(pts, ["scene_id"], budget=(largest[1] + 1) // 2 + 1 if largest[1] > 2 else 1, min_points=1)
    return out.groupBy("scene_id", F.substring("path", 1, 1).alias("path")).agg(F.count("*").alias("n"))


@query(
    "chk_padded",
    """WITH b AS (SELECT scene_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM pts GROUP BY 1),
       n AS (SELECT *, greatest(ceil((x1-x0)/0.3::DOUBLE)-1, 0) AS tx, greatest(ceil((y1-y0)/0.3::DOUBLE)-1, 0) AS ty, greatest(ceil((z1-z0)/0.3::DOUBLE)-1, 0) AS tz FROM b),
       c AS (SELECT n.*, ix.i AS ix, iy.i AS iy, iz.i AS iz FROM n, range(50) ix(i), range(50) iy(i), range(50) iz(i) WHERE ix.i <= tx AND iy.i <= ty AND iz.i <= tz)
       SELECT p.scene_id, CAST(ix AS BIGINT) AS cube_x, CAST(iy AS BIGINT) AS cube_y, CAST(iz AS BIGINT) AS cube_z, count(*) AS n,
       CAST(count_if(least(floor((x-x0)/0.3::DOUBLE), tx) = ix AND least(floor((y-y0)/0.3::DOUBLE), ty) = iy AND least(floor((z-z0)/0.3::DOUBLE), tz) = iz) AS BIGINT) AS core
       FROM pts p JOIN c USING (scene_id)
       WHERE ix BETWEEN greatest(floor((x-x0-0.05)/0.3::DOUBLE), 0) AND floor((x-x0+0.05)/0.3::DOUBLE) AND iy BETWEEN greatest(floor((y-y0-0.05)/0.3::DOUBLE), 0) AND floor((y-y0+0.05)/0.3::DOUBLE)
         AND iz BETWEEN greatest(floor((z-z0-0.05)/0.3::DOUBLE), 0) AND floor((z-z0+0.05)/0.3::DOUBLE) GROUP BY 1, 2, 3, 4""",
    "pts",
)
def chk_padded(spark, root):
    out = chunking.padded_cubes(scan_points(spark, root), 0.3, 0.05, ["scene_id"])
    return out.groupBy("scene_id", "cube_x", "cube_y", "cube_z").agg(F.count("*").alias("n"), F.count_if("core").alias("core"))


@query("chk_facade")
def chk_facade(spark, root):
    out = chunking.facade_chunks(scan_points(spark, root), ["scene_id"], cell=0.08, budget=40, min_points=5, facade=FACADE)
    return out.groupBy("scene_id", "chunk_idx").agg(F.count("*").alias("n"), r6(F.avg("x")).alias("cx"))
