"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.functions import geometry as g
from cloudloom.functions import grid, weights
from cloudloom.plans.registry import q6, query, r6
from cloudloom.sources.tables import lattice_points, predictions, scan_points, table

KEY_SQL = """((CAST(floor(x * (1/{g}::DOUBLE)) AS BIGINT) + 1048576) << 42) |
 ((CAST(floor(y * (1/{g}::DOUBLE)) AS BIGINT) + 1048576) << 21) | (CAST(floor(z * (1/{g}::DOUBLE)) AS BIGINT) + 1048576)"""
K004 = KEY_SQL.format(g="0.04")


@query("prj_voxel_key", f"SELECT point_id, {K004} AS key FROM pts", "pts")
def prj_voxel_key(spark, root):
    return scan_points(spark, root).select("point_id", grid.voxel_key(F.col("x"), F.col("y"), F.col("z"), 0.04).alias("key"))


@query("prj_hash_bin", f"SELECT ({K004}) % 16 AS bin, count(*) AS n FROM pts GROUP BY 1", "pts")
def prj_hash_bin(spark, root):
    key = grid.voxel_key(F.col("x"), F.col("y"), F.col("z"), 0.04)
    return scan_points(spark, root).groupBy(grid.hash_bin(key).alias("bin")).agg(F.count("*").alias("n"))


_GRID = """SELECT scene_id, point_id,
 CAST(floor(x / 0.04::DOUBLE) - min(floor(x / 0.04::DOUBLE)) OVER (PARTITION BY scene_id) AS BIGINT) AS gx,
 CAST(floor(y / 0.04::DOUBLE) - min(floor(y / 0.04::DOUBLE)) OVER (PARTITION BY scene_id) AS BIGINT) AS gy,
 CAST(floor(z / 0.04::DOUBLE) - min(floor(z / 0.04::DOUBLE)) OVER (PARTITION BY scene_id) AS BIGINT) AS gz FROM pts"""


@query("prj_grid_coord", _GRID, "pts")
def prj_grid_coord(spark, root):
    return grid.relative_grid(scan_points(spark, root), 0.04, ["scene_id"]).select("scene_id", "point_id", "gx", "gy", "gz")


def _fnv_sql(offset: int, xor_first: bool) -> str:
    """Two hash chains over three values in 128-bit integer arithmetic."""
    mod, prime = "18446744073709551616::HUGEINT", "1099511628211::HUGEINT"
    h = f"{offset}::HUGEINT"
    steps = []
    for v in ("gx", "gy", "gz"):
        if xor_first:
            h = f"((xor({h}, {v}::HUGEINT)) * {prime}) % {mod}"
        else:
            h = f"xor(({h} * {prime}) % {mod}, {v}::HUGEINT)"
        steps.append(h)
    return steps[-1]


@query(
    "prj_fnv",
    f"""WITH gp AS ({_GRID}), h AS (SELECT point_id, {_fnv_sql(0x811C9DC5, True)} AS a,
        {_fnv_sql(0xCBF29CE484222325, False)} AS b FROM gp)
        SELECT point_id, CAST(a // 4294967296 AS BIGINT) AS val_hi, CAST(a % 4294967296 AS BIGINT) AS val_lo,
        CAST(b // 4294967296 AS BIGINT) AS train_hi, CAST(b % 4294967296 AS BIGINT) AS train_lo FROM h""",
    "pts",
)
def prj_fnv(spark, root):
    gp = prj_grid_coord(spark, root)
    axes = [F.col(c) for c in ("gx", "gy", "gz")]
    val = grid.fnv(axes, offset=0x811C9DC5, xor_first=True)
    train = grid.fnv(axes, offset=0xCBF29CE484222325, xor_first=False)
    return gp.select("point_id", val.alias("v"), train.alias("t")).select(
        "point_id", F.col("v.hi").alias("val_hi"), F.col("v.lo").alias("val_lo"),
        F.col("t.hi").alias("train_hi"), F.col("t.lo").alias("train_lo"),
    )


@query("prj_class_clip", "SELECT CAST(greatest(0, least(16, l_linenumber * 4 - 6)) AS INTEGER) AS c, count(*) AS n FROM lineitem GROUP BY 1")
def prj_class_clip(spark, root):
    c = grid.class_clip(F.col("l_linenumber") * 4 - 6)
    return table(spark, root, "lineitem").groupBy(c.alias("c")).agg(F.count("*").alias("n"))


@query("prj_remap", "SELECT c - 1 AS segment, count(*) AS n FROM lat WHERE c <> 0 GROUP BY 1", "lat")
def prj_remap(spark, root):
    kept = lattice_points(spark, root).where("c <> 0")
    return kept.groupBy(grid.remap_after_void(F.col("c")).alias("segment")).agg(F.count("*").alias("n"))


# The 16 -> 5 class table is configuration; only 13 -> 4 is known, the rest is a stand-in.
BUCKETS = {i: (4 if i == 13 else i % 5) for i in range(16)}


@query("prj_lofg2", "SELECT CASE WHEN c - 1 = 13 THEN 4 ELSE (c - 1) % 5 END AS bucket, count(*) AS n FROM lat WHERE c <> 0 GROUP BY 1", "lat")
def prj_lofg2(spark, root):
    lut = F.create_map(*[F.lit(v) for kv in BUCKETS.items() for v in kv])
    return lattice_points(spark, root).where("c <> 0").groupBy(F.element_at(lut, F.col("c") - 1).alias("bucket")).agg(F.count("*").alias("n"))


@query("flt_bbox", "SELECT point_id FROM pts WHERE x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.1 AND 0.1 AND z BETWEEN -0.2 AND 0.2", "pts")
def flt_bbox(spark, root):
    return scan_points(spark, root).where(
        F.col("x").between(-0.1, 0.1) & F.col("y").between(-0.1, 0.1) & F.col("z").between(-0.2, 0.2)
    ).select("point_id")


@query(
    "flt_bbox_halfopen",
    """SELECT point_id, x >= -0.1 AND x < 0.1 AND y >= -0.1 AND y < 0.1 AND z >= -0.1 AND z < 0.1 AS core FROM pts
    WHERE x >= -0.2 AND x < 0.2 AND y >= -0.2 AND y < 0.2 AND z >= -0.2 AND z < 0.2""",
    "pts",
)
def flt_bbox_halfopen(spark, root):
    def inside(r):
        cond = F.lit(True)
        for a in "xyz":
            cond = cond & (F.col(a) >= -r) & (F.col(a) < r)
        return cond

    return scan_points(spark, root).where(inside(0.2)).select("point_id", inside(0.1).alias("core"))


@query("flt_ignore", "SELECT scene_id, count(*) AS n FROM pred WHERE truth <> -1 GROUP BY 1", "pred")
def flt_ignore(spark, root):
    return predictions(spark, root).where("truth <> -1").groupBy("scene_id").agg(F.count("*").alias("n"))


@query("flt_narrowband", "SELECT point_id FROM pred WHERE valid > 0.5 AND support > 0.1", "pred")
def flt_narrowband(spark, root):
    return predictions(spark, root).where("valid > 0.5 AND support > 0.1").select("point_id")


@query(
    "fn_normalize",
    f"""WITH v AS (SELECT point_id, CASE WHEN point_id % 7 = 0 THEN 0.0::DOUBLE ELSE x END AS x,
        CASE WHEN point_id % 7 = 0 THEN 1e-9::DOUBLE ELSE y END AS y, CASE WHEN point_id % 7 = 0 THEN 0.0::DOUBLE ELSE z END AS z FROM pts),
        n AS (SELECT *, sqrt(x*x + y*y + z*z) AS n FROM v)
        SELECT point_id, {q6("CASE WHEN n < 1e-8 THEN 0 ELSE y / n END")} AS zeroed, {q6("y / greatest(n, 1e-8)")} AS floored,
        {q6("y / CASE WHEN n < 1e-8 THEN 1 ELSE n END")} AS kept FROM n""",
    "pts",
)
def fn_normalize(spark, root):
    tiny = F.col("point_id") % 7 == 0
    v = (F.when(tiny, 0.0).otherwise(F.col("x")), F.when(tiny, 1e-9).otherwise(F.col("y")), F.when(tiny, 0.0).otherwise(F.col("z")))
    return scan_points(spark, root).select(
        "point_id", r6(g.unit_or_zero(v)[1]).alias("zeroed"), r6(g.unit_floor(v)[1]).alias("floored"), r6(g.unit_or_same(v)[1]).alias("kept")
    )


# one segment per point, from its position to its normal columns, probed at its logits
_SEG = """seg AS (SELECT vec_id AS point_id, CAST(embedding[1] AS DOUBLE) AS ax, CAST(embedding[2] AS DOUBLE) AS ay, CAST(embedding[3] AS DOUBLE) AS az,
  CASE WHEN vec_id % 11 = 0 THEN CAST(embedding[1] AS DOUBLE) ELSE CAST(embedding[4] AS DOUBLE) END AS bx,
  CASE WHEN vec_id % 11 = 0 THEN CAST(embedding[2] AS DOUBLE) ELSE CAST(embedding[5] AS DOUBLE) END AS by_,
  CASE WHEN vec_id % 11 = 0 THEN CAST(embedding[3] AS DOUBLE) ELSE CAST(embedding[6] AS DOUBLE) END AS bz,
  CAST(embedding[7] AS DOUBLE) AS px, CAST(embedding[8] AS DOUBLE) AS py, CAST(embedding[9] AS DOUBLE) AS pz FROM embeddings),
 l2 AS (SELECT *, (bx-ax)*(bx-ax) + (by_-ay)*(by_-ay) + (bz-az)*(bz-az) AS l2 FROM seg),
 tt AS (SELECT *, CASE WHEN l2 < 1e-8 THEN 0.0 ELSE greatest(0.0, least(1.0, ((px-ax)*(bx-ax) + (py-ay)*(by_-ay) + (pz-az)*(bz-az)) / l2)) END AS t FROM l2)"""


def _segments(spark, root):
    dim = lambda i: F.col("embedding")[i].cast("double")
    same = F.col("vec_id") % 11 == 0
    return table(spark, root, "embeddings").select(
        F.col("vec_id").alias("point_id"),
        *[dim(i).alias(f"a{n}") for i, n in enumerate("xyz")],
        *[F.when(same, dim(i)).otherwise(dim(3 + i)).alias(f"b{n}") for i, n in enumerate("xyz")],
        *[dim(6 + i).alias(f"p{n}") for i, n in enumerate("xyz")],
    )


@query(
    "fn_seg_project",
    f"WITH {_SEG} SELECT point_id, {q6('t')} AS t, {q6('ax + t*(bx-ax)')} AS qx, {q6('ay + t*(by_-ay)')} AS qy, {q6('az + t*(bz-az)')} AS qz FROM tt",
)
def fn_seg_project(spark, root):
    t, q = g.on_segment(g.vec("p"), g.vec("a"), g.vec("b"))
    return _segments(spark, root).select("point_id", r6(t).alias("t"), *[r6(c).alias(f"q{n}") for n, c in zip("xyz", q)])


@query(
    "fn_dist_line",
    f"""WITH {_SEG}, s AS (SELECT *, sqrt((px-ax-t*(bx-ax))*(px-ax-t*(bx-ax)) + (py-ay-t*(by_-ay))*(py-ay-t*(by_-ay)) + (pz-az-t*(bz-az))*(pz-az-t*(bz-az))) AS seg_dist,
        ((px-ax)*(bx-ax) + (py-ay)*(by_-ay) + (pz-az)*(bz-az)) / nullif(l2, 0) AS u FROM tt)
        SELECT point_id, {q6("seg_dist")} AS segment_distance,
        CASE WHEN sqrt(l2) < 1e-8 THEN CAST('Infinity' AS DOUBLE) ELSE {q6("sqrt(greatest(0, (px-ax)*(px-ax)+(py-ay)*(py-ay)+(pz-az)*(pz-az) - u*u*l2))")} END AS line_distance FROM s""",
)
def fn_dist_line(spark, root):
    a, b, p = g.vec("a"), g.vec("b"), g.vec("p")
    return _segments(spark, root).select(
        "point_id", r6(g.segment_distance(p, a, b)).alias("segment_distance"), r6(g.line_distance(p, a, g.sub(b, a))).alias("line_distance")
    )


@query(
    "fn_gauss",
    f"SELECT point_id, CASE WHEN valid > 0.5 THEN {q6('exp(-(dist_pred*dist_pred)/(2*0.02*0.02))')} ELSE 0.0::DOUBLE END AS support FROM pred",
    "pred",
)
def fn_gauss(spark, root):
    return predictions(spark, root).select("point_id", r6(weights.gaussian_support(F.col("dist_pred"), F.col("valid") > 0.5, 0.02)).alias("support"))


@query(
    "fn_s_weight",
    f"""SELECT point_id, {q6("CASE WHEN dist_pred <= 0.06 THEN 1 WHEN dist_pred <= 0.12 THEN exp(-3.0::DOUBLE * (dist_pred - 0.06) / 0.06) ELSE 0 END")} AS w FROM pred""",
    "pred",
)
def fn_s_weight(spark, root):
    return predictions(spark, root).select("point_id", r6(weights.decay_weight(F.col("dist_pred"))).alias("w"))


@query(
    "fn_confidence",
    f"""SELECT point_id, {q6("greatest(0, least(1, 0.45::DOUBLE * support + 0.30::DOUBLE * valid + 0.15::DOUBLE * (dist_pred / (dist_pred + 1)) + 0.10::DOUBLE * abs(x)))")} AS confidence FROM pred""",
    "pred",
)
def fn_confidence(spark, root):
    c = weights.center_confidence(F.col("support"), F.col("valid"), F.col("dist_pred"), F.abs("x"))
    return predictions(spark, root).select("point_id", r6(c).alias("confidence"))


@query(
    "fn_axis_snap",
    f"""WITH d AS (SELECT point_id, x * 4 AS x, y, z FROM pts), n AS (SELECT *, sqrt(x*x+y*y+z*z) AS n FROM d),
        u AS (SELECT point_id, x/n AS x, y/n AS y, z/n AS z FROM n), b AS (SELECT *, greatest(abs(x), abs(y), abs(z)) AS best, cos(radians(15)) AS lim FROM u),
        a AS (SELECT *, CASE WHEN abs(x) = best THEN 0 WHEN abs(y) = best THEN 1 ELSE 2 END AS ax,
          0.3::DOUBLE * greatest(0, least(1, (best - lim) / (1 - lim + 1e-8))) AS al FROM b),
        m AS (SELECT *, (1-al)*x + CASE WHEN ax = 0 THEN al*sign(x) ELSE 0 END AS mx, (1-al)*y + CASE WHEN ax = 1 THEN al*sign(y) ELSE 0 END AS my,
          (1-al)*z + CASE WHEN ax = 2 THEN al*sign(z) ELSE 0 END AS mz FROM a), k AS (SELECT *, sqrt(mx*mx+my*my+mz*mz) AS mn FROM m)
        SELECT point_id, {q6("CASE WHEN best < lim THEN x ELSE mx/mn END")} AS sx, {q6("CASE WHEN best < lim THEN y ELSE my/mn END")} AS sy,
        {q6("CASE WHEN best < lim THEN z ELSE mz/mn END")} AS sz, {q6("best")} AS score FROM k""",
    "pts",
)
def fn_axis_snap(spark, root):
    out = g.axis_snap(scan_points(spark, root), (F.col("x") * 4, F.col("y"), F.col("z")), ("sx", "sy", "sz"), "score")
    return out.select("point_id", *[r6(c).alias(c) for c in ("sx", "sy", "sz", "score")])


@query(
    "fn_side",
    """SELECT point_id, CASE WHEN abs(vx) >= abs(vy) AND abs(vx) >= abs(vz) THEN CAST(vx > 0 AS INTEGER)
       WHEN abs(vy) >= abs(vz) THEN CAST(vy > 0 AS INTEGER) ELSE CAST(vz > 0 AS INTEGER) END AS side FROM pred""",
    "pred",
)
def fn_side(spark, root):
    return predictions(spark, root).select("point_id", g.side_of(g.vec("v")).alias("side"))


@query(
    "fn_sigmoid",
    f"""SELECT point_id, {q6("1 / (1 + exp(-support_logit))")} AS prob, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS best,
        {q6("exp(list_max(logits)) / list_sum([exp(v) FOR v IN logits])")} AS best_prob FROM pred""",
    "pred",
)
def fn_sigmoid(spark, root):
    return predictions(spark, root).select(
        "point_id", r6(weights.sigmoid(F.col("support_logit"))).alias("prob"), weights.argmax(F.col("logits")).alias("best"),
        r6(F.array_max(weights.softmax(F.col("logits")))).alias("best_prob"),
    )


@query(
    "fn_color_hash",
    """WITH s AS (SELECT point_id, segment, xor(xor(CAST(segment AS BIGINT) * 73856093, CAST((segment + 1) % 10 AS BIGINT) * 19349663), 2654435761) AS ps,
        (point_id * 1103515245 + 12345) & 2147483647 AS cs FROM pts)
        SELECT point_id, CAST(64 + (ps & 127) AS INTEGER) AS pr, CAST(64 + ((ps >> 8) & 127) AS INTEGER) AS pg, CAST(64 + ((ps >> 16) & 127) AS INTEGER) AS pb,
        CASE WHEN point_id % 5 = 0 THEN 140 ELSE CAST(64 + (cs & 127) AS INTEGER) END AS cr, CASE WHEN point_id % 5 = 0 THEN 140 ELSE CAST(64 + ((cs >> 8) & 127) AS INTEGER) END AS cg,
        CASE WHEN point_id % 5 = 0 THEN 140 ELSE CAST(64 + ((cs >> 16) & 127) AS INTEGER) END AS cb FROM s""",
    "pts",
)
def fn_color_hash(spark, root):
    pair = weights.pair_colour(F.col("segment"), (F.col("segment") + 1) % 10)
    cluster = weights.cluster_colour(F.when(F.col("point_id") % 5 == 0, F.lit(-1)).otherwise(F.col("point_id")))
    return scan_points(spark, root).select(
        "point_id", *[c.alias(f"p{n}") for n, c in zip("rgb", pair)], *[c.alias(f"c{n}") for n, c in zip("rgb", cluster)]
    )


_PALETTE_SQL = "palette AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {r}, {gg}, {b})" for i, (r, gg, b) in enumerate(weights.PALETTE)) + ") t(i, r, g, b))"


@query(
    "fn_color_lut",
    f"""WITH {_PALETTE_SQL}, c AS (SELECT l_linenumber * 9 - 12 AS cls, count(*) AS n FROM lineitem GROUP BY 1)
        SELECT CAST(cls AS INTEGER) AS cls, n, CASE WHEN cls BETWEEN 0 AND 39 THEN r ELSE 0 END AS r, CASE WHEN cls BETWEEN 0 AND 39 THEN g ELSE 0 END AS g,
        CASE WHEN cls BETWEEN 0 AND 39 THEN b ELSE 0 END AS b FROM c LEFT JOIN palette ON i = cls % 32""",
)
def fn_color_lut(spark, root):
    classes = table(spark, root, "lineitem").groupBy((F.col("l_linenumber") * 9 - 12).alias("cls")).agg(F.count("*").alias("n"))
    return classes.select("cls", "n", *[c.alias(n) for n, c in zip("rgb", weights.class_colour(F.col("cls"), 40))])


@query("fn_chunk_name", "SELECT o_orderkey, printf('%s__c%04d', 'S' || o_custkey, CAST(o_orderkey % 10000 AS INTEGER)) AS name FROM orders")
def fn_chunk_name(spark, root):
    base = F.concat(F.lit("S"), F.col("o_custkey"))
    return table(spark, root, "orders").select("o_orderkey", grid.chunk_name(base, (F.col("o_orderkey") % 10000).cast("int")).alias("name"))


@query(
    "fn_edge_pack",
    f"""SELECT point_id, {q6("CAST(vx AS FLOAT) + CAST(vy AS FLOAT) + CAST(vz AS FLOAT)", 5)} AS vec_sum, CAST(CAST(support AS FLOAT) AS DOUBLE) AS e3, CAST(CAST(valid AS FLOAT) AS DOUBLE) AS e4, 5 AS width FROM pred""",
    "pred",
)
def fn_edge_pack(spark, root):
    packed = predictions(spark, root).select("point_id", weights.pack_edge(g.vec("v"), F.col("support"), F.col("valid")).alias("e"))
    return packed.select(
        "point_id", r6(F.col("e")[0] + F.col("e")[1] + F.col("e")[2], 5).alias("vec_sum"), F.col("e")[3].cast("double").alias("e3"),
        F.col("e")[4].cast("double").alias("e4"), F.size("e").alias("width"),
    )


@query(
    "fn_tile_adaptive",
    """WITH d AS (SELECT l_suppkey, count(*) / 2500.0::DOUBLE AS density FROM lineitem GROUP BY 1), r AS (SELECT *, sqrt(40.0::DOUBLE / density) AS raw FROM d)
       SELECT l_suppkey, (SELECT arg_min(t, (abs(t - raw), t)) FROM (VALUES (8.0::DOUBLE), (10.0), (12.0), (16.0), (20.0), (24.0), (32.0)) v(t)) AS tile FROM r""",
)
def fn_tile_adaptive(spark, root):
    density = table(spark, root, "lineitem").groupBy("l_suppkey").agg((F.count("*") / 2500.0).alias("density"))
    return density.select("l_suppkey", grid.adaptive_tile(F.col("density"), 40.0).alias("tile"))


@query(
    "fn_sample_segment",
    f"""WITH {_SEG}, n AS (SELECT *, greatest(CAST(ceil(sqrt(l2) / 0.1::DOUBLE) AS BIGINT) + 1, 2) AS n FROM l2),
        e AS (SELECT *, unnest(range(n)) AS i FROM n)
        SELECT point_id, CAST(i AS INTEGER) AS i, {q6("ax + (i::DOUBLE / (n - 1)) * (bx - ax)")} AS sx, {q6("ay + (i::DOUBLE / (n - 1)) * (by_ - ay)")} AS sy,
        {q6("az + (i::DOUBLE / (n - 1)) * (bz - az)")} AS sz FROM e""",
)
def fn_sample_segment(spark, root):
    from cloudloom.operators.supports import sample_segments

    s = sample_segments(_segments(spark, root), 0.1)
    return s.select("point_id", "i", *[r6(f"s{n}").alias(f"s{n}") for n in "xyz"])


@query(
    "fn_sha256",
    """WITH blocks AS (SELECT o_custkey, o_orderkey // 4096 AS b, sha256(string_agg(printf('%d;%.2f', o_orderkey, o_totalprice), '|' ORDER BY o_orderkey)) AS d FROM orders GROUP BY 1, 2)
       SELECT o_custkey, sha256(string_agg(d, '|' ORDER BY b)) AS digest FROM blocks GROUP BY 1""",
)
def fn_sha256(spark, root):
    from cloudloom.operators.validation import content_digest

    row = F.format_string("%d;%.2f", "o_orderkey", "o_totalprice")
    return content_digest(table(spark, root, "orders"), ["o_custkey"], "o_orderkey", row)
