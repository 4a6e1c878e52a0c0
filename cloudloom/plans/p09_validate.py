"""Validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.operators import pairs, validation, voxel
from cloudloom.plans.derived import SIZE, cluster_members, support_tables
from cloudloom.plans.p02_voxel import VOX_SQL, voxels
from cloudloom.plans.registry import q6, query, r6
from cloudloom.sources.tables import lattice_points, predictions, scan_points, table


@query(
    "val_centers",
    "SELECT 'pair_sorted' AS \"check\", CAST(count_if(NOT (segment <= 7)) AS BIGINT) AS bad FROM pts UNION ALL SELECT 'finite', CAST(count_if(NOT isfinite(x + y + z)) AS BIGINT) FROM pts UNION ALL SELECT 'unit_tangent', CAST(count_if(NOT (sqrt(nx*nx+ny*ny+nz*nz) BETWEEN 0.99 AND 1.01)) AS BIGINT) FROM pts",
    "pts",
)
def val_centers(spark, root):
    rows = scan_points(spark, root).withColumns({"label_a": F.col("segment"), "label_b": F.lit(7)})
    size = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    total = F.col("x") + F.col("y") + F.col("z")
    return validation.violations(rows, {
        "pair_sorted": F.col("label_a") <= F.col("label_b"), "finite": ~F.isnan(total) & (F.abs(total) < float("inf")), "unit_tangent": size.between(0.99, 1.01),
    })


@query("val_clusters", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def val_clusters(spark, root):
    parents = table(spark, root, "customer").where("c_nationkey < 20")
    return validation.orphans(table(spark, root, "orders"), parents, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("val_contract")
def val_contract(spark, root):
    return validation.cluster_contract(cluster_members(spark, root), ["cluster_id"], cos_th=0.05)


@query("val_supports", f"WITH s AS (SELECT point_id // {SIZE} AS support_id, count(*) - 1 AS len FROM pts WHERE point_id % 5 = 0 GROUP BY 1), o AS (SELECT *, sum(len) OVER (ORDER BY support_id) - len AS off FROM s) SELECT 'offset_sign' AS \"check\", CAST(count_if(off < 0) AS BIGINT) AS bad FROM o UNION ALL SELECT 'inside_total', CAST(count_if(off + len > 70) AS BIGINT) FROM o", "pts")
def val_supports(spark, root):
    from cloudloom.sources.stage import flat_supports

    sup, segs = support_tables(spark, root)
    nested = segs.groupBy("support_id").agg(F.collect_list("seg").alias("segments"))  # four per support
    nested = sup.select("support_id").join(nested, "support_id", "left")  # one vertex makes a support without segments
    return validation.check_ranges(flat_supports(nested.withColumnRenamed("support_id", "src"), ["src"]), 70)


@query("val_edge", "SELECT 'valid_flag' AS \"check\", CAST(count_if(valid NOT IN (0, 1)) AS BIGINT) AS bad FROM pred UNION ALL SELECT 'missing_rows', count(*) FROM pts WHERE segment >= 7 UNION ALL SELECT 'extra_rows', 0::BIGINT", "pts pred")
def val_edge(spark, root):
    kept = predictions(spark, root).where("truth BETWEEN 0 AND 6").select("point_id", "valid")
    every = predictions(spark, root).select("point_id", "valid").where("valid NOT IN (0, 1)")
    return validation.check_edge(scan_points(spark, root), kept.unionByName(every))


@query("val_chunk", "SELECT 'finite' AS \"check\", CAST(count_if(NOT isfinite(x + y + z)) AS BIGINT) AS bad FROM pts UNION ALL SELECT 'class_range', CAST(count_if(NOT (segment BETWEEN 0 AND 7)) AS BIGINT) FROM pts UNION ALL SELECT 'unit_normal', CAST(count_if(NOT (sqrt(nx*nx+ny*ny+nz*nz) BETWEEN 0.99 AND 1.01)) AS BIGINT) FROM pts", "pts")
def val_chunk(spark, root):
    return validation.check_chunk(scan_points(spark, root), classes=8)


@query(
    "val_sanity",
    f"""WITH {VOX_SQL}, r AS (SELECT c - 1 AS class_id, count(*) AS n FROM lat WHERE c > 0 GROUP BY 1), f AS (SELECT winner - 1 AS class_id, count(*) AS n FROM vox WHERE winner > 0 GROUP BY 1),
        d AS (SELECT coalesce(r.class_id, f.class_id) AS class_id, abs(coalesce(f.n, 0) / (SELECT sum(n) FROM f) - coalesce(r.n, 0) / (SELECT sum(n) FROM r)) AS drift FROM r FULL JOIN f ON r.class_id = f.class_id)
        SELECT CASE WHEN drift > 0.15 THEN 'HARD FAIL' ELSE 'WARN' END AS level, 'class ' || class_id AS subject, {q6('drift')} AS value FROM d WHERE drift > 0.05
        UNION ALL SELECT 'HARD FAIL', 'chunk ' || sample, n::DOUBLE FROM (SELECT sample, count(*) AS n FROM lat GROUP BY 1) WHERE n > 11990
        UNION ALL SELECT 'HARD FAIL', 'missing ' || s.i, 1.0 FROM range(7) s(i) WHERE s.i NOT IN (SELECT sample FROM lat)""",
    "lat",
)
def val_sanity(spark, root):
    lat = lattice_points(spark, root)
    raw = lat.groupBy(F.col("c").alias("class_id")).agg(F.count("*").alias("n"))
    final = voxel.drop_void(voxels(spark, root)).groupBy(F.col("segment").alias("class_id")).agg(F.count("*").alias("n"))
    chunks = lat.groupBy("sample").agg(F.count("*").alias("n")).select(F.concat(F.lit("chunk "), F.col("sample").cast("string")).alias("chunk"), "n")
    expected = spark.range(7).select(F.col("id").alias("sample"))
    missing = pairs.coverage(expected, lat, "sample")
    out = validation.sanity(raw, final, chunks, missing, budget=11990)
    return out.withColumn("value", r6("value"))


@query("val_idempotent", "SELECT o_orderkey AS sample, o_custkey % 7 AS source_hash FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderkey % 7 = o_custkey % 7)")
def val_idempotent(spark, root):
    o = table(spark, root, "orders")
    tasks = o.select(F.col("o_orderkey").alias("sample"), (F.col("o_custkey") % 7).alias("source_hash"))
    state = o.select(F.col("o_orderkey").alias("sample"), (F.col("o_orderkey") % 7).alias("source_hash"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("partial").alias("status"))
    return validation.to_do(tasks, state)


@query("val_resume", "SELECT o_orderkey AS sample, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'old' END AS status FROM orders")
def val_resume(spark, root):
    """State after a resumed run keeps the rows of skipped samples."""
    o = table(spark, root, "orders").select(F.col("o_orderkey").alias("sample"), "o_orderstatus")
    old = o.select("sample", F.lit("old").alias("status"))
    new = o.where("o_orderstatus = 'F'").select("sample", F.lit("done").alias("status"))
    return validation.merge_state(old, new)
