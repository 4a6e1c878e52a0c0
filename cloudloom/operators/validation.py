"""Contract checks as violation queries, and content digests."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.functions import geometry as g
from cloudloom.operators.axes import mean_tangent
from cloudloom.operators.clustering import tangent_groups
from cloudloom.operators.supports import group_spacing
from cloudloom.session import cut

_BLOCK = 4096

# Gates of the manifest check.
DRIFT_FAIL, DRIFT_WARN = 0.15, 0.05
CHUNK_BUDGET = 1_000_000


def content_digest(df: DataFrame, keys: Sequence[str], order: str, row: Column) -> DataFrame:
    """SHA-256 over the rows of each key in id order, as a two-level hash.

    Rows are hashed in blocks of 4096 ids and the block hashes are hashed again,
    so no task holds more than one block of rows however large a key is.
    """
    block = F.floor(F.col(order) / _BLOCK)

    def joined(items: str) -> Column:
        return F.sha2(F.array_join(F.transform(F.array_sort(F.col(items)), lambda s: s["t"]), "|"), 256)

    blocks = df.groupBy(*keys, block.alias("_b")).agg(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("t"))).alias("_r"))
    blocks = blocks.select(*keys, F.struct(F.col("_b").alias("o"), joined("_r").alias("t")).alias("_h"))
    return blocks.groupBy(*keys).agg(F.collect_list("_h").alias("_r")).select(*keys, joined("_r").alias("digest"))


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One pass: (check, bad rows) for each named condition that must hold."""
    wide = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("bad")) for n in checks])
    return wide.select(F.inline(rows))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of ``child`` that point at no row of ``parent``."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def check_chunk(points: DataFrame, classes: int = 16) -> DataFrame:
    finite = [~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) for c in ("x", "y", "z")]
    size = g.norm((F.col("nx"), F.col("ny"), F.col("nz")))
    return violations(points, {
        "finite": finite[0] & finite[1] & finite[2], "class_range": F.col("segment").between(0, classes - 1), "unit_normal": size.between(0.99, 1.01),
    })


def check_edge(points: DataFrame, edge: DataFrame) -> DataFrame:
    """valid is 0/1 and edge rows match the points one to one."""
    flags = violations(edge, {"valid_flag": F.col("valid").isin(0.0, 1.0)})
    missing = points.join(edge, "point_id", "left_anti").agg(F.lit("missing_rows").alias("check"), F.count("*").alias("bad"))
    extra = edge.join(points, "point_id", "left_anti").agg(F.lit("extra_rows").alias("check"), F.count("*").alias("bad"))
    return flags.unionByName(missing).unionByName(extra)


def check_ranges(supports: DataFrame, total: int | Column) -> DataFrame:
    end = F.col("segment_offset") + F.col("segment_length")
    return violations(supports, {"offset_sign": F.col("segment_offset") >= 0, "inside_total": end <= total})


def drift(raw: DataFrame, final: DataFrame) -> DataFrame:
    """Share change per class between raw points (VOID left out, shifted down) and kept voxels."""
    r = raw.where("class_id > 0").select((F.col("class_id") - 1).alias("class_id"), F.col("n").alias("nr"))
    both = r.join(final.select("class_id", F.col("n").alias("nf")), "class_id", "full").fillna(0, ["nr", "nf"])
    packed = both.agg(F.sum("nr").alias("tr"), F.sum("nf").alias("tf"), F.collect_list(F.struct("class_id", "nr", "nf")).alias("_c"))
    out = packed.select("tr", "tf", F.inline("_c"))  # one entry per class
    d = F.when((F.col("tr") > 0) & (F.col("tf") > 0), F.abs(F.col("nf") / F.nullif("tf", F.lit(0)) - F.col("nr") / F.nullif("tr", F.lit(0))))
    level = F.when(d > DRIFT_FAIL, "HARD FAIL").when(d > DRIFT_WARN, "WARN")
    return out.select("class_id", d.alias("drift"), level.alias("level"))


def sanity(raw: DataFrame, final: DataFrame, chunks: DataFrame, coverage: DataFrame, budget: int = CHUNK_BUDGET) -> DataFrame:
    """All gate messages of a build: (level, subject, value)."""
    d = drift(raw, final)
    empty = d.agg(F.count("drift").alias("k")).where("k = 0").select(F.lit("WARN").alias("level"), F.lit("empty histograms").alias("subject"), F.lit(0.0).alias("value"))
    moved = d.where("level IS NOT NULL").select("level", F.concat(F.lit("class "), F.col("class_id").cast("string")).alias("subject"), F.col("drift").alias("value"))
    fat = chunks.where(F.col("n") > budget).select(F.lit("HARD FAIL").alias("level"), F.col("chunk").alias("subject"), F.col("n").cast("double").alias("value"))
    gaps = coverage.select(F.lit("HARD FAIL").alias("level"), F.concat(F.col("problem"), F.lit(" "), F.col("sample").cast("string")).alias("subject"), F.lit(1.0).alias("value"))
    return moved.unionByName(empty).unionByName(fat).unionByName(gaps)


def to_do(tasks: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """Tasks without a finished state for the same source hash."""
    if force:
        return tasks
    return tasks.join(state.where("status = 'done'").select("sample", "source_hash"), ["sample", "source_hash"], "left_anti")


def merge_state(old: DataFrame, new: DataFrame) -> DataFrame:
    """State rows after a run: new rows replace old ones of the same sample, the rest stays."""
    return new.unionByName(old.join(new, "sample", "left_anti"))


def cluster_contract(members: DataFrame, keys: Sequence[str], cos_th: float = math.cos(math.radians(45.0)), scale: float = 3.0, min_size: int = 6) -> DataFrame:
    """Per checked cluster: widest gap along and widest offset across its direction, in spacings.

    Clusters with several direction groups are ``fallback`` and not checked.
    The widest gap is found exactly from bucket extremes: a gap that breaks the
    rule is wider than the buckets used.
    """
    from cloudloom.operators.axes import largest_gap

    keys = list(keys)
    sized = members.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(a).alias(f"m{a}") for a in "xyz"]).where(F.col("n") >= min_size)
    rows = members.join(sized, keys)
    dirs = tangent_groups(rows, keys, cos_th).groupBy(*keys).agg((F.max("dir_group") + 1).alias("groups"))
    dirs = cut(dirs)
    checked = cut(rows.join(dirs.where("groups = 1").select(*keys), keys))
    checked = checked.join(mean_tangent(checked, keys, "center_id"), keys).join(group_spacing(checked, keys), keys)
    off = g.sub(g.vec(""), g.vec("m"))
    checked = checked.withColumn("t", g.dot(off, g.vec("mt")))
    lateral = F.sqrt(F.greatest(g.dot(off, off) - F.col("t") * F.col("t"), F.lit(0.0)))
    across = checked.groupBy(*keys).agg(F.max(lateral / F.col("spacing")).alias("lateral"))
    gaps = largest_gap(checked, keys, "t", F.col("spacing") * scale).select(*keys, F.lit(True).alias("h2"))
    out = dirs.join(across, keys, "left").join(gaps, keys, "left")
    return out.select(*keys, F.when(F.col("groups") > 1, "fallback").otherwise("checked").alias("kind"),
                      F.coalesce("h2", F.lit(False)).alias("gap_broken"), F.coalesce(F.col("lateral") > scale, F.lit(False)).alias("band_broken"))


def contract_rate(contract: DataFrame) -> DataFrame:
    checked = contract.where("kind = 'checked'")
    broken = F.sum(F.col("gap_broken").cast("int") + F.col("band_broken").cast("int"))
    return checked.agg(F.count("*").alias("checked"), F.coalesce(broken / (2 * F.count("*")), F.lit(0.0)).alias("rate"))
