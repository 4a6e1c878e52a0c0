"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Sources in code point order (null last) weigh 5, 2, 1, repeating.  They share ``share`` times all words; a target stops
at ``cap`` times its source's words and the excess is shared again by weight until none is above.  Of a source with
target / words = whole + part, every document is taken ``whole`` times (the certain copies), and one more copy goes to
the sample. A document's inclusion odds are those of ``part`` times its size over the mean size of its source, so longer
documents are likelier to be taken once more. Documents are ranked by their random odds divided by their inclusion odds,
and the head of that order whose words come nearest to the rest of the target is taken: the size that is fixed is the
number of words, which the contract sets, and not that of documents.

Scale: one pass reads the texts and sums words by (source, bucket of the rank); the bucket in which the target falls is
found on those sums, and only rows of that one bucket of each source are ranked. Per-source facts reach the rows by a
join on (source, salt), which Spark broadcasts when small and which splits a hot source when not.

Defined results: null text has size 0 and takes nothing; null source is a source of its own, the last; rows that repeat
(id and text) share one random number and so one decision; an empty table gives an empty mix. The random number comes
from md5 of seed, id and text, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.llm.common import keep

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
SEED = "mix-1"
BUCKETS = 4_096
SALTS = 16
WORD = r"[^\x20\x09-\x0D]+"


def _sized(docs: DataFrame, seed: str) -> DataFrame:
    """Own columns only: __id, __source, __size and __u in (0, 1)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    mark = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("|"), F.md5(text)).cast("binary"))
    u = (F.conv(F.substring(mark, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    return docs.withColumns({"__size": F.regexp_count(text, F.lit(WORD)).cast("long"), "__u": u})


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size): the shared amount, levelled at each source's cap.

    A source is above its cap exactly when cap * size / weight lies below the common level; in that order the level
    after the first k capped sources is (amount - their caps) / (weights of the rest), so windows over the source
    table find it. The table has one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("w", weight).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    rise = Window.orderBy((F.col("limit") / F.col("w")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = s.withColumns({"below": F.coalesce(F.sum("limit").over(rise), F.lit(0.0)), "gone": F.coalesce(F.sum("w").over(rise), F.lit(0.0)), "amount": F.sum("source_size").over(whole) * F.lit(share), "all_w": F.sum("w").over(whole)})
    # the level if everything from this source on is uncapped; the first source that stays under its cap decides
    level = (F.col("amount") - F.col("below")) / (F.col("all_w") - F.col("gone"))
    s = s.withColumn("level", F.when(level * F.col("w") <= F.col("limit"), level))
    s = s.withColumn("level", F.max("level").over(whole))
    return s.select("source", "source_size", F.when(F.col("level").isNull() | (F.col("level") * F.col("w") > F.col("limit")), F.col("limit")).otherwise(F.col("level") * F.col("w")).alias("target"))


def _rank(of: str = "") -> object:
    """Random odds over inclusion odds, as a number in (0, 1) that rises with it."""
    odds = (F.col("__u") / (1 - F.col("__u"))) / ((F.col(f"{of}part") / (1 - F.col(f"{of}part"))) * (F.col("__size") / F.col(f"{of}mean")))
    return odds / (1 + odds)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """All columns of ``docs`` and size, source_size, target, copies, taken."""
    sized = _sized(docs.select("doc_id", "text", F.col("source").alias("source")), seed)
    compact = keep(sized.select("source", "__size", "__u"), "mix")
    whole = compact.groupBy("source").agg(F.sum("__size").alias("source_size"), F.count_if(F.col("__size") > 0).alias("n"))
    mean = whole.select(F.col("source").alias("__s"), (F.col("source_size") / F.greatest(F.col("n"), F.lit(1))).alias("mean"))
    per = targets(whole.select("source", "source_size"), weights, share, cap).join(mean, F.expr("source <=> __s")).drop("__s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per = per.withColumn("whole", F.floor(ratio)).withColumn("part", ratio - F.floor(ratio))
    per = per.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    per = keep(per, "mix-targets")

    salted = per.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    ranked = compact.withColumn("__salt", F.pmod(F.hash("__u"), F.lit(SALTS))).alias("c").join(
        salted.alias("p"), F.expr("c.source <=> p.source AND c.__salt = p.__salt")).where("part > 0 AND __size > 0").select("c.source", "__size", "__u", "part", "mean", "rest")
    ranked = ranked.withColumn("__rank", _rank()).withColumn("__bucket", F.least(F.floor(F.col("__rank") * buckets), F.lit(buckets - 1)))
    sums = ranked.groupBy("source", "__bucket").agg(F.sum("__size").alias("b"), F.max("rest").alias("rest"))
    up = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("b").over(up), F.lit(0)))
    edge = sums.where("before < rest AND before + b >= rest").select(F.col("source").alias("s"), F.col("__bucket").alias("k"), "before")
    # rows that share a random number are one step of the order
    steps = ranked.join(edge, F.expr("source <=> s AND __bucket = k")).groupBy("source", "__rank", "__u").agg(F.sum("__size").alias("b"), F.max("before").alias("before"), F.max("rest").alias("rest"))
    near = Window.partitionBy("source").orderBy("__rank", "__u").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("before", F.col("before") + F.coalesce(F.sum("b").over(near), F.lit(0)))
    place = F.struct("__rank", "__u")
    cut = steps.groupBy("source").agg(F.max(F.when(2 * F.col("before") + F.col("b") <= 2 * F.col("rest"), place)).alias("last"), F.min(place).alias("first"))
    # the head of the order is all up to the last step taken; no step taken: all before the bucket
    cut = cut.select(F.col("source").alias("s"), F.col("last").alias("upto"), F.col("first").alias("under"))
    facts = keep(per.join(cut, F.expr("source <=> s"), "left").drop("s").withColumnsRenamed({"source": "__s"}), "mix-cuts")
    facts = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    full = _sized(docs.select(names), seed).withColumn("__salt", F.pmod(F.hash("__u"), F.lit(SALTS)))
    out = full.alias("d").join(facts.alias("f"), F.expr("d.source <=> f.__s AND d.__salt = f.__salt"))
    at = F.struct(_rank("f.").alias("__rank"), F.col("__u").alias("__u"))
    head = F.when(F.col("f.upto").isNotNull(), at <= F.col("f.upto")).when(F.col("f.under").isNotNull(), at < F.col("f.under")).otherwise(F.lit(False))
    copies = (F.col("f.whole") + F.when((F.col("f.part") > 0) & (F.col("__size") > 0) & head, 1).otherwise(0)).cast("long")
    return out.select(*[F.col(f"d.{c}") for c in names], F.col("__size").alias("size"), "f.source_size", "f.target", copies.alias("copies"), (copies * F.col("__size")).alias("taken"))


RESULT = ["doc_id", "size", "f.source_size", "f.target", "taken"]

SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  (CAST(CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
           FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS DOUBLE) AS s, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
s1 AS (SELECT *, 2.0 * s AS lim,
              coalesce(sum(2.0 * s) OVER (ORDER BY 2.0 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
              coalesce(sum(w) OVER (ORDER BY 2.0 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone,
              sum(s) OVER () * 1.5 AS amount, sum(w) OVER () AS all_w FROM s0),
s2 AS (SELECT *, max(CASE WHEN (amount - below) / (all_w - gone) * w <= lim THEN (amount - below) / (all_w - gone) END) OVER () AS level FROM s1),
s3 AS (SELECT source, s, CASE WHEN level IS NULL OR level * w > lim THEN lim ELSE level * w END AS target FROM s2),
s4 AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS whole, CASE WHEN s > 0 THEN target / s - floor(target / s) ELSE 0 END AS part FROM s3),
mn AS (SELECT source, CAST(sum(size) AS DOUBLE) / greatest(count(*) FILTER (WHERE size > 0), 1) AS mean FROM d GROUP BY source),
r AS (SELECT d.doc_id, d.size, s4.s, s4.target, s4.whole, s4.part, s4.target - s4.whole * s4.s AS rest, d.source, d.u,
             CASE WHEN part > 0 AND size > 0 THEN (u / (1 - u)) / ((part / (1 - part)) * (size / mean)) END AS q
      FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source JOIN mn ON d.source IS NOT DISTINCT FROM mn.source),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q / (1 + q), u RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS before,
             sum(size) OVER (PARTITION BY source, q / (1 + q), u) AS b FROM r)
SELECT doc_id, size, CAST(s AS BIGINT) AS source_size, target,
       CAST(size * (whole + CASE WHEN part > 0 AND size > 0 AND before < rest AND 2 * before + b <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM o
"""
