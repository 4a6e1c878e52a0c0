"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

1. language_id      rejects texts in no language: exactly those that the operator calls ``und``, null or without any
                    letter. A text with letters always gets one of the learned languages, and none goes for a low score.
2. jaccard_join     of each group of documents linked by shingle overlap, only the smallest id stays
3. decontamination  documents that hold a benchmark window go
4. mixing           documents are taken as often as the source mix says
5. token_files      token ids in wavelet matrix shards; the result is read back from them

Every stage returns the columns of ``documents``, the last (doc_id, start, n_tokens, ids_crc32). Documents without an id
are kept by the filters; rows of equal id count as one document in stage 2, and one of them stays. Empty tables pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.llm import decontaminate, jaccard, language, mixing, tokens
from cloudloom.llm.common import keep, ship, table


#: Columns of ``documents`` that the operators read; all others travel under names that no operator uses.
READ = ("doc_id", "text", "lang", "source")


def with_own_columns(docs: DataFrame, work) -> DataFrame:
    """``work(docs)`` with the columns of ``docs`` alone, whatever the operator calls its own."""
    away = {c: f"__docs_{i}" for i, c in enumerate(docs.columns) if c not in READ}
    out = work(docs.withColumnsRenamed(away))
    return out.select(*[F.col(away.get(c, c)).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    tree = language.learn_from(docs)
    return with_own_columns(docs, lambda d: language.identify(d, tree).where(F.col("lang_pred") != language.UNKNOWN))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    found = keep(jaccard.group(docs).where("doc_id IS NOT NULL").select("doc_id", "component_id"), "pipeline-groups")
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    out = docs.join(gone, "doc_id", "left_anti")
    several = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not several.isEmpty():
        out = out.join(several, "doc_id", "left_anti").unionByName(out.join(several, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return out.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    items = table(spark, sf_dir, "benchmark")
    return with_own_columns(docs, lambda d: decontaminate.decontaminate(d, items).where("NOT contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return with_own_columns(docs, lambda d: mixing.mix(d).where("copies > 0").withColumn("copy", times))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return tokens.encode_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
    ("token_files", token_files),
]

#: The first stage is a learned model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
