"""The registered queries of the text operators, one a numbered operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.llm import bytespans, chat, decontaminate, divergence, extract, fingerprints, jaccard, language, mixing, phrases, quality, substrings, tokens
from cloudloom.llm.common import ship, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return put


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.learn_from(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query("op2_fingerprints")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(table(spark, sf_dir, "documents"))


@query("op2_near_duplicates")
def op2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_html_text")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract.extract(pages, extract.learn(extract.self_labelled(pages)))


@query("op5_decontamination", decontaminate.SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*decontaminate.RESULT)


@query("op6_mixing", mixing.SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken")


@query("op7_token_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_documents(table(spark, sf_dir, "documents"))


@query("op10_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = quality.score(docs.select("doc_id", "text"), quality.learn_from(docs, labels))
    return found.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


@query("op9_substring_dedup", substrings.SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_words(table(spark, sf_dir, "documents"))


@query("op8_jaccard_join", jaccard.SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.group(table(spark, sf_dir, "documents"))


@query("op4_suffix_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytespans.dedup_bytes(table(spark, sf_dir, "documents"))


@query("op11_source_audit", divergence.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op12_chat_format", chat.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest_table(table(spark, sf_dir, "conversations"))


@query("op13_phrases", phrases.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))
