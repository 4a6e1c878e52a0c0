import hashlib

from cloudloom.llm import decontaminate, jaccard


def test_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = p.language_id(spark, docs, sf_dir)
    assert known.columns == docs.columns and known.count() == docs.where("text rlike '\\\\p{L}'").count()
    single = p.jaccard_join(spark, known, sf_dir)
    groups = {r.component_id for r in jaccard.group(known).collect()}
    assert {r.doc_id for r in single.select("doc_id").collect()} == groups
    clean = p.decontamination(spark, single, sf_dir)
    hit = decontaminate.decontaminate(single, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").count()
    assert clean.count() == single.count() - hit and hit > 0
    mixed = p.mix_sources(spark, clean, sf_dir)
    words = lambda df: sum(len((r.text or "").encode().split()) for r in df.select("text").collect())
    assert mixed.columns == docs.columns and abs(words(mixed) / words(clean) - 1.5) < 0.2
    out = p.token_files(spark, mixed, sf_dir)
    assert out.count() == mixed.count()


def test_run_and_empty(spark, sf_dir, tmp_path):
    import corpus_pipeline as p

    assert len(p.STAGES) == 5 and hashlib
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").where("false").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0
