"""The pipeline on small tables, and the queries against the operators' contracts."""

import corpus_pipeline
from foldmark.llm import decontaminate, quality, simhash


def test_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    count = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = simhash.materialize(stage(spark, docs, tiny), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert 0 < docs.count() <= count
        count = docs.count()
    benchmark = spark.read.parquet(f"{tiny}/benchmark.parquet")
    assert decontaminate.report(docs, benchmark).filter("contaminated").count() == 0
    found = simhash.classes(docs)
    assert found.select("root").distinct().count() >= 0.99 * count
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, tiny)
    assert {"doc_id", "text", "size", "source_size", "target", "taken"} <= set(mixed.columns)


def test_clean_labelled_documents_stay(spark, tiny):
    docs, marks = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "labels"))
    kept = quality.accepted(docs, marks).join(marks.filter("quality = 1"), "doc_id", "left_semi").count()
    assert kept == docs.join(marks.filter("quality = 1"), "doc_id", "left_semi").count()


def test_run_is_the_stages(spark, tiny):
    first = sorted((r["doc_id"], r["taken"]) for r in corpus_pipeline.run(spark, tiny).collect())
    assert first and first == sorted((r["doc_id"], r["taken"]) for r in corpus_pipeline.run(spark, tiny).collect())


def test_empty_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tiny)
    assert docs.count() == 0
