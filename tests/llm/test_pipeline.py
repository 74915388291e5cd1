"""The corpus pipeline: each stage takes effect and keeps the columns; the last one encodes."""

from __future__ import annotations

import corpus_pipeline
from rowtide.llm import queries


def test_stages(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, d).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns, name
        before = after
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(before.columns)
    assert len(corpus_pipeline.STAGES) == 5


def test_quality_stage_is_the_classifier(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.keep_good(spark, docs, small).collect()}
    assert kept == {r.doc_id for r in queries.op3_quality_classifier(spark, small).where("predicted = 1").collect()}


def test_empty_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    assert docs.collect() == []
