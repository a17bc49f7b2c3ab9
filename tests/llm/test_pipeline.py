from collections import Counter

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from framewright.llm import language_id, queries, toxicity  # noqa: E402

from .test_near_duplicates import brute  # noqa: E402


def test_stages_and_run(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept, columns = docs, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        before = kept
        stage(spark, before, small).write.parquet(f"{tmp_path}/{k}")
        kept = spark.read.parquet(f"{tmp_path}/{k}")
        assert kept.columns == columns
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        if name == "toxicity":
            scores = toxicity.score(before, toxicity.train(before, spark.read.parquet(f"{small}/labels.parquet")))
            assert ids == {r.doc_id for r in scores.where(F.col("score") < 0.7).collect()}
        elif name == "language_id":
            found = language_id.predict(before, language_id.train(before))
            assert ids == {r.doc_id for r in found.where("lang_pred <> 'und' AND score >= 0.5").collect()}
        else:
            assert ids == {lead for lead, _ in brute([(r.doc_id, r.text) for r in before.collect()]).values()}
        assert len(ids) > 0.7 * before.count()
    pieces = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in pieces} == ids
    got = Counter()
    for r in pieces:
        got[r.doc_id] += r.length
    assert all(got[r.doc_id] == r.doc_tokens for r in pieces)


def test_odd_documents_pass_the_stages(spark, odd, nothing, small):
    for docs in (odd, nothing):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, small).count()


def test_ten_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
