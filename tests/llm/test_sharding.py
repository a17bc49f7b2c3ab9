import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from framewright.llm import sharding


@pytest.mark.parametrize(("key", "shards", "expected"), [(1, 1, 0), (42, 57, 43), (0xDEAD10CC, 1, 0), (0xDEAD10CC, 666, 361), (256, 1024, 520)])
def test_published_values(spark, key, shards, expected):
    assert spark.range(1).select(sharding.jump_hash(F.lit(key).cast("long"), shards)).first()[0] == expected


def walk(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_same_as_the_integer_walk(spark):
    rows = spark.range(500).select(F.xxhash64("id").alias("k")).select("k", sharding.jump_walk(F.col("k"), 40).alias("w")).collect()
    assert [(r.w.shard, r.w.grown) for r in rows] == [(walk(r.k, 40), walk(r.k, 41)) for r in rows]


def check(rows, docs, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(0 <= r.shard < shards and r.grown_shard in (r.shard, shards) and r.law == "key" for r in rows)
    assert len({(r.doc_id, r.shard) for r in rows}) == len({r.doc_id for r in rows})


def test_assign(spark, small, odd, nothing):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check(sharding.assign(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()], 40)
    check(sharding.assign(odd, shards=3).collect(), [(r.doc_id, r.text) for r in odd.collect()], 3)
    assert sharding.assign(nothing).count() == 0


def test_no_python_in_the_plan(odd):
    plan = sharding.assign(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan


def test_many_copies_of_a_row_are_expanded_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 7)
    docs = [(None, None)] * 100 + [(5, "x")] * 7 + [(5, "y")] * 8 + [(k, "z") for k in range(30)]
    check(sharding.assign(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), shards=2).collect(), docs, 2)
