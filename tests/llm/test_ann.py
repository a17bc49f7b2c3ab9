import numpy as np
import pytest

from framewright.llm import ann

SCHEMA = "vec_id long, embedding array<float>, rank int, id long"


def brute(ids, x, every, k):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % every == 0:
            d = np.sqrt(((x - q) ** 2).sum(1))
            out[i] = [(float(a), b) for a, b in sorted((a, b) for a, b in zip(d.tolist(), ids, strict=True) if b != i)[:k]]
    return out


def test_recall_and_exact_scores(spark):
    x = np.random.RandomState(0).randn(3000, 16).astype(np.float32)
    rows = ann.search(spark.createDataFrame([(i, v.tolist(), 0, 0) for i, v in enumerate(x)], SCHEMA).repartition(3), every=50).collect()
    truth = brute(list(range(3000)), x.astype(float), 50, 10)
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert got.keys() == truth.keys()
    hits = 0
    for q, own in got.items():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert [(s, v) for _, s, v in own] == sorted((s, v) for _, s, v in own)
        hits += len({v for _, _, v in own} & {v for _, v in truth[q]})
        for _, s, v in own:
            assert s == pytest.approx(np.sqrt(((x[q].astype(float) - x[v].astype(float)) ** 2).sum()), rel=1e-12)
    assert hits / (10 * len(got)) >= 0.9


def test_hot_vectors_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ENTRIES", 5)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 2)
    rng = np.random.RandomState(1)
    x = np.concatenate([np.tile([1.0, 2.0, 3.0, 4.0], (60, 1)), rng.randn(90, 4)]).astype(np.float32)
    rows = ann.search(spark.createDataFrame([(i, v.tolist(), 0, 0) for i, v in enumerate(x)], SCHEMA), every=30, recall=1.0).collect()
    truth = brute(list(range(150)), x.astype(float), 30, 10)
    for q in (0, 30):
        assert [(r.score, r.vec_id) for r in sorted(rows, key=lambda r: r.rank) if r.query_id == q] == truth[q]


def test_odd_vectors(spark):
    odd = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0]), (7, [1.0, 1.0]), (8, [2.0, 1.0]), (None, [1.0, 1.0]), (100, None), (200, [0.0, 0.0])]
    rows = ann.search(spark.createDataFrame([(i, v, 0, 0) for i, v in odd], SCHEMA)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in rows) == [(0, 1, 7), (0, 2, 8)]
    assert ann.search(spark.createDataFrame([], SCHEMA)).count() == 0
    assert ann.search(spark.createDataFrame([(0, [1.0, 2.0], 0, 0)], SCHEMA)).count() == 0


def test_few_candidates_are_all_returned(spark):
    x = np.random.RandomState(2).randn(9, 8)
    rows = ann.search(spark.createDataFrame([(i * 10, v.tolist(), 0, 0) for i, v in enumerate(x)], SCHEMA), every=100).collect()
    assert sorted(r.vec_id for r in rows) == [10, 20, 30, 40, 50, 60, 70, 80]


def test_one_row_of_another_length_changes_nothing(spark):
    x = np.random.RandomState(3).randn(199, 6)
    rows = [(i, v.tolist(), 0, 0) for i, v in enumerate(x)]
    got, wanted = (sorted(map(tuple, ann.search(spark.createDataFrame(r, SCHEMA), every=50).collect())) for r in ([*rows, (500, [1.0] * 9, 0, 0)], rows))
    assert got == wanted
    assert len(wanted) == 40


def test_doubles_stay_doubles(spark):
    x = [[1.0, 1e-9 * i] for i in range(12)]
    schema = SCHEMA.replace("float", "double")
    rows = ann.search(spark.createDataFrame([(i, v, 0, 0) for i, v in enumerate(x)], schema), every=100).collect()
    assert [(r.rank, r.vec_id) for r in sorted(rows, key=lambda r: r.rank)] == [(i, i) for i in range(1, 11)]
    assert all(r.score == pytest.approx(1e-9 * r.vec_id, rel=1e-6) for r in rows)


def test_repeated_rows_count_once(spark):
    x = np.random.RandomState(4).randn(30, 4)
    rows = [(i, v.tolist(), 0, 0) for i, v in enumerate(x)]
    once, twice = (sorted(map(tuple, ann.search(spark.createDataFrame(r, SCHEMA), every=10, recall=1.0).collect())) for r in (rows, rows + rows[:15] + rows[:1]))
    assert once == twice


def test_heap_visits_cells_in_order():
    rng = np.random.RandomState(5)
    index = ann.MultiIndex((rng.randn(6, 2), rng.randn(7, 3)), 1.0)
    sizes = rng.randint(0, 3, (6, 7))
    q = rng.randn(5)
    away = ((index.codebooks[0] - q[:2]) ** 2).sum(1)[:, None] + ((index.codebooks[1] - q[2:]) ** 2).sum(1)[None]
    order = [(int(i), int(j)) for i, j in zip(*np.unravel_index(np.argsort(away.ravel()), away.shape), strict=True) if sizes[i, j]]
    assert list(index.visit(q, sizes, np.inf)) == order
    held = np.cumsum([sizes[c] for c in order])
    assert list(index.visit(q, sizes, 5)) == order[: int(np.searchsorted(held, 5)) + 1]


def test_recall_and_visited_share_of_the_tables(spark):
    shares = {}
    for sf in ("sf0.01", "sf0.1"):
        df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
        own = [(r.vec_id, r.embedding) for r in df.collect() if r.embedding and all(c is not None for c in r.embedding)]
        x = np.array([v for _, v in own])
        truth = brute([i for i, _ in own], x, 20, 10)
        got = {}
        for r in ann.search(df, every=20).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        recall = np.mean([len(got[q] & {i for _, i in near}) / 10 for q, near in truth.items()])
        shares[sf] = ann.fit(np.unique(x, axis=0), len(x), 10, 0.97).share
        print(f"{sf}: recall {recall:.3f}, share visited {shares[sf]:.3f}")
        assert recall >= 0.95
    assert shares["sf0.1"] < 0.6
