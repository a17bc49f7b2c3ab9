import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framewright.llm import lm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), " "]


def check(rows, docs):
    counts = Counter(w for i, t in docs if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1 for w in words(t))
    n, v = sum(counts.values()), len(counts)
    wanted = sorted((str(i), len(w := words(t)), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 5)) for i, t in docs)
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows)
    assert [g[:4] for g in got] == [w[:4] for w in wanted]
    assert all(g[4] == pytest.approx(w[4], rel=1e-6) for g, w in zip(got, wanted, strict=True))


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(3)
    rows = lm.score_held_out(docs).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    for held in (True, False):
        own = [r for r in rows if r.held_out == held]
        assert sum(r.score for r in own) > sum(r.base_score for r in own)


def test_odd_documents(odd, nothing):
    check(lm.score_held_out(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert lm.score_held_out(nothing).count() == 0
    got = lm.score(odd, training=nothing).collect()
    assert len(got) == odd.count()
    assert all(r.train_tokens == r.n_known == r.score == r.base_score == 0 for r in got)


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
@settings(max_examples=50, deadline=None)
def test_packing_of_integers(values):
    x = np.array(values, np.uint64)
    assert (lm.unpacked(lm.packed(x)) == x).all()
    assert (lm.unpacked_keys(lm.packed_keys(np.sort(x))) == np.sort(x)).all()
    at = lm.bounds(np.sort(x), 7)
    assert [at[k + 1] - at[k] for k in range(7)] == [sum(v * 7 >> 64 == k for v in values) for k in range(7)]


def interpolated(docs, order):
    """p of a word after others, by counts of all n-grams of the documents."""
    counts = Counter(tuple(w[i : i + n]) for d in docs for w in ([None, *words(d)],) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total, vocabulary = sum(c for g, c in counts.items() if len(g) == 1 and g != (None,)), sum(len(g) == 1 and g != (None,) for g in counts)

    def p(w, h):
        if not h:
            return (counts[w,] + 0.5) / (total + 0.5 * (vocabulary + 1))
        if not counts[h]:
            return p(w, h[1:])
        share, power = lm.NEW[0 if len(h) == 1 else 1]
        new = share * counts[h] ** -power
        return (1 - new) * counts[(*h, w)] / counts[h] + new * p(w, h[1:])

    return p, counts


def brute(p, text, order):
    w = [None, *words(text)]
    return sum(math.log10(p(w[i], tuple(w[max(0, i - order + 1) : i]))) for i in range(1, len(w)))


TEXTS = ["a b c d a b c e", "a b d c a b", "d c b a rare words here", "rare words here a b", "c c c c", "new a b c unknown rare words", "", *["x y z"] * 40]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_are_those_of_the_model_over_all_n_grams(spark, order, monkeypatch):
    # n-grams far below any share of the corpus: every one counts, those of rare words too; several chunks and buckets
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 20)
    monkeypatch.setattr(lm, "BUCKET_KEYS", 5)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    p, _ = interpolated([t for i, t in enumerate(TEXTS) if i != 5], order)
    for got in (lm.score(docs, docs.doc_id != 5, order=order).collect(), lm.score(docs, training=docs.where("doc_id <> 5"), order=order).collect()):
        assert len(got) == len(TEXTS)
        for r in got:
            assert r.score == pytest.approx(brute(p, TEXTS[r.doc_id], order), rel=1e-9)


def test_documents_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    p, _ = interpolated([t for i, t in rows.items() if zlib.crc32(str(i).encode()) % 5 != 1], lm.ORDER)
    for r in lm.score_held_out(docs).collect():
        assert r.score == pytest.approx(brute(p, rows[r.doc_id], lm.ORDER), rel=1e-9)


def test_every_state_is_a_distribution():
    docs = TEXTS[:6]
    p, counts = interpolated(docs, 3)
    vocabulary = {g[0] for g in counts if len(g) == 1} - {None}
    for h in {g[:-1] for g in counts}:
        assert sum(p(w, h) for w in vocabulary) + p("unseen", h) == pytest.approx(1, abs=1e-9), h


def test_states_arcs_and_failure_arcs():
    hashed = lm.Words()
    keys, lengths = hashed(TEXTS)
    grams = lm.Grams(*np.unique(keys, return_inverse=True), lengths, 3, 40)
    learn = np.array([i != 5 for i in range(len(TEXTS))], float)
    counts = grams.counts(learn)
    a = lm.Automaton(grams, counts, 100, 20)
    for n in (2, 3):
        g, h = grams.own[n][grams.at[n]], grams.own[n - 1][grams.at[n] - 1]
        assert (np.isnan(a.arc[g]) == (counts[g] == 0)).all()  # an arc for each seen n-gram
        assert (np.isnan(a.failure[h]) == (counts[h] == 0)).all()  # a state for each seen context
    for n in (2,):  # a state's failure arc leads to a state
        at = grams.at[3]
        long, short = grams.own[2][at - 1], grams.own[1][at - 1]
        assert (counts[short][counts[long] > 0] > 0).all()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_gain_over_the_base_tells_copies_of_training_texts(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    trained = {t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1}
    rows = [r for r in lm.score_held_out(docs).collect() if r.held_out and r.n_tokens > 20]
    gain = np.array([(r.score - r.base_score) / r.n_tokens for r in rows])
    copy = np.array([texts[r.doc_id] in trained for r in rows])
    rank = np.argsort(np.argsort(gain)) + 1
    assert (rank[copy].sum() - copy.sum() * (copy.sum() + 1) / 2) / (copy.sum() * (~copy).sum()) >= 0.95
