import hashlib
import math

from framewright.llm import fingerprints


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (a.split(), b.split()))
    return len(x & y) / len(x | y) if x | y else 1.0


def check(rows, docs):
    ordered = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), d[1] or ""))
    wanted = []
    for k, (i, t) in enumerate(ordered):
        t, following = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        edited = fingerprints.spliced(t, following)
        wanted.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), jaccard(t, edited), jaccard(t, following)))
    wanted.sort(key=lambda w: str(w[:3]))
    got = sorted(rows, key=lambda r: str((r.doc_id, r.n_chars, r.edited_sha256)))
    assert [(r.doc_id, r.n_chars, r.edited_sha256) for r in got] == [w[:3] for w in wanted]
    for r, w in zip(got, wanted, strict=True):
        for got_, true in ((r.near_edited, w[3]), (r.near_next, w[4])):  # five standard errors of 128 values, one value at least
            assert abs(got_ - true) <= 5 * math.sqrt(max(true * (1 - true), 0.01) / 128)


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(3)
    rows = fingerprints.compare_edited(docs).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    texts, prints = {r.doc_id: r.text for r in docs.collect()}, {}
    for r in rows:
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint


def test_odd_documents(odd, nothing):
    check(fingerprints.compare_edited(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert fingerprints.compare_edited(nothing).count() == 0
    assert fingerprints.compare_edited(odd.where("doc_id = 7")).count() == 1
    assert fingerprints.fingerprint(odd).count() == odd.count()


def test_equal_and_null_ids_are_dealt_to_several_tasks(spark):
    docs = [(i, f"text {k} of many words and more words {k * 7}") for k in range(200) for i in (None, 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    check(fingerprints.compare_edited(df).collect(), docs)


def test_prints_are_the_low_bytes_of_the_bands_values():
    from framewright.llm.common import permutations
    from framewright.llm.similar import BANDS, ROWS

    some, more = permutations(fingerprints.PERMUTATIONS), permutations(BANDS * ROWS)
    assert all((x == y[: len(x)]).all() for x, y in zip(some, more, strict=True))
