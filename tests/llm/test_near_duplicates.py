import random
from collections import Counter, defaultdict

import pytest

from framewright.llm import fingerprints, ngram_join, similar


def sets(text):
    w = text.split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(docs):
    """Links and smallest id of the class of each document, by comparing all pairs."""
    shingled, links, lead = [(i, sets(t or "")) for i, t in docs], Counter(), {i: i for i, _ in docs}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for k, (i, a) in enumerate(shingled):
        for j, b in shingled[:k]:
            if a == b or (a and b and len(a & b) / len(a | b) >= 0.8):
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                lead[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i, _ in docs}


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    docs, n = [], 0
    for size, words in ((60, 120), (25, 40), (8, 300), (3, 6), (12, 25)):
        base = [word() for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, max(1, words // 40))):
                own[rng.randrange(words)] = word()
            docs.append((n, " ".join(own)))
            n += 1
            if rng.random() < 0.2:
                docs.append((n, docs[-1][1]))
                n += 1
    docs += [(n + k, " ".join(word() for _ in range(30))) for k in range(40)] + [(n + 50, ""), (n + 51, None), (n + 52, " \n"), (n + 53, "one two")]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("block", [384, 7])
@pytest.mark.parametrize("how", [ngram_join.join, fingerprints.near_duplicates])
def test_no_link_is_lost(spark, planted, block, how, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK_TEXTS", block)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in planted], "doc_id long, text string, digest string, n int").repartition(4)
    rows = how(df).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in rows} == brute(planted)
    assert len(rows) == len(planted)


def test_odd_documents(odd, nothing):
    rows = ngram_join.join(odd).collect()
    assert len(rows) == odd.count()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert [(r.class_id, r.n_links) for r in by[1] + by[2]] == [(1, 2)] * 3
    assert all(r.class_id is None and r.n_links == 0 for r in by[None])
    assert by[4][0].class_id == by[5][0].class_id == 3  # without words
    assert ngram_join.join(nothing).count() == 0


def test_one_of_each_class_stays(odd, nothing):
    out = ngram_join.deduplicate(odd)
    assert out.schema.names == odd.schema.names
    assert Counter(r.doc_id for r in out.collect()) == Counter([None, None, 1, 3, 6, 7, 8, 9, -10])
    assert ngram_join.deduplicate(nothing).count() == 0


def test_pruning_thresholds():
    least = similar.least_matches(0.8)
    assert least == sorted(least)
    assert 0 < least[0] < 32 * 0.8
    assert similar.least_matches(0.8, 1e-3)[0] > least[0]


def test_components_of_a_path_and_a_hub(spark):
    from framewright.llm.graph import components

    edges = [(i, i + 1) for i in range(50)] + [(100, 200 + i) for i in range(60)] + [(7, 7), (300, 301), (301, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, **{200 + i: 100 for i in range(60)}, 300: 300, 301: 300}


def test_unlike_texts_of_a_repeated_id_both_stay(spark):
    x, y = ("%s " % " ".join(f"{c}{i}" for i in range(40)) for c in "xy")
    docs = [(2, x), (2, y), (2, y), (3, x), (4, y + "more"), (5, "alone")]
    kept = ngram_join.deduplicate(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(2, x), (2, y), (5, "alone")]


@pytest.mark.parametrize("how", [ngram_join.join, fingerprints.near_duplicates])
def test_links_at_a_low_threshold_are_not_lost(spark, how):
    # 60 pairs of similarity 0.5: 64 common shingles of 128
    docs = [(2 * k + side, " ".join([f"w{k}x{i}" for i in range(68)] + [f"w{k}y{side}z{i}" for i in range(32)])) for k in range(60) for side in (0, 1)]
    rows = how(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), threshold=0.5).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in rows} == {i: (i - i % 2, 1) for i, _ in docs}


def test_bands_follow_the_threshold(spark):
    assert similar.banding_for(0.8) == similar.banding_for(0.95) == (similar.BANDS, similar.ROWS)
    for t in (0.05, 0.2, 0.5, 0.6, 0.7, 0.79, 0.8, 1.0):
        bands, rows = similar.banding_for(t)
        assert (1 - t**rows) ** bands <= similar.MISSED
    for t in (0, -1, 1.1):
        with pytest.raises(ValueError, match="threshold"):
            similar.banding_for(t)


def test_weak_links_make_no_clusters(spark, monkeypatch):
    # 400 texts, each alike to the next by about 0.4: many share a band, none is sent to be verified
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    parts = [[word() for _ in range(40)] for _ in range(401)]
    docs = [(k, " ".join(parts[k] + parts[k + 1] + parts[k][:30])) for k in range(400)]
    sent, write = [], similar.materialise

    def noted(df, tag):
        out = write(df, tag)
        if tag in ("buckets", "members"):
            sent.append((tag, out.count()))
        return out

    monkeypatch.setattr(similar, "materialise", noted)
    rows = ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert all(r.n_links == 0 and r.class_id == r.doc_id for r in rows)
    assert dict(sent)["buckets"] > 20
    assert dict(sent)["members"] == 0


def test_reached_follows_chains_and_keeps_sizes_apart():
    signs = similar.np.zeros((6, similar.COMPARED), similar.np.uint8)
    for k in range(6):
        signs[k, : 20 * k] = 1  # neighbours differ in 20 of 128 places
    size = similar.np.array([10, 10, 10, 10, 10, 5])
    least = similar.least_matches(0.8)
    assert similar.reached(signs, size, 0.8, least).tolist() == [0, 0, 0, 0, 0, 5]
    assert similar.reached(signs[[0, 5]], size[[0, 0]], 0.8, least).tolist() == [0, 1]
