import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from framewright.llm import language_id, toxicity
from framewright.llm.trees import BoostedTrees, Isotonic

DATA = "/root/testdata/sf0.01"


def test_trees_learn_a_rule_that_is_not_linear():
    x = np.random.RandomState(0).rand(2000, 3)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = BoostedTrees().fit(x[:1500], y[:1500])
    assert (((m.margin(x[1500:]) > 0) == y[1500:]).mean()) > 0.95


def test_isotonic_is_monotone_and_calibrated():
    rng = np.random.RandomState(1)
    s = rng.rand(5000)
    y = (rng.rand(5000) < s**2).astype(float)
    out = Isotonic().fit(s, y)(np.linspace(0, 1, 50))
    assert (np.diff(out) >= 0).all()
    assert abs(out[25] - 0.26) < 0.1


def test_toxicity_of_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(p == t for p, t in held) / len(held) > 0.93
    assert sum(p and not t for p, t in held) <= 1


def test_toxicity_of_odd_documents(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    rows = toxicity.classify(odd, labels).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r.score <= 1 for r in rows)
    assert toxicity.classify(nothing, labels).count() == 0
    assert toxicity.classify(odd, labels.where("false")).count() == odd.count()


def test_obfuscated_insults_count():
    plain, hidden = (toxicity.Extractor({"=idiot": 5.0})(t) for t in ("you are an idiot", "you are an 1d1ot"))
    at = toxicity.FEATURES.index
    assert plain[at("hits")] > 0
    assert hidden[at("hidden_hits")] > 0
    assert plain[at("near_second_person")] == 1.0


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = language_id.identify(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_language_of_odd_documents(odd, nothing):
    rows = language_id.identify(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (3, 4, 5, 9))
    assert language_id.identify(nothing).count() == 0


def test_unseen_words_back_off_to_shorter_grams():
    m = language_id.Model(["the thing and the thinking"] * 5 + ["der schuh und die schule"] * 5, ["en"] * 5 + ["de"] * 5)
    assert "thinks" not in m.words
    assert language_id.Scorer(m)("thinks")[0] == "en"
    assert language_id.Scorer(m)("schulen")[0] == "de"


def test_letters_and_marks(spark):
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(["½ ² ① Ⅷ", "hello there world"] * 10)], "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in language_id.identify(docs).collect()}
    assert {found[k] for k in range(0, 20, 2)} == {"und"}
    assert {found[k] for k in range(1, 20, 2)} == {"en"}
    assert language_id.LETTERS.findall("हिन्दी भाषा x1y") == ["हिन्दी", "भाषा", "x", "y"]


def plain_language(train, text):
    """Word-first backoff in plain loops: the predicted language and its probability."""
    langs = sorted({x for _, x in train})
    words = {x: Counter(w for t, y in train if y == x for w in language_id.LETTERS.findall(t.lower())) for x in langs}
    grams = {x: Counter() for x in langs}
    for x in langs:
        for w, n in words[x].items():
            for k in range(1, 6):
                for i in range(len(w) + 3 - k):
                    grams[x][f" {w} "[i : i + k]] += min(n, 50)
    known = lambda table, key: sum(table[x][key] for x in langs) >= 3

    def log(table, x, key, size):
        return math.log((table[x][key] + 0.3) / (sum(n for g, n in table[x].items() if size is None or len(g) == size) + 1))

    total = dict.fromkeys(langs, 0.0)
    for w in language_id.LETTERS.findall(text.lower()):
        if known(words, w):
            for x in langs:
                total[x] += log(words, x, w, None)
            continue
        padded, picked = f" {w} ", []
        for end in range(2, len(padded) + 1):
            picked += [padded[end - k : end] for k in range(min(5, end), 0, -1) if known(grams, padded[end - k : end])][:1]
        for x in langs if picked else ():
            total[x] += sum(log(grams, x, g, len(g)) for g in picked) / len(picked)
    best = max(langs, key=lambda x: total[x])
    return best, 1 / sum(math.exp(v - total[best]) for v in total.values())


def test_language_against_plain_loops():
    train = [("the thing and the thinking of things", "en")] * 3 + [("der schuh und die schule des dings", "de")] * 3 + [("la chose et le soulier", "fr")] * 2
    score = language_id.Scorer(language_id.Model(*map(list, zip(*train, strict=True))))
    for text in ("the thing", "thinker schulen", "soulier le xyz", "une chose der Dinge", "des", "qqq"):
        best, p = plain_language(train, text)
        got = score(text)
        assert got[0] == best
        assert got[1] == pytest.approx(p, abs=1e-4)


def backed_off(grams, rows, langs, word):
    """The mean of the rows of the longest known n-grams, word by word."""
    padded, found = f" {word} ", []
    for end in range(2, len(padded) + 1):
        found += [grams[padded[end - k : end]] for k in range(min(5, end), 0, -1) if padded[end - k : end] in grams][:1]
    return rows[found].mean(0) if found else np.zeros(langs, np.float32)


def some_language_model(rng):
    words = ["".join(rng.choice(list(letters), rng.randint(1, 9))) for letters in ("etaoinshr", "etaoünßch", "привет") for _ in range(1500)]
    counted = Counter()
    for x in range(3):
        for w, n in Counter(words[1500 * x : 1500 * x + 1500]).items():
            for k in range(1, 6):
                for i in range(len(w) + 3 - k):
                    counted[f" {w} "[i : i + k]] += min(n, 50)
    grams = {g: i for i, g in enumerate(sorted(g for g, n in counted.items() if n >= 3))}
    return language_id.Model([" ".join(words[1500 * x : 1500 * x + 1500]) for x in range(3)], ["en", "de", "ru"]), grams


def test_languages_in_batches_are_those_of_word_by_word(monkeypatch):
    monkeypatch.setattr(language_id.Scorer, "TOKENS", 40)
    monkeypatch.setattr(language_id, "CELLS", 60)
    rng = np.random.RandomState(3)
    model, grams = some_language_model(rng)
    texts = ["\n".join("".join(rng.choice(list("etaoüßhпривет漢-'. \u2028\u0085\x1c\u3000\t"), 40)) for _ in range(rng.randint(0, 9))) for _ in range(120)] + ["", None, "\n\n", "12 .", "漢漢", "İ ΟΔΟΣ", "e" * 300]
    score = language_id.Scorer(model)
    found = [x for i in range(0, len(texts), 30) for x in zip(*score.batch(language_id.pa.array(texts[i : i + 30])), strict=True)]
    for text, (lang, p) in zip(texts, found, strict=True):
        words = language_id.LETTERS.findall((text or "").lower())
        total = sum((model.word_rows[model.words[w]] if w in model.words else backed_off(grams, model.gram_rows, 3, w)).astype(float) for w in words)
        assert (lang, p) == (("und", 0.0) if not words else (model.langs[int(total.argmax())], pytest.approx(1 / np.exp(total - total.max()).sum(), rel=1e-5)))


def test_unseen_words_take_far_less_time_than_one_by_one():
    rng = np.random.RandomState(4)
    model, grams = some_language_model(rng)
    words = list({"".join(w) for w in rng.choice(list("etaoinshrü"), (30_000, 10))})

    def seconds(f) -> float:
        began = time.process_time()
        f()
        return time.process_time() - began

    score = language_id.Scorer(model)
    assert seconds(lambda: score(" ".join(words))) < 0.5 * seconds(lambda: [backed_off(grams, model.gram_rows, 3, w) for w in words])


def plain_features(text, lexicon):
    """FEATURES of a text in plain loops."""
    words, rows = text.split(), []
    weigh = lambda c: max([lexicon.get(x, 0.0) for x in ["=" + c, *(c[:n] for n in (3, 4, 5, 6, 7) if len(c) > n)]])
    for w in words:
        core = re.sub(r"^\W+|\W+$", "", w.lower())
        plain = re.sub(r"(.)\1{2,}", r"\1", re.sub(r"[\W_]+", "", core.translate(str.maketrans("013457@$!|", "oieastasii")))) if core and (not core.isalpha() or re.search(r"(.)\1\1", core)) else core
        letters = sum(c.isalpha() for c in w)
        rows.append({
            "insult": core in toxicity.INSULTS or (plain in toxicity.INSULTS and letters > 0), "weight": weigh(core) if core else 0.0, "hidden": weigh(plain) if plain and plain != core and letters else 0.0,
            "second": core in toxicity.SECOND_PERSON, "letters": letters, "upper": sum(c.isupper() for c in w),
        })
    n = len(words)
    hit = [k for k, r in enumerate(rows) if max(r["weight"], r["hidden"]) > 0 or r["insult"]]
    second = [k for k, r in enumerate(rows) if r["second"]]
    return {
        "insult_density": sum(r["insult"] for r in rows) / n, "hit_density": len(hit) / n, "weight_density": sum(max(r["weight"], r["hidden"]) for r in rows) / n, "hits": math.log1p(len(hit)),
        "hidden_hits": math.log1p(sum(r["hidden"] > r["weight"] for r in rows)), "near_second_person": sum(any(abs(s - h) <= 5 for s in second) for h in hit) / len(hit) if hit else 0.0,
        "second_person_density": len(second) / n, "capitals": sum(r["upper"] for r in rows) / max(1, sum(r["letters"] for r in rows)), "punctuation": sum(not c.isalnum() for w in words for c in w) / sum(map(len, words)),
        "exclamations": sum(c in "!?" for w in words for c in w) / n, "words": math.log1p(n), "word_length": sum(map(len, words)) / n,
    }


def test_toxicity_against_plain_loops():
    docs = ["you are an idiot, really", "YOU 1d1ot!!! go away you m0r0n", "a calm text about trees", "stuuupid people, and your friends", "tu es un imbécile ?", "x"] * 8
    toxic = np.array([1, 1, 0, 1, 1, 0] * 8, float)
    model = toxicity.Model(docs, toxic)
    extract = toxicity.Extractor(model.lexicon)
    for text in docs[:6] + ["you worthless fool", "idiotic trees of yours", "ÜBER all1 you"]:
        x = extract(text)
        for name, value in plain_features(text, model.lexicon).items():
            assert x[toxicity.FEATURES.index(name)] == pytest.approx(value, rel=1e-5), name
        margin = model.trees.base  # the trees, node by node
        for feature, threshold, value in model.trees.trees:
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(x[feature[node]] > threshold[node])
            margin += value[node - len(feature)]
        at, to = model.calibrate.at, model.calibrate.to
        k = int(np.searchsorted(at, margin))
        wanted = to[0] if k == 0 else to[-1] if k == len(at) else to[k - 1] + (to[k] - to[k - 1]) * (margin - at[k - 1]) / (at[k] - at[k - 1])
        assert model.score(x[None])[0] == pytest.approx(min(max(wanted, 0), 1), abs=1e-9)


@pytest.mark.parametrize("keep", ["toxicity", "language"])
def test_filters_keep_all_columns(spark, odd, keep):
    if keep == "toxicity":
        out = toxicity.keep(odd, toxicity.train(odd, spark.createDataFrame([(1, 0)], "doc_id long, toxic int")))
        assert out.count() == odd.count()
    else:
        out = language_id.keep(odd, language_id.train(odd))
        assert {r.doc_id for r in out.collect()}.isdisjoint({3, 4, 5, 9})
    assert out.schema.names == odd.schema.names
