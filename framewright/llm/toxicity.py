"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon holds a short list of common insults and terms learnt from the labelled rows: words, and beginnings of words
(for compounds), that mark toxic documents with statistical significance. A document's features are densities of lexicon
hits, their nearness to second-person words, and rates of capitals, punctuation and obfuscation. Features of training rows
use a lexicon learnt without their own fold, and calibration uses trees that haven't seen the row, so that neither
flatters itself. Trees are fitted on at most FIT_ROWS labelled rows; scores cover every whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import WordHash, arrow_map, batch, fit_in_task, held_out, minhash, permutations, shingles
from framewright.llm.trees import BoostedTrees, Isotonic

#: Labelled rows that the model is fitted on, at most.
FIT_ROWS = 8_000
FOLDS = 4
#: Score from which a document counts as toxic.
THRESHOLD = 0.7
# Common insults of the four languages, a starting point for the lexicon.
INSULTS = """idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown dumb imbecile bastard
idiotisch dumm dumme blöd trottel abschaum idiota imbécil estúpido estúpida tonto basura asqueroso connard imbécile stupide ordure""".split()
SECOND_PERSON = """you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos
tú ti usted ustedes vosotros vuestro""".split()
#: Characters often put in place of letters.
LEET = str.maketrans("013457@$!|", "oieastasii")
BEGINNINGS = (3, 4, 5, 6, 7)
#: Words between a hit and a second-person word that count as near.
NEAR = 5
LEAST_DOCS, LEAST_Z, LEAST_WEIGHT = 3, 3.7, math.log(8)
FEATURES = (
    "insult_density", "hit_density", "weight_density", "top_weight", "hits", "hidden_hits", "near_second_person", "second_person_density", "capitals",
    "capital_words", "punctuation", "exclamations", "runs", "obfuscated", "elongated", "words", "word_length",
)
SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _core(word: str) -> str:
    return re.sub(r"^\W+|\W+$", "", word.lower())


def _plain(core: str) -> str:
    """A word without obfuscation: look-alikes replaced, separators and repeated letters removed."""
    return re.sub(r"(.)\1{2,}", r"\1", re.sub(r"[\W_]+", "", core.translate(LEET)))


def terms(core: str) -> list[str]:
    """What the lexicon can hold of a word: itself (with a leading =) and its beginnings."""
    return ["=" + core, *(core[:n] for n in BEGINNINGS if len(core) > n)]


def first_of_copies(texts: list[str]) -> np.ndarray:
    """False for texts whose shingles have the same two minima as earlier ones: copies would count as evidence again and again."""
    hashed, (a, b), seen, out = WordHash(), permutations(2, seed=5), (set(), set()), np.ones(len(texts), bool)
    for i, t in enumerate(texts):
        own = minhash(shingles(hashed(t.split())), a, b).tolist()
        out[i] = not all(x in s for x, s in zip(own, seen, strict=True))
        for x, s in zip(own, seen, strict=True):
            s.add(x)
    return out


class TermCounts:
    """Document frequencies of terms by fold, of those found in LEAST_DOCS toxic documents or more."""

    def __init__(self, texts: list[str], toxic: np.ndarray, fold: np.ndarray) -> None:
        self.known: dict[str, tuple[str, ...]] = {}
        use = first_of_copies(texts)
        self.docs = [[int((use & (fold == k) & (toxic == y)).sum()) for y in (0, 1)] for k in range(FOLDS)]
        self.counts = [[Counter(), Counter()] for _ in range(FOLDS)]
        rows = [(t, int(y), int(k)) for t, y, k, u in zip(texts, toxic, fold, use, strict=True) if u]
        for t, y, k in rows:
            if y:
                self.counts[k][1].update(self._terms(t))
        total = sum((c[1] for c in self.counts), Counter())
        self.candidates = {x for x, n in total.items() if n >= LEAST_DOCS}
        self.known = {w: tuple(x for x in own if x in self.candidates) for w, own in self.known.items()}
        for t, y, k in rows:
            if not y:
                self.counts[k][0].update(self._terms(t))

    def _terms(self, text: str) -> set[str]:
        words, known = set(text.split()), self.known
        if len(known) > 500_000:
            known.clear()
        for w in words.difference(known):
            core = _core(w)
            own = terms(core) if core else ()
            known[w] = tuple(x for x in own if x in self.candidates) if hasattr(self, "candidates") else tuple(own)
        return {x for w in words for x in known[w]}

    def lexicon(self, without: int | None = None) -> dict[str, float]:
        """Terms with their log ratio of document frequencies, of those that mark toxic documents significantly."""
        folds = [k for k in range(FOLDS) if k != without]
        m, n = (sum(self.docs[k][y] for k in folds) for y in (0, 1))
        out = {}
        for t in self.candidates:
            y, x = (sum(self.counts[k][i][t] for k in folds) for i in (0, 1))
            if x < LEAST_DOCS:
                continue
            weight = math.log((x + 0.5) / (n + 1) / ((y + 0.5) / (m + 1)))
            r = (x + y) / (n + m)
            g = 2 * sum(v * math.log(v / e) for v, e in ((x, n * r), (n - x, n * (1 - r)), (y, m * r), (m - y, m * (1 - r))) if v > 0 and e > 0)
            if weight >= LEAST_WEIGHT and math.sqrt(max(g, 0)) >= LEAST_Z:
                out[t] = weight
        return out


class Extractor:
    """Features of texts; what a word contributes is kept in a table of bounded size."""

    WORDS = 300_000
    #: Contributions: insult, weight, hidden weight, second person, letters, capitals, capital word, punctuation, exclamation, run, obfuscated, elongated, length.
    WIDTH = 13

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon, self.insults, self.second = lexicon, set(INSULTS), set(SECOND_PERSON)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, self.WIDTH), np.float32)

    def _weight(self, core: str) -> float:
        return max((self.lexicon.get(x, 0.0) for x in terms(core)), default=0.0)

    def _word(self, w: str) -> tuple:
        core = _core(w)
        letters = sum(map(str.isalpha, w))
        weight = self._weight(core) if core else 0.0
        plain = _plain(core) if core and (not core.isalpha() or re.search(r"(.)\1\1", core)) else core
        hidden = self._weight(plain) if plain and plain != core and letters else 0.0
        insult = core in self.insults or (plain in self.insults and letters > 0)
        upper = sum(map(str.isupper, w))
        punctuation = sum(not c.isalnum() for c in w)
        return (
            insult, weight, hidden, core in self.second, letters, upper, letters > 1 and upper == letters, punctuation, w.count("!") + w.count("?"),
            bool(re.search(r"[!?.*#&%$]{2}", w)), letters > 0 and bool(core) and not core.isalpha(), bool(re.search(r"([^\W\d])\1\1", core)), len(w),
        )

    def __call__(self, text: str) -> np.ndarray:
        words, known = text.split(), self.known
        if not words:
            return np.zeros(len(FEATURES), np.float32)
        if len(known) > self.WORDS:
            self._clear()
            known = self.known
        for w in set(words).difference(known):
            i = known[w] = len(known)
            if i >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[i] = self._word(w)
        rows = self.table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]
        n, total = len(words), rows.sum(0, dtype=np.float64)
        weight = np.maximum(rows[:, 1], rows[:, 2])
        hits, second = np.flatnonzero((weight > 0) | (rows[:, 0] > 0)), np.flatnonzero(rows[:, 3])
        near = 0.0
        if len(hits) and len(second):
            at = np.searchsorted(second, hits)
            gap = np.minimum(np.abs(second[np.minimum(at, len(second) - 1)] - hits), np.abs(second[np.maximum(at - 1, 0)] - hits))
            near = float((gap <= NEAR).mean())
        return np.array([
            total[0] / n, len(hits) / n, weight.sum() / n, weight.max(), math.log1p(len(hits)), math.log1p((rows[:, 2] > rows[:, 1]).sum()), near, total[3] / n, total[5] / max(total[4], 1),
            total[6] / n, total[7] / total[12], total[8] / n, total[9] / n, total[10] / n, total[11] / n, math.log1p(n), total[12] / n,
        ], np.float32)


class Model:
    """Lexicon, trees and calibration; `constant` where the labels were of one kind only, or none."""

    def __init__(self, texts: list[str], toxic: np.ndarray) -> None:
        self.constant, self.lexicon = (float(toxic.mean()) if len(toxic) else 0.0), {}
        if len(set(toxic.tolist())) < 2 or len(toxic) < 2 * FOLDS:
            return
        fold = np.zeros(len(toxic), np.int64)
        for y in (0, 1):
            fold[toxic == y] = np.arange((toxic == y).sum()) % FOLDS
        counts = TermCounts(texts, toxic, fold)
        x = np.zeros((len(texts), len(FEATURES)), np.float32)
        for k in range(FOLDS):
            out = fold == k
            extract = Extractor(counts.lexicon(without=k))
            for i in np.flatnonzero(out):
                x[i] = extract(texts[i])
        margin = np.zeros(len(texts))
        for k in range(FOLDS):
            margin[fold == k] = BoostedTrees().fit(x[fold != k], toxic[fold != k]).margin(x[fold == k])
        self.calibrate = Isotonic().fit(margin, toxic)
        self.trees, self.lexicon, self.constant = BoostedTrees().fit(x, toxic), counts.lexicon(), None

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.constant) if self.constant is not None else self.calibrate(self.trees.margin(x))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS) -> Model:
    """A model from at most `rows` labelled documents outside the held-out fold (crc32 of the id modulo 3 is 1).

    Null labels and ids are left out, repeated labels of an id count as toxic if one does. The label sample, at most
    `rows` ids, is broadcast to the documents' scan.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).where(~held_out(doc_id, 3, 1)).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    total = known.count()
    if total > rows:
        known = known.where(F.xxhash64("doc_id") >= F.lit((1 << 63) - 1 - int((1 << 64) * rows / total)))
    drawn = F.broadcast(known.limit(rows))
    sample = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).join(drawn, "doc_id").select("doc_id", "t", "y").limit(rows)

    def fit(table: pa.Table) -> Model:
        table = table.sort_by([("doc_id", "ascending"), ("t", "ascending")])
        return Model([t or "" for t in table.column("t").to_pylist()], np.array(table.column("y").to_pylist(), np.float64))

    return fit_in_task(sample, fit)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score of every row. Null and empty texts, and words unlike any in training, get what the trees give to no hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = Extractor(model.lexicon)
        for b in batches:
            if b.num_rows:
                yield batch(SCORED, b.column(0), model.score(np.stack([extract(t or "") for t in b.column(1).to_pylist()])))

    return arrow_map(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of documents; empty tables give an empty result."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, in all their columns, whose score is below the threshold; scored in the same pass over the rows.

    Null and empty texts are scored as texts without hits; null ids and repeated rows stay as they are; long texts are read whole.
    """
    names = docs.columns
    where = {c: names.index(c) for c in ("text",)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = Extractor(model.lexicon)
        for b in batches:
            if b.num_rows:
                fine = model.score(np.stack([extract(t or "") for t in b.column(where["text"]).to_pylist()])) < threshold
                yield b.filter(pa.array(fine))

    return arrow_map(docs, run, docs.schema)
