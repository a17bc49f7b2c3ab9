"""Language ID by word-first backoff.

A word that training knows is scored by its log frequency in each language. A word it doesn't know falls back to its
character 5-grams, then 4-, 3-, 2- and 1-grams: each character position is scored by the longest n-gram known there,
averaged over the word. A document's language has the largest sum over its words.

Words are runs of letters (Unicode category L) with the combining marks among them. A word counts SPELLINGS times at most
in the n-grams, so that a few frequent words don't stand for a language's spelling.

The model is fitted on about FIT_DOCS documents of each of the LANGUAGES most frequent languages, in one task; predictions
cover every whole text. Training texts that are null, or whose language is null, are left out. Texts that are null or have
no letter are `und`, as all texts are where nothing was learnt. Ties go to the language that sorts first. Repeated rows are
predicted each; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import arrow_map, batch, fit_in_task, held_out

#: Training documents of a language, about, and languages, at most.
FIT_DOCS, LANGUAGES = 1_500, 500
#: Occurrences of a word that count for its n-grams, at most.
SPELLINGS = 50
#: Occurrences from which a word or an n-gram is known.
LEAST_WORD, LEAST_GRAM = 3, 3
ORDER = 5
#: Below this probability a document is not taken as written in the predicted language.
LEAST_SCORE = 0.5
UNKNOWN = "und"
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
WORDS = regex.compile(rf"\n|{LETTERS.pattern}")
#: Values by language that are gathered at once, about.
CELLS = 1 << 22
#: Bytes of texts that are scored at once, on average.
TEXT_BYTES = 4 << 20
PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


class Model:
    """Log frequencies of words and character n-grams by language, as rows of a matrix."""

    def __init__(self, texts: list[str], langs: list[str]) -> None:
        self.langs = sorted(set(langs))
        words: dict[str, Counter] = {x: Counter() for x in self.langs}
        for t, x in zip(texts, langs, strict=True):
            words[x].update(LETTERS.findall(t.lower()))
        grams: dict[str, Counter] = {x: Counter() for x in self.langs}
        for x, own in words.items():
            for w, n in own.items():
                n = min(n, SPELLINGS)
                padded = f" {w} "
                for k in range(1, ORDER + 1):
                    for i in range(len(padded) - k + 1):
                        grams[x][padded[i : i + k]] += n
        self.words, self.word_rows = self._rows(words, LEAST_WORD, lambda _: 0)
        known, self.gram_rows = self._rows(grams, LEAST_GRAM, len)
        self.grams = _spelled(known)

    def _rows(self, counts: dict[str, Counter], least: int, kind) -> tuple[dict[str, int], np.ndarray]:
        """Keys of `least` occurrences or more in all, and their smoothed log frequency among keys of the same kind."""
        total = sum(counts.values(), Counter())
        index = {k: i for i, k in enumerate(sorted(k for k, n in total.items() if n >= least))}
        table = np.zeros((len(index), len(self.langs)))
        sums = np.zeros((ORDER + 1, len(self.langs)))
        for j, x in enumerate(self.langs):
            for k, n in counts[x].items():
                sums[kind(k), j] += n
                if k in index:
                    table[index[k], j] = n
        kinds = np.array([kind(k) for k in index], np.int64)
        return index, np.log((table + 0.3) / (sums[kinds] + 1)).astype(np.float32) if len(index) else table.astype(np.float32)


def _spelled(grams: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Known characters and their rows; longer n-grams, each as the row of what precedes its last character and that one's number, and their rows."""
    chars = sorted(ord(g) for g in grams if len(g) == 1)
    number = {chr(c): i for i, c in enumerate(chars)}
    longer = {grams[g[:-1]] * (len(chars) + 1) + number[g[-1]]: j for g, j in grams.items() if len(g) > 1}
    first = [grams[chr(c)] for c in chars]
    return np.array(chars, np.uint32), np.array(first, np.int32), np.fromiter(longer, np.int64, len(longer)), np.fromiter(longer.values(), np.int32, len(longer))


class Spelling:
    """Finds the rows of n-grams at all characters of a text at once, in arrays that are hashed by `_spelled`'s keys.

    An n-gram is known only if what precedes its last character is. So those that end at a character are found from the shorter
    ones that end before it, one order after the other.
    """

    MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, chars: np.ndarray, first: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> None:
        self.codes, self.first = np.append(chars, np.uint32(0xFFFFFFFF)), np.append(first, np.int32(-1))  # the last stands for unknown characters
        self.bits = max(4, (4 * len(keys)).bit_length())  # a quarter of the slots is taken, at most
        self.keys, self.rows = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        at = self._slots(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            won = self.keys[at] == keys
            self.rows[at[won]] = rows[won]
            keys, rows, at = keys[~won], rows[~won], (at[~won] + 1) & (len(self.keys) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * self.MULTIPLIER) >> np.uint64(64 - self.bits)).view(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        at, left, out = self._slots(keys), np.arange(len(keys)), np.full(len(keys), -1, np.int32)
        while len(left):
            there = self.keys[at]
            same = there == keys[left]
            out[left[same]] = self.rows[at[same]]
            go = ~same & (there >= 0)
            left, at = left[go], (at[go] + 1) & (len(self.keys) - 1)
        return out

    def longest(self, text: str, place: np.ndarray) -> np.ndarray:
        """The row of the longest known n-gram that ends at each character and begins in its word, -1 if there is none. place: that of each character in its padded word."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = np.searchsorted(self.codes, codes)
        chars[self.codes[chars] != codes] = len(self.codes) - 1
        best = shorter = self.first[chars]
        for k in range(2, ORDER + 1):
            ends = np.flatnonzero((place[1:] >= k - 1) & (shorter[:-1] >= 0)) + 1
            longer = np.full(len(chars), -1, np.int32)
            longer[ends] = self._find(shorter[ends - 1].astype(np.int64) * len(self.codes) + chars[ends])
            best = np.where(longer >= 0, longer, best)
            shorter = longer
        return best


class Scorer:
    """Scores texts, those of a batch at once; what a token contributes is kept in a table of bounded size."""

    TOKENS = 300_000

    def __init__(self, model: Model) -> None:
        self.model = model
        self.spelling = Spelling(*model.grams)
        self._clear()

    def _clear(self) -> None:
        self.known = pa.array([], pa.string())
        self.table = np.zeros((0, len(self.model.langs) + 1), np.float32)  # and the number of words

    def __call__(self, text: str) -> tuple[str, float]:
        (best,), (score,) = self.batch(pa.array([text], pa.string()))
        return best, score

    def batch(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        """The language and score of each text; null counts as empty."""
        langs = self.model.langs
        if not langs or not len(texts):
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        tokens = pc.utf8_split_whitespace(texts.cast(pa.string()).fill_null(""))
        own = np.repeat(np.arange(len(texts)), np.diff(tokens.offsets.to_numpy()))
        found = tokens.flatten().dictionary_encode()
        rows, at = self._rows(found.dictionary), found.indices.to_numpy()
        total = np.empty((len(texts), len(langs) + 1))
        for j in range(len(langs) + 1):
            total[:, j] = np.bincount(own, self.table[rows, j][at], len(texts))
        likely, worded = total[:, :-1], total[:, -1] > 0
        best = likely.argmax(1)
        score = 1 / np.exp(likely - likely[np.arange(len(texts)), best][:, None]).sum(1)
        return [langs[k] if w else UNKNOWN for k, w in zip(best.tolist(), worded.tolist(), strict=True)], np.where(worded, score, 0.0).tolist()

    def _rows(self, tokens: pa.Array) -> np.ndarray:
        """The places of distinct tokens in the table."""
        if len(self.known) > self.TOKENS:
            self._clear()
        rows = pc.fill_null(pc.index_in(tokens, self.known), -1).to_numpy().astype(np.int64)
        new = tokens.filter(pa.array(rows < 0))
        if len(new):
            rows[rows < 0] = np.arange(len(self.known), len(self.known) + len(new))
            self.table = np.concatenate([self.table, self._contributions(new.to_pylist())])
            self.known = pa.concat_arrays([self.known, new])
        return rows

    def _contributions(self, tokens: list[str]) -> np.ndarray:
        """The sums of the log likelihoods of each token's words, and their number."""
        out = np.zeros((len(tokens), self.table.shape[1]), np.float32)
        found = WORDS.findall("\n".join(tokens).lower())  # no token has a line break, so each one found ends a token
        number = {w: i for i, w in enumerate(dict.fromkeys(["\n", *found]))}
        word = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
        token = np.cumsum(word == 0)[word > 0]
        word = word[word > 0] - 1
        values = self._likelihoods(list(number)[1:])
        step = max(1, CELLS // len(self.model.langs))
        for i in range(0, len(word), step):
            np.add.at(out[:, :-1], token[i : i + step], values[word[i : i + step]])
        out[:, -1] = np.bincount(token, minlength=len(tokens))
        return out

    def _likelihoods(self, words: list[str]) -> np.ndarray:
        """Log likelihoods of distinct lower-case words by language."""
        known = self.model.words
        at = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
        out = np.zeros((len(words), len(self.model.langs)), np.float32)
        out[at >= 0] = self.model.word_rows[at[at >= 0]]
        unseen = np.flatnonzero(at < 0)
        ends = np.cumsum([len(words[i]) + 2 for i in unseen])
        while len(unseen):
            n = max(1, int(np.searchsorted(ends, CELLS // len(self.model.langs), "right")))
            out[unseen[:n]] = self._backed_off([words[i] for i in unseen[:n]])
            unseen, ends = unseen[n:], ends[n:] - ends[n - 1]
        return out

    def _backed_off(self, words: list[str]) -> np.ndarray:
        """The means of the longest known n-grams that end at each character of the padded words but the first."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        best = self.spelling.longest("".join(f" {w} " for w in words), place)
        ends = np.flatnonzero((place > 0) & (best >= 0))
        own = np.repeat(np.arange(len(words)), sizes)[ends]
        out = np.zeros((len(words), len(self.model.langs)), np.float32)
        np.add.at(out, own, self.model.gram_rows[best[ends]])
        return out / np.maximum(np.bincount(own, minlength=len(words)), 1).astype(np.float32)[:, None]


def _scored(batches: Iterator[pa.RecordBatch], model: Model, text: int) -> Iterator[tuple[pa.RecordBatch, list[str], list[float]]]:
    """The rows in batches of about TEXT_BYTES, with the language and score of each; few large batches share more words than many small ones."""
    score, held = Scorer(model), []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= TEXT_BYTES:
            rows = pa.concat_batches(held)
            yield rows, *score.batch(rows.column(text))
            held = []
    if held:
        rows = pa.concat_batches(held)
        yield rows, *score.batch(rows.column(text))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = FIT_DOCS) -> Model:
    """A model from at most about `per_language` documents of each language outside the held-out fold (crc32 of the id modulo 4 is 2)."""
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("x")).where(~held_out("doc_id", 4, 2))
    rows = rows.where("t IS NOT NULL AND x IS NOT NULL")
    sizes = rows.groupBy("x").count().orderBy(F.desc("count"), "x").limit(LANGUAGES).collect()
    if not sizes:
        return Model([], [])
    # a row is drawn by its id's hash, in the share that its language needs; LANGUAGES rows at most are broadcast
    shares = docs.sparkSession.createDataFrame([(r["x"], -(1 << 63) + min((1 << 64) - 1, (1 << 64) * per_language // r["count"])) for r in sizes], "x string, below long")
    drawn = rows.join(F.broadcast(shares), "x").where(F.xxhash64("doc_id", F.lit("language")) <= F.col("below")).select("doc_id", "t", "x")

    def fit(table: pa.Table) -> Model:
        table = table.sort_by([("doc_id", "ascending"), ("t", "ascending")])
        return Model(table.column("t").to_pylist(), table.column("x").to_pylist())

    return fit_in_task(drawn.limit(2 * per_language * len(sizes)), fit)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, langs, scores in _scored(batches, model, 1):
            yield batch(PREDICTED, b.column(0), langs, scores)

    return arrow_map(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), run, "doc_id long, lang_pred string, score double", size=TEXT_BYTES)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of documents, learnt from the rows that aren't held out."""
    return predict(docs, train(docs)).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def keep(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """The documents, in all their columns, whose language is told with `least` probability or more.

    Null texts and those without a letter go; null ids and repeated rows stay as they are; long texts are read whole.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, langs, scores in _scored(batches, model, at):
            yield b.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(langs, scores, strict=True)], pa.bool_()))

    return arrow_map(docs, run, docs.schema, size=TEXT_BYTES)
