"""Language-model scoring by a weighted backoff automaton.

Tokens are ASCII-lower-cased runs of anything but ASCII white space, then one end token. Training counts every token and
every n-gram of every training document; none is cut off, at any size. The model interpolates by context counts:
* the unigram is (c + 0.5) / (N + 0.5 (V + 1)), which leaves one share to all unseen words;
* a word after a context that was seen C times has (1 - w(C)) c / C, and w(C) times what the shorter context gives it;
  w(C) = share * C ** -power (NEW) is the part of a context's followers that are new to it. Every context's distribution
  sums to one, whatever the counts.
As an automaton: seen contexts are states; a seen n-gram is an arc with its log probability; a state's failure arc leads
to the shorter context and bears log w(C). One left-to-right traversal carries each text's state and adds up weights.

Counting and scoring are one exchange, in two shuffles of packed binary pieces:
1. Texts are dealt to chunks of about CHUNK_TOKENS tokens. A chunk asks for the counts of its distinct n-grams, in sorted
   pieces of hashes (64 bits for words, see `gram_bits` for longer ones), one for each bucket (a range of hashes), with its
   own training counts. Its texts, as ranks of its words by frequency, travel along.
2. A bucket adds up the counts of all chunks and answers each chunk in the order of its question.
3. A chunk builds the part of the automaton that its texts can reach and traverses it.
A frequent n-gram is in each chunk's question once, so no key is hot. Nothing that grows with the corpus is sent to the
driver or broadcast; a task holds a bucket (about BUCKET_KEYS keys), a chunk, or one text if that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import arrow_map, batch, held_out, release

ORDER = 3
#: Share and power of w(C): for two words, and for longer n-grams.
NEW = ((0.9, 0.1), (0.8, 0.2))
#: The end token: no word has a space.
END = b" "
#: Stands before the first word; no word has spaces.
START = b"  "
CHUNK_TOKENS, BUCKET_KEYS = 1 << 20, 1_500_000
#: An unseen n-gram is taken for another one with a probability of 2 ** -CHANCE_BITS at most.
CHANCE_BITS = 20
#: Bytes of texts that are split into words at once, and words whose hashes a task keeps.
SPLIT_BYTES, WORDS = 1 << 20, 100_000
PIECE = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("words", pa.binary()), ("grams", pa.binary()), ("counts", pa.binary()), ("texts", pa.binary())])
PIECE_SCHEMA = "bucket int, chunk long, words binary, grams binary, counts binary, texts binary"
ANSWER = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary()), ("known", pa.binary()), ("counts", pa.binary()), ("texts", pa.binary())])
ANSWER_SCHEMA = "chunk long, bucket int, words binary, known binary, counts binary, texts binary"
TOTAL = pa.schema([("train_tokens", pa.int64()), ("vocabulary", pa.int64())])
SCORED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def tokens(text: str) -> list[bytes]:
    """The words of a text; bytes' own lower() and split() know ASCII alone."""
    return text.encode().lower().split()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def packed(x: np.ndarray) -> bytes:
    """Non-negative integers, in the planes of their bytes that aren't all zero, compressed."""
    planes = np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, : max(1, -(-int(x.max(initial=0)).bit_length() // 8))]
    return bytes([planes.shape[1]]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.T).tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<u8")[:, 0]


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys, by their gaps."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw), dtype=np.uint64)


def gram_bits(keys: int) -> int:
    """Bits of the hashes of n-grams of two words or more, of which there are at most `keys`."""
    return min(64, keys.bit_length() + CHANCE_BITS)


def bounds(keys: np.ndarray, buckets: int, bits: int = 64) -> np.ndarray:
    """Where each bucket starts among ascending keys of so many bits; the last bucket's end as well."""
    firsts = np.array([-(-(k << bits) // buckets) for k in range(buckets)], np.uint64)
    return np.append(np.searchsorted(keys, firsts), len(keys))


def _joined(context: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    m = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        x = (context ^ (context >> np.uint64(31))) * m + word * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(n)
        x = (x ^ (x >> np.uint64(29))) * m
        return x ^ (x >> np.uint64(32))


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with the inverse, in less memory."""
    order = np.argsort(x).astype(np.int32)
    x = x[order]
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    index = np.empty(len(x), np.int32)
    index[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return x[new], index


class Grams:
    """The n-grams of some texts, given as indices of ascending word hashes, with a start symbol before each text.

    words and keys: the distinct ones' hashes, ascending, of single words and of longer n-grams (shorter ones first, as
    the leading bits are n). at[n]: the places where an n-gram of n words ends. own[n]: its index at each such place, -1
    elsewhere; longer ones count on after the words.
    """

    def __init__(self, words: np.ndarray, index: np.ndarray, lengths: np.ndarray, order: int, bits: int) -> None:
        self.order, self.words, self.text = order, words, np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        place = np.arange(len(index), dtype=np.int32) - np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)
        self.at, self.own = {n: np.flatnonzero(place >= n - 1).astype(np.int32) for n in range(1, order + 1)}, {1: index.astype(np.int32)}
        word = last = words[index]
        tag, keys, begin = (order - 2).bit_length(), [], len(words)
        for n in range(2, order + 1):
            last = _joined(np.concatenate([last[:1], last[:-1]]), word, n)
            own, of = _distinct(last[self.at[n]] >> np.uint64(64 - bits + tag))
            self.own[n] = np.full(len(index), -1, np.int32)
            self.own[n][self.at[n]] = of + np.int32(begin)
            keys.append(own | np.uint64(n - 2) << np.uint64(bits - tag) if tag else own)
            begin += len(own)
        self.keys, self.spoken = np.concatenate(keys), self.at[2]

    def counts(self, weight: np.ndarray) -> np.ndarray:
        """Of words and keys, in texts of weight 1."""
        out = np.zeros(len(self.words) + len(self.keys), np.int64)
        for n, at in self.at.items():
            out += np.bincount(self.own[n][at], weight[self.text[at]], len(out)).astype(np.int64)
        return out


class Automaton:
    """The part of the model that the texts of `grams` can reach; states, arcs and failure arcs go by the keys' indices.

    arc[g]: log10 p of the n-gram's last word in the state of the others, nan where the model has no such arc.
    failure[g]: log10 w(C) of the state that the n-gram is, nan where it is none.
    """

    def __init__(self, grams: Grams, counts: np.ndarray, total: int, vocabulary: int) -> None:
        self.grams = grams
        counts = counts.astype(np.float64)
        self.unigram = np.log10((counts + 0.5) / (total + 0.5 * (vocabulary + 1)))
        self.arc, self.failure = np.full(len(counts), np.nan), np.full(len(counts), np.nan)
        lower = np.zeros(len(grams.text))  # p of the word at each place, after the context of n - 2 words
        lower[grams.spoken] = 10 ** self.unigram[grams.own[1][grams.spoken]]
        for n in range(2, grams.order + 1):
            share, power = NEW[min(n, len(NEW) + 1) - 2]
            at, g, h = grams.at[n], grams.own[n][grams.at[n]], grams.own[n - 1][grams.at[n] - 1]
            seen = counts[h] > 0
            at, g, h = at[seen], g[seen], h[seen]
            new = share * counts[h] ** -power
            lower[at] = (1 - new) * counts[g] / counts[h] + new * lower[at]
            self.failure[h] = np.log10(new)
            fine = counts[g] > 0
            self.arc[g[fine]] = np.log10(lower[at[fine]])

    def traverse(self) -> np.ndarray:
        """log10 p of every place's word, all texts going left to right at once.

        The state before a word is the longest seen context that ends there; a text's words take it from there by arcs
        and failure arcs, down to the unigram where no arc is left.
        """
        grams, out = self.grams, np.zeros(len(self.grams.text))
        open_ = np.zeros(len(out), bool)
        open_[grams.spoken] = True
        for n in range(grams.order, 1, -1):
            at = grams.at[n][open_[grams.at[n]]]
            state = grams.own[n - 1][at - 1]
            at, state = at[~np.isnan(self.failure[state])], state[~np.isnan(self.failure[state])]
            arc = self.arc[grams.own[n][at]]
            taken = ~np.isnan(arc)
            out[at] += np.where(taken, arc, self.failure[state])
            open_[at[taken]] = False
        rest = np.flatnonzero(open_)
        out[rest] += self.unigram[grams.own[1][rest]]
        return out


class Words:
    """Hashes of texts' words, kept for up to WORDS of them."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [[START, *tokens(t or ""), END] for t in texts]
        flat = [w for own in lists for w in own]
        if len(self.known) > WORDS:
            self.known.clear()
        missing = list(set(flat).difference(self.known))
        self.known.update(zip(missing, hashes(missing).tolist(), strict=True))
        return np.fromiter(map(self.known.__getitem__, flat), np.uint64, len(flat)), np.fromiter(map(len, lists), np.int64, len(lists))


def _pieces(chunk: int | None, words: np.ndarray, grams: np.ndarray, counts: np.ndarray, buckets: int, bits: int, texts: bytes | None) -> Iterator[pa.RecordBatch]:
    """A chunk's question: a piece for each bucket that it has keys of; the texts travel with one of them, another for each chunk."""
    at, to = bounds(words, buckets), bounds(grams, buckets, bits)
    own = np.flatnonzero(np.diff(at) + np.diff(to)).tolist()
    bearer = own[xxhash.xxh64_intdigest(str(chunk)) % len(own)]
    for i in range(0, len(own), 500):
        rows = []
        for k in own[i : i + 500]:
            w, g = slice(at[k], at[k + 1]), slice(to[k], to[k + 1])
            rows.append((k, chunk, packed_keys(words[w]), packed_keys(grams[g]), packed(np.concatenate([counts[w], counts[len(words) :][g]])), texts if k == bearer else None))
        yield batch(PIECE, *zip(*rows, strict=True))


def _ask(order: int, buckets: int, bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Questions of the chunks of a partition; rows that are not wanted (to be scored) only count."""
    words, chunk = Words(), TaskContext.get().partitionId() << 33  # a repeated task asks under the same numbers
    held: dict[bool, list] = {True: [], False: []}

    def out(wanted: bool) -> Iterator[pa.RecordBatch]:
        nonlocal chunk
        ids, learn, keys, lengths = zip(*held[wanted], strict=True)
        held[wanted].clear()
        vocabulary, index = _distinct(np.concatenate(keys))
        del keys
        lengths, texts = np.concatenate(lengths), None
        grams = Grams(vocabulary, index, lengths, order, bits)
        if wanted:
            frequency = np.bincount(index, minlength=len(vocabulary))
            ids = pa.concat_arrays(ids)
            parts = [packed(frequency), packed(np.argsort(_by_frequency(frequency))[index]), packed(lengths), ids.fill_null(0).to_numpy().astype("<i8").tobytes(), packed(ids.is_valid().to_numpy(zero_copy_only=False))]
            texts = b"".join(len(x).to_bytes(8, "little") + x for x in parts)
            chunk += 1
        yield from _pieces(chunk if wanted else None, vocabulary, grams.keys, grams.counts(np.concatenate(learn).astype(np.float64)), buckets, bits, texts)

    room = {True: 0, False: 0}
    for b in batches:
        flags = b.column("wanted").to_numpy(zero_copy_only=False)
        for wanted in (True, False):
            own = b.filter(pa.array(flags == wanted))
            if own.num_rows:
                keys, lengths = words(own.column("text").to_pylist())
                held[wanted].append((own.column("doc_id"), own.column("learn").to_numpy(zero_copy_only=False), keys, lengths))
                room[wanted] += len(keys)
                if room[wanted] >= CHUNK_TOKENS:
                    yield from out(wanted)
                    room[wanted] = 0
    for wanted in held:
        if held[wanted]:
            yield from out(wanted)


def _by_frequency(frequency: np.ndarray) -> np.ndarray:
    """A chunk's words, the most frequent first: their ranks take fewer bytes than their indices."""
    return np.argsort(-frequency, kind="stable")


def _answer(table: pa.Table) -> pa.Table:
    """A bucket's counts over all chunks, for each chunk in the order of its keys."""
    counts = [unpacked(x) for x in table.column("counts").to_pylist()]
    totals, at = [], np.zeros(len(counts), np.int64)
    for kind in ("words", "grams"):
        keys = [unpacked_keys(x) for x in table.column(kind).to_pylist()]
        index = np.unique(np.concatenate(keys), return_inverse=True)[1]
        sizes = np.array([len(k) for k in keys])
        own = np.concatenate([c[i : i + n] for c, i, n in zip(counts, at.tolist(), sizes.tolist(), strict=True)])
        totals.append(np.split(np.bincount(index, own).astype(np.int64)[index] if len(index) else index, np.cumsum(sizes)[:-1]))
        at += sizes
    out = []
    for chunk, bucket, words, texts, known, more in zip(*(table.column(c).to_pylist() for c in ("chunk", "bucket", "words", "texts")), *totals, strict=True):
        if chunk is not None:
            out.append((chunk, bucket, words, packed(known), packed(more), texts))
    release()
    return pa.Table.from_batches([batch(ANSWER, *zip(*out, strict=True))] if out else [], schema=ANSWER)


def _total(table: pa.Table) -> pa.Table:
    """A bucket's share of all training tokens and of the distinct ones."""
    keys = [unpacked_keys(x) for x in table.column("words").to_pylist()]
    counts = [unpacked(x)[: len(k)] for x, k in zip(table.column("counts").to_pylist(), keys, strict=True)]
    words, index = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.bincount(index, np.concatenate(counts), len(words)).astype(np.int64)
    counts[words == np.uint64(xxhash.xxh64_intdigest(START))] = 0
    return pa.Table.from_batches([batch(TOTAL, [int(counts.sum())], [int((counts > 0).sum())])])


def _texts(raw: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """doc_ids, indices of words and lengths of a chunk."""
    parts, at = [], 0
    while at < len(raw):
        size = int.from_bytes(raw[at : at + 8], "little")
        parts.append(raw[at + 8 : at + 8 + size])
        at += 8 + size
    by_frequency = _by_frequency(unpacked(parts[0]).astype(np.int64))
    return pa.array(np.frombuffer(parts[3], "<i8"), mask=unpacked(parts[4]) == 0), by_frequency[unpacked(parts[1]).astype(np.int64)], unpacked(parts[2]).astype(np.int64)


def score(docs: DataFrame, learn: Column | None = None, training: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of `docs`, by n-grams of up to `order` (2 or more) words.

    learn: which rows of `docs` to learn from, by default all; or training: a table of other rows to learn from instead.
    Null texts count as empty (the end token alone); without training documents all tokens are unseen and both scores
    are 0-count unigrams. Null ids stay null, repeated rows count and are scored each; other columns are not read; an
    empty table gives an empty result.
    """
    as_rows = lambda df, learns, wanted: df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), learns.alias("learn"), F.lit(wanted).alias("wanted"))
    if training is not None:
        rows = as_rows(docs, F.lit(False), True).unionAll(as_rows(training.withColumn(doc_id, F.lit(None)) if doc_id not in training.columns else training, F.lit(True), False))
    else:
        rows = as_rows(docs, F.coalesce(F.lit(True) if learn is None else learn, F.lit(False)), True)
    keys = (rows.agg(F.sum(F.octet_length("text") + 5)).first()[0] or 0) // 5 * order  # a word takes five bytes or more, nearly always
    buckets, bits = max(16, -(-keys // BUCKET_KEYS)), gram_bits(keys)

    def close(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")
        total, vocabulary = (table.column(c)[0].as_py() for c in TOTAL.names)
        words, known, more = (np.concatenate([f(x) for x in table.column(c).to_pylist()]) for c, f in (("words", unpacked_keys), ("known", unpacked), ("counts", unpacked)))
        ids, index, lengths = _texts(next(x for x in table.column("texts").to_pylist() if x is not None))
        grams, size = Grams(words, index, lengths, order, bits), len(lengths)
        if len(more) != len(grams.keys):
            raise ValueError("a chunk's answers don't fit its question")
        automaton = Automaton(grams, np.concatenate([known, more]), total, vocabulary)
        at, of = grams.own[1][grams.spoken], grams.text[grams.spoken]
        sums = lambda x: np.bincount(of, x, size)
        return pa.Table.from_batches([batch(SCORED, ids, lengths - 1, sums(known[at] > 0).astype(np.int64), np.full(size, total), sums(automaton.unigram[at]), np.bincount(grams.text, automaton.traverse(), size))])

    asked = arrow_map(rows, lambda batches: _ask(order, buckets, bits, batches), PIECE_SCHEMA, size=SPLIT_BYTES).groupBy("bucket")
    totals = asked.applyInArrow(_total, "train_tokens long, vocabulary long").agg(*[F.sum(c).alias(c) for c in TOTAL.names])  # one row
    answered = asked.applyInArrow(_answer, ANSWER_SCHEMA).join(F.broadcast(totals), F.lit(True))
    return answered.groupBy("chunk").applyInArrow(close, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_held_out(docs: DataFrame) -> DataFrame:
    """Scores of all documents by a model of those outside the held-out fold (crc32 of the id modulo 5 is 1), with held_out."""
    return score(docs, ~held_out("doc_id", 5, 1)).withColumn("held_out", held_out("doc_id", 5, 1))
