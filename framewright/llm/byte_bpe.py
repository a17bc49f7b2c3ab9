"""Byte-level BPE: ranked merges folded over byte arrays of distinct words, and decoding by concatenating binary pieces.

One narrow pass over each partition, without a shuffle. Texts are split by the vocabulary's pattern and the distinct words
numbered; a word is an array of byte ids, and each step of the fold merges the adjacent pair of least rank, until no pair
has one. Ranks come from a constant map from pairs of ids, kept in arrays that a perfect hash indexes. Documents are then
word numbers, replaced by the words' ids, and decoded by concatenating the ids' binary pieces.

The fold has two forms with equal results:
* `merge_words` folds all new words of a batch at once, as rows of a matrix (the default);
* `encode_word` folds one word by Spark's higher-order functions (`native=True`): Python splits, Spark encodes the new
  words, Python joins. These functions are interpreted, at about 100 microseconds a word; see the README for figures.
Both are quadratic in a word's length, so words of more than LONG bytes are merged by the same ranks with a heap. The
numbering starts anew at WORDS words, which bounds a worker's memory.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import arrow_map, batch, worker_state

LONG, WORDS = 64, 600_000
# Fixed value: the pattern of words that take the space before them, as published with the vocabulary.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = 2**31 - 1
# Sizes and multipliers of the perfect hash: two primes, and primes that spread pairs over them.
SLOTS, GROUPS = 262_139, 32_749
SLOT_L, SLOT_R, GROUP_L, GROUP_R = 179_424_673, 86_028_121, 15_485_863, 32_452_843
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.binary()), ("decoded", pa.binary())])
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, decoded binary"
TABLES = "keys array<long>, ranks array<int>, shifts array<int>, singles array<int>"


class Ranks:
    """A tiktoken rank file (read through Spark, so it may be in any store), and the pair map built from it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        found = spark.read.text(path if "://" in path else f"file://{path}").where("value <> ''").collect()  # a vocabulary file
        self.ranks = {base64.b64decode(a): int(b) for a, b in (r[0].split(" ") for r in found)}
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for p, r in self.ranks.items():
            self.pieces[r] = p
        pairs = {}
        for p, r in self.ranks.items():
            for k in range(1, len(p)):
                a, b = self.ranks.get(p[:k]), self.ranks.get(p[k:])
                if a is not None and b is not None:
                    pairs[a, b] = r
        self.pairs = pairs
        left, right = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        group, slot = (left * GROUP_L + right * GROUP_R) % GROUPS, (left * SLOT_L + right * SLOT_R) % SLOTS
        order = np.argsort(group, kind="stable")
        self.keys, self.values, self.shifts = np.full(SLOTS, -1, np.int64), np.full(SLOTS, NONE, np.int64), np.zeros(GROUPS, np.int64)
        used, merged = bytearray(SLOTS), np.array(list(pairs.values()), np.int64)
        for own in sorted(np.split(order, np.flatnonzero(np.diff(group[order])) + 1), key=len, reverse=True):
            base, shift = slot[own].tolist(), 0
            if len(set(base)) < len(base):
                raise ValueError("two pairs share both hashes; choose other multipliers")
            while any(used[(x + shift) % SLOTS] for x in base):
                shift += 1
            at = [(x + shift) % SLOTS for x in base]
            for x in at:
                used[x] = 1
            self.shifts[group[own[0]]] = shift
            self.keys[at], self.values[at] = left[own] << 32 | right[own], merged[own]

    def tables(self) -> dict[str, pa.Array]:
        """The constant columns of TABLES, of one row."""
        one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t))
        return {"keys": one(self.keys, pa.int64()), "ranks": one(self.values, pa.int32()), "shifts": one(self.shifts, pa.int32()), "singles": one([self.ranks[bytes([i])] for i in range(256)], pa.int32())}


def _rank(left: Column, right: Column) -> Column:
    """The rank of the merged pair, NONE if there is none (as where a part is null)."""
    left, right = left.cast("long"), right.cast("long")
    shift = F.get(F.col("shifts"), ((left * GROUP_L + right * GROUP_R) % GROUPS).cast("int"))
    slot = ((left * SLOT_L + right * SLOT_R + shift) % SLOTS).cast("int")
    return F.when(F.get(F.col("keys"), slot) == F.shiftleft(left, 32) + right, F.get(F.col("ranks"), slot)).otherwise(F.lit(NONE))


def _let(value: Column, use) -> Column:
    """use(value), with the value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def encode_word(word: Column) -> Column:
    """Ids (array<int>) of a word given as an array of unsigned bytes; needs TABLES' columns beside it."""
    parts = F.transform(word, lambda b: F.get(F.col("singles"), b.cast("int")))
    start = _let(parts, lambda p: F.struct(p.alias("p"), F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 2, F.size(p)), _rank).alias("r")))

    def merge(s: Column, best: Column) -> Column:
        p, r = s["p"], s["r"]
        size = F.size(p)

        def at_place(i: Column) -> Column:  # i counts from 1
            before = F.when(i > 1, F.array(_rank(F.get(p, i - 2), best))).otherwise(F.array().cast("array<int>"))
            after = F.when(i + 1 < size, F.array(_rank(best, F.get(p, i + 1)))).otherwise(F.array().cast("array<int>"))
            return F.struct(
                F.concat(F.slice(p, F.lit(1), i - 1), F.array(best), F.slice(p, i + 2, size)).alias("p"),
                F.concat(F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))), before, after, F.slice(r, i + 2, size)).alias("r"),
            )

        return _let(F.array_position(r, best).cast("int"), at_place)

    def step(s: Column, _: Column) -> Column:
        return _let(F.coalesce(F.array_min(s["r"]), F.lit(NONE)), lambda best: F.when(best == NONE, s).otherwise(merge(s, best)))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(word) - 1, F.lit(1))), start, step, lambda s: s["p"])


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap of pairs, for long words."""
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != both:
            continue  # one of them has been merged meanwhile
        parts[i], parts[j] = both, None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(parts) and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, parts[a] + parts[b]))
    return [ranks[p] for p in parts if p is not None]


def merge_words(words: list[bytes], keys: np.ndarray, ranks: np.ndarray, shifts: np.ndarray, singles: np.ndarray, block: int = 8192) -> list[bytes]:
    """Ids of each word (little-endian unsigned 32-bit): the fold over many words at once, the longest block first."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    out: list[bytes] = [b""] * len(words)

    def rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        slot = (a * SLOT_L + b * SLOT_R + shifts[(a * GROUP_L + b * GROUP_R) % GROUPS]) % SLOTS
        return np.where((keys[slot] == (a << 32 | b)) & (a >= 0) & (b >= 0), ranks[slot], NONE)

    for at in range(0, len(order), block):
        own = order[at : at + block]
        sizes = np.array([len(words[i]) for i in own])
        width = int(sizes.max())
        parts = np.full((len(own), width + 1), -1, np.int64)
        flat = np.frombuffer(b"".join(words[i] for i in own), np.uint8)
        parts[np.repeat(np.arange(len(own)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = singles[flat]
        pairs = rank(parts[:, :-1], parts[:, 1:])
        columns, rows = np.arange(width + 1)[None], np.arange(len(own))
        while True:
            best = pairs.min(1)
            live = best < NONE
            for i in np.flatnonzero(~live).tolist():
                ids = parts[i]
                out[own[rows[i]]] = ids[ids >= 0].astype("<u4").tobytes()
            if not live.any():
                break
            parts, pairs, rows, best = parts[live], pairs[live], rows[live], best[live]
            place, line = pairs.argmin(1), np.arange(len(rows))
            parts[line, place] = best
            move = np.minimum(columns + (columns > place[:, None]), width)
            parts = np.take_along_axis(parts, move, 1)
            parts[:, -1] = -1
            pairs = np.take_along_axis(pairs, np.minimum(move[:, :-1], width - 1), 1)
            pairs[:, -1] = NONE
            before = np.maximum(place - 1, 0)
            left = rank(parts[line, before], best)
            pairs[line[place > 0], before[place > 0]] = left[place > 0]
            pairs[line, place] = rank(best, parts[line, place + 1])
    return out


class Splitter:
    """Numbers the words of texts; `new` collects those not seen since the last restart.

    With SPACED, a stretch between single spaces is split once and kept, since a space before a letter, number or mark
    starts a word; a stretch of letters with or without marks after them is one word, or two. Other patterns split whole texts.
    """

    LETTERS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")

    def __init__(self, pattern: str) -> None:
        self.pattern, self.spaced, self.stretches, self.words, self.new = regex.compile(pattern), pattern == SPACED, {}, {}, []

    def restart(self) -> None:
        self.stretches.clear()
        self.words.clear()

    def _numbers(self, found: list[str]) -> bytes:
        words, out = self.words, []
        for w in found:
            i = words.get(w)
            if i is None:
                i = words[w] = len(words)
                self.new.append(w)
            out.append(i)
        return struct.pack(f"<{len(out)}i", *out)

    def _stretch(self, s: str) -> bytes | None:
        """The numbers of a stretch after a space; None if it can't be split by itself."""
        if m := self.LETTERS.fullmatch(s):
            return self._numbers([" " + m[1], m[2]] if m[2] else [" " + m[1]])
        return None if not s or s[0].isspace() or s[-1].isspace() else self._numbers(self.pattern.findall(" " + s))

    def __call__(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not self.spaced or first[-1:].isspace():
            return self._numbers(self.pattern.findall(text))
        known = self.stretches
        for s in set(rest).difference(known):
            known[s] = self._stretch(s)
        found = list(map(known.__getitem__, rest))
        return self._numbers(self.pattern.findall(text)) if None in found else self._numbers(self.pattern.findall(first)) + b"".join(found)


def _digest(doc_id: int | None, ids: bytes, pieces: list[bytes], outputs: bool) -> tuple:
    decoded = b"".join(map(pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))
    return doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), ids if outputs else None, decoded if outputs else None


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", outputs: bool = True, native: bool = False) -> DataFrame:
    """DIGEST's columns for every row: the ids as little-endian unsigned 32-bit integers, and the bytes they decode to.

    Without `outputs`, ids and decoded are null. Null texts count as empty (no ids). Repeated rows give repeated results,
    other columns are not read; an empty table gives an empty result. Special tokens in a text are ordinary text.
    """
    vocabulary = Ranks(docs.sparkSession, path)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    if native:
        return _encode_native(rows, vocabulary, pattern, outputs)
    ranks, pieces, arrays = vocabulary.ranks, vocabulary.pieces, (vocabulary.keys, vocabulary.values, vocabulary.shifts, np.array([vocabulary.ranks[bytes([i])] for i in range(256)]))

    state = f"byte BPE {path} {pattern}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, known = worker_state(state, lambda: (Splitter(pattern), []))
        for b in batches:
            if len(splitter.words) > WORDS:
                splitter.restart()
                known.clear()
            splitter.new = []
            numbers = [splitter(t) for t in b.column(1).to_pylist()]
            raw = [w.encode() for w in splitter.new]
            short = iter(merge_words([w for w in raw if len(w) <= LONG], *arrays))
            known += [next(short) if len(w) <= LONG else np.array(merge_long(w, ranks), "<u4").tobytes() for w in raw]
            out = [_digest(i, b"".join(map(known.__getitem__, np.frombuffer(n, "<i4").tolist())), pieces, outputs) for i, n in zip(b.column(0).to_pylist(), numbers, strict=True)]
            if out:
                yield batch(DIGEST, *zip(*out, strict=True))

    return arrow_map(rows, run, DIGEST_SCHEMA, keeps=state)


def _encode_native(rows: DataFrame, vocabulary: Ranks, pattern: str, outputs: bool) -> DataFrame:
    tables, ranks, pieces = vocabulary.tables(), vocabulary.ranks, vocabulary.pieces

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(pattern)
        for b in batches:
            restart = len(splitter.words) > WORDS
            if restart:
                splitter.restart()
            splitter.new = []
            numbers = [splitter(t) for t in b.column(1).to_pylist()]
            raw = [w.encode() for w in splitter.new]
            short = [np.frombuffer(w, np.uint8).astype(np.int16) if len(w) <= LONG else np.zeros(0, np.int16) for w in raw]
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(s) for s in short])]).astype(np.int32), np.concatenate([*short, np.zeros(0, np.int16)]))
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            long = pa.array([w if len(w) > LONG else None for w in raw], pa.binary())
            yield pa.RecordBatch.from_pydict({"restart": pa.array([restart]), "docs": one(b.column(0)), "numbers": one(pa.array(numbers, pa.binary())), "words": one(lists), "long": one(long), **tables})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[bytes] = []
        for b in batches:
            for k in range(b.num_rows):
                if b.column("restart")[k].as_py():
                    known = []
                coded = b.column("coded")[k].values
                starts, flat = coded.offsets.to_numpy(), coded.values.to_numpy().astype("<u4").tobytes() if len(coded) else b""
                shift = 0
                for i, long in enumerate(b.column("long")[k].values.to_pylist()):
                    known.append(flat[4 * (starts[i] - shift) : 4 * (starts[i + 1] - shift)] if long is None else np.array(merge_long(long, ranks), "<u4").tobytes())
                out = []
                for i, numbers in zip(b.column("docs")[k].values.to_pylist(), b.column("numbers")[k].values.to_pylist(), strict=True):
                    out.append(_digest(i, b"".join(map(known.__getitem__, np.frombuffer(numbers, "<i4").tolist())), pieces, outputs))
                if out:
                    yield batch(DIGEST, *zip(*out, strict=True))

    worded = arrow_map(rows, split, f"restart boolean, docs array<long>, numbers array<binary>, words array<array<smallint>>, long array<binary>, {TABLES}")
    coded = worded.select("restart", "docs", "numbers", "long", F.transform("words", encode_word).alias("coded"))
    return arrow_map(coded, join, DIGEST_SCHEMA)
