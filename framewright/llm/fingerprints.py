"""MinHash fingerprints of documents over word 5-gram shingles, in vectorised numpy.

A fingerprint is PERMUTATIONS bytes, the low byte of each permutation's least hash, as hex text. Equal texts have equal
fingerprints; the share of equal bytes, corrected for chance, estimates the Jaccard similarity of the shingle sets.
Texts of fewer than five words are one shorter shingle; texts without words are alike to each other and to no others.
`near_duplicates` joins signature bands in Spark and verifies candidates by exact Jaccard similarity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import WordHash, arrow_map, batch, materialise, minhash, permutations, shingles

PERMUTATIONS = 128
CHANCE = 1 / 256
#: Letters of a text by which rows of equal ids are dealt to ranges.
BEGINNING = 32
#: A row, or (pid not null) what a partition's ends need of each other.
ROW = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("pid", pa.int32()), ("first_text", pa.string()), ("last_text", pa.string()),
])
ROW_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, pid int, first_text string, last_text string"


class Fingerprinter:
    def __init__(self) -> None:
        self.hashed, (self.a, self.b) = WordHash(), permutations(PERMUTATIONS)

    def __call__(self, text: str) -> bytes:
        return minhash(shingles(self.hashed(text.split())), self.a, self.b).astype(np.uint8).tobytes()


def likeness(x: bytes, y: bytes) -> float:
    """Estimated Jaccard similarity of the texts behind two fingerprints, from 0 to 1."""
    same = float((np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).mean())
    return max(0.0, (same - CHANCE) / (1 - CHANCE))


def fingerprint(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint of every row; null texts count as empty, other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Fingerprinter()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own(t or "").hex() for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return arrow_map(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), run, "doc_id long, fingerprint string")


def spliced(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as much of the following one's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_edited(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint beside those of its spliced text and of the next document, by descending id.

    Texts are dealt once by ranges of the id (of equal ids, by the text's first BEGINNING letters) and compared within
    partitions; only the last document of a partition meets the first of the next one afterwards. Equal ids are ordered by text, null ids come last; the last row's next is the
    first, and a single row's next is itself. Null texts count as empty, other columns are not read.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").asc()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first, before, pid = Fingerprinter(), None, None, TaskContext.get().partitionId()
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                now = (i, t, own(t))
                if before:
                    out.append((*_compared(own, before, now), None, None, None))
                first, before = first or now, now
            if out:
                yield batch(ROW, *zip(*out, strict=True))
        if before:
            yield batch(ROW, [before[0]], *[[None]] * 6, [pid], [first[1]], [before[1]])

    dealt = rows.repartitionByRange(order[0], F.substring("text", 1, BEGINNING).asc()).sortWithinPartitions(*order)
    done = materialise(arrow_map(dealt, run, ROW_SCHEMA), "fingerprints")
    ends = done.where("pid IS NOT NULL")
    ranks = ends.selectExpr("pid", "row_number() OVER (ORDER BY pid) AS place", "count(*) OVER () AS places")  # a number for each partition
    ends = ends.join(ranks, "pid")
    heads = ends.select(F.col("place").alias("next_place"), F.col("first_text").alias("next_text"))
    pairs = ends.join(heads, F.col("next_place") == F.col("place") % F.col("places") + 1).select("doc_id", "last_text", "next_text")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Fingerprinter()
        for b in batches:
            out = [(*_compared(own, (i, t, own(t)), (None, n, own(n))), None, None, None) for i, t, n in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            if out:
                yield batch(ROW, *zip(*out, strict=True))

    every = done.where("pid IS NULL").unionByName(arrow_map(pairs, close, ROW_SCHEMA))
    as_text = lambda c: F.lower(F.hex(c)).alias(c)
    return every.select("doc_id", "n_chars", "edited_sha256", as_text("fingerprint"), as_text("edited_fingerprint"), "near_edited", "near_next")


def _compared(own: Fingerprinter, this: tuple, following: tuple) -> tuple:
    doc_id, text, print_ = this
    edited = spliced(text, following[1])
    changed = own(edited)
    return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), print_, changed, likeness(print_, changed), likeness(print_, following[2])


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id, n_links: near-duplicate classes, verified by exact Jaccard similarity.

    The signature bands joined in Spark are of the fingerprint's own permutations and some more; texts that share one are
    compared by their fingerprints. See `near_classes` for nulls, ties, repeated rows and empty tables.
    """
    from framewright.llm.similar import near_classes

    return near_classes(df, doc_id, text, threshold)
