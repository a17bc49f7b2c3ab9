"""Shared plumbing of the training-data operators: shared storage, Arrow mapping, word hashing."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData

import framewright
from framewright.session import scratch as shared_dir

#: Functions travel to executors by value, so that these need not have the package installed.
cloudpickle.register_pickle_by_value(framewright)

#: Odd multiplier of the rolling shingle hash.
SHINGLE_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Entries of a per-worker cache before it starts anew; bounds a worker's memory, never its results.
CACHE_ENTRIES = 400_000
#: Bytes that a function of arrow_map gets at once, on average.
BATCH_BYTES = 16 << 20
#: Rows of a batch between the JVM and Python, at most, as one text can hold megabytes.
BATCH_ROWS = 1000


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage with a Parquet table in shared storage, so that a lost executor costs no earlier stage."""
    path = shared_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the table of a `materialise` that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent() if df.inputFiles() else None
    if path is not None:
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = 1000, keeps: str = "", size: int = BATCH_BYTES) -> DataFrame:
    """mapInArrow where f gets batches of at most `rows` rows and about `size` bytes, since one text can hold megabytes.

    Spark's batches are sliced here, so that no result or bound of f depends on a session setting; but the JVM holds whole
    batches, so the session's limit of their rows is lowered to BATCH_ROWS where it is larger, alike by all operators. keeps: the worker state that f uses; other states are dropped first.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _drop_states(keeps)
        yield from f(sliced(batches, rows, size))
        release()

    return df.mapInArrow(run, schema)


def arrow_groups(groups: GroupedData, f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """applyInArrow that drops the worker's states first and gives its freed memory back after each group."""

    def run(table: pa.Table) -> pa.Table:
        _drop_states()
        out = f(table)
        release()
        return out

    return groups.applyInArrow(run, schema)


def sliced(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        step = max(1, min(rows, b.num_rows * size // max(1, b.nbytes)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def release() -> None:
    """Give a worker's freed memory back to the system, which it would hold beside the JVM while it waits for its next task."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _states() -> dict[str, object]:
    """What this Python worker keeps from task to task."""
    return sys.modules.setdefault("framewright_worker_state", types.ModuleType("framewright_worker_state")).__dict__.setdefault("held", {})


def _drop_states(keeps: str = "") -> None:
    held = _states()
    for key in [k for k in held if k != keeps]:
        del held[key]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def worker_state(key: str, make: Callable[[], object]) -> object:
    """An object that a Python worker keeps from task to task, for caches of pure functions only; see arrow_map's `keeps`."""
    held = _states()
    if key not in held:
        held[key] = make()
    return held[key]


def fit_in_task(sample: DataFrame, fit: Callable[[pa.Table], object]) -> object:
    """fit(rows) of a bounded sample, in one task: the rows don't pass the driver, which gets the model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([cloudpickle.dumps(fit(pa.Table.from_batches(rows)))], pa.binary())], ["model"])

    found = arrow_map(sample.repartition(1), run, "model binary").collect()
    return cloudpickle.loads(bytes(found[0][0])) if found else fit(pa.Table.from_batches([], schema=pa.schema([(c, pa.string()) for c in sample.columns])))


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo: true for the held-out fold; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


class WordHash:
    """64-bit hashes of words, cached up to CACHE_ENTRIES."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > CACHE_ENTRIES:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of `width` words; fewer words make one shorter run, no words none."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    n = len(hashes) - width + 1
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(width), np.uint64)
        for k in range(width):
            out = (out ^ (hashes[k : n + k])) * SHINGLE_MULTIPLIER
            out ^= out >> np.uint64(29)
    return np.unique(out)


def permutations(count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of `count` multiply-shift hash functions; fewer are the beginning of more."""
    draw = np.random.RandomState(seed).randint(0, 1 << 32, (count, 4), np.uint64)
    return (draw[:, 0] << np.uint64(32)) | draw[:, 1] | np.uint64(1), (draw[:, 2] << np.uint64(32)) | draw[:, 3]


def minhash(items: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 512) -> np.ndarray:
    """The least 32-bit hash of the items under each permutation; the empty set gives the largest value throughout."""
    out = np.full(len(a), 0xFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(items), block):
            h = items[i : i + block, None] * a[None, :]
            h += b[None, :]
            np.minimum(out, h.min(0) >> np.uint64(32), out)
    return out.astype(np.uint32)
