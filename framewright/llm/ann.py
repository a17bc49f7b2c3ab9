"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised by codebooks of their own; a cell is a pair of centroids. A query visits cells by
ascending summed squared distance of its halves to the pair, with a heap (the multi-sequence algorithm), until the cells
hold the share of vectors that the fitted sample needed for the target recall; the visited cells' vectors are reranked by
exact distance.

Codebooks and the share are fitted on a bounded sample (FIT_VECTORS); every vector is indexed. Equal vectors are one
index entry with their k + 1 smallest ids, which is all that k neighbours can need. Entries are grouped by the first half's
centroid, in blocks of about BLOCK_ENTRIES; queries in blocks of about BLOCK_QUERIES. A task reranks one block of entries
for one block of queries, each with the list of the second centroids that it visits there, so neither a hot cell nor many
queries meet in one task.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.common import arrow_map, batch, materialise

#: Vectors that the codebooks are fitted on, and queries that the share of visited vectors is fitted on, at most.
FIT_VECTORS, FIT_QUERIES = 20_000, 400
#: Centroids of a half, at most, and for each unit of the root of the vectors' number.
CENTROIDS, CENTROID_RATE = 256, 2.5
#: Entries and queries of a block, on average.
BLOCK_ENTRIES, BLOCK_QUERIES = 512, 2048
ENTRY = pa.schema([("id", pa.int64()), ("vector", pa.binary()), ("i", pa.int32()), ("j", pa.int32())])
ROUTED = pa.schema([("i", pa.int32()), ("query_id", pa.int64()), ("query", pa.binary()), ("visited", pa.binary())])
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


class MultiIndex:
    """Codebooks of two halves, and the share of all vectors that a query visits."""

    def __init__(self, codebooks: tuple[np.ndarray, np.ndarray], share: float) -> None:
        self.codebooks, self.share = codebooks, share

    def _distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.codebooks[0].shape[1]
        return tuple(((part**2).sum(1)[:, None] - 2 * part @ c.T + (c**2).sum(1)[None]).clip(0) for part, c in zip((x[:, :h], x[:, h:]), self.codebooks, strict=True))

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self._distances(x.astype(np.float64))
        return a.argmin(1).astype(np.int32), b.argmin(1).astype(np.int32)

    def visit(self, q: np.ndarray, sizes: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
        """Occupied cells in order of summed distance, until they hold `least` entries; sizes: a row for each centroid of the first half.

        The heap holds the next pair of each row of the sorted centroids; a row joins when the pair above its first is taken.
        """
        (a,), (b,) = self._distances(q[None].astype(np.float64))
        rows, columns = a.argsort(kind="stable").tolist(), b.argsort(kind="stable").tolist()
        a, b = np.sort(a, kind="stable").tolist(), np.sort(b, kind="stable").tolist()
        occupied = sizes.tolist()
        heap, held = [(a[0] + b[0], 0, 0)], 0
        while heap and held < least:
            _, x, y = heap[0]
            if y + 1 < len(b):
                heapq.heapreplace(heap, (a[x] + b[y + 1], x, y + 1))
            else:
                heapq.heappop(heap)
            if y == 0 and x + 1 < len(a):
                heapq.heappush(heap, (a[x + 1] + b[0], x + 1, 0))
            if n := occupied[rows[x]][columns[y]]:
                held += n
                yield rows[x], columns[y]


def _kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.RandomState(3)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        own = ((centres**2).sum(1)[None] - 2 * x @ centres.T).argmin(1)
        count = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, x[:, d], len(centres)) for d in range(x.shape[1])], 1)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def fit(sample: np.ndarray, total: int, k: int, recall: float) -> MultiIndex:
    """Codebooks from the sample; the share is what sample queries needed to reach `recall` of their neighbours, and a margin.

    The neighbours that count are as many as the sample's part of `total` makes of k, one at least.
    """
    half, count = max(1, sample.shape[1] // 2), int(min(CENTROIDS, max(2, round(CENTROID_RATE * math.sqrt(total)))))
    halves = [x if x.shape[1] else np.zeros((len(x), 1)) for x in (sample[:, :half], sample[:, half:])]
    index = MultiIndex(tuple(_kmeans(x, count) for x in halves) if sample.shape[1] > 1 else (_kmeans(halves[0], count), np.zeros((1, 0))), 1.0)
    i, j = index.cells(sample)
    width = len(index.codebooks[1])
    sizes = np.bincount(i * width + j, minlength=len(index.codebooks[0]) * width).reshape(-1, width)
    near, needed = max(1, round(k * min(1.0, len(sample) / max(1, total)))), []
    for at in range(0, len(sample), max(1, len(sample) // FIT_QUERIES)):
        d = ((sample - sample[at]) ** 2).sum(1)
        d[at] = np.inf
        a, b = (x[0] for x in index._distances(sample[at : at + 1]))
        away = a[:, None] + b[None]
        at_cells = away[i, j]  # a vector is visited with the vectors of cells as near as its own
        needed += [float((at_cells <= at_cells[v]).mean()) for v in np.argsort(d, kind="stable")[:near].tolist()]
    index.share = min(1.0, 1.05 * float(np.quantile(needed, recall))) if needed else 1.0
    return index


def _vectors(b: pa.RecordBatch, dim: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a batch's usable rows: not null, finite, not zero, of dimension `dim`."""
    ids, column = b.column(0), b.column(1)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ok = (lengths == dim) & column.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
    if not dim or not ok.any():
        return np.zeros(0, np.int64), np.zeros((0, dim or 1), kind)
    x = column.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)  # a null component becomes NaN
    fine = np.isfinite(x).all(1) & (x != 0).any(1)
    return ids.filter(pa.array(ok)).to_numpy()[fine], np.ascontiguousarray(x[fine]) + x.dtype.type(0)  # -0.0 equals 0.0


def nearest(q: np.ndarray, own: int, x: np.ndarray, ids: list, k: int) -> list[tuple[float, int]]:
    """The k nearest of x's vectors to q by exact double distance, ties to the smaller id, without id `own`."""
    diff = x.astype(np.float64) - q.astype(np.float64)
    d = np.sqrt((diff * diff).sum(1))
    cut = np.partition(d, k)[k] if len(d) > k + 1 else np.inf
    return sorted((float(d[n]), int(v)) for n in np.flatnonzero(d <= cut) for v in ids[n] if v != own)[:k]


def search(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 100, k: int = 10, recall: float = 0.97) -> DataFrame:
    """The k nearest of each query, a row whose id is divisible by `every`: query_id, rank (from 1), vec_id, score.

    Vectors that are null, zero, of another length than the most frequent one (the shorter of two as frequent), or hold null
    or non-finite components take no part, nor do null ids. Vectors of floats are compared as they are, all others as
    doubles. Fewer candidates than k: all of them. Rows that repeat an id and its vector count once; an id with several
    vectors is a candidate, and a query, with each of them. Other columns are not read; an empty table gives an empty result.
    """
    spark = df.sparkSession
    narrow = isinstance(df.schema[embedding].dataType.elementType, T.FloatType)
    kind = "<f4" if narrow else "<f8"
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast(f"array<{'float' if narrow else 'double'}>").alias("v")).where("id IS NOT NULL AND size(v) > 0")
    lengths = rows.groupBy(F.size("v").alias("n")).count()
    most = lengths.orderBy(F.desc("count"), "n").first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = most["n"], most["count"]
    floor = (1 << 63) - 1 - int((1 << 64) * FIT_VECTORS / total) if total > FIT_VECTORS else -(1 << 63)
    drawn = rows.where((F.size("v") == dim) & (F.xxhash64("id") >= F.lit(floor))).limit(FIT_VECTORS).toArrow().combine_chunks().to_batches()
    sample = np.concatenate([_vectors(b, dim, kind)[1] for b in drawn] or [np.zeros((0, dim), kind)])
    if not len(sample):
        sample = np.ones((1, dim), kind)  # nothing usable was drawn: one cell, all of it visited
    index = fit(np.unique(sample, axis=0).astype(np.float64), total, k, recall)
    high, wide = (len(c) for c in index.codebooks)

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries of a batch, of equal vectors those with the smallest ids."""
        for b in batches:
            ids, x = _vectors(b, dim, kind)
            kept: dict[bytes, list[int]] = {}
            for n, v in sorted(set(zip(ids.tolist(), (r.tobytes() for r in x), strict=True))):
                own = kept.setdefault(v, [])
                if len(own) <= k:
                    own.append(n)
            flat = [(n, v) for v, own in kept.items() for n in own]
            if flat:
                yield batch(ENTRY, *zip(*flat, strict=True), *index.cells(np.frombuffer(b"".join(v for _, v in flat), kind).reshape(-1, dim)))

    entries = arrow_map(rows, collapse, "id long, vector binary, i int, j int", rows=10_000)
    place = F.dense_rank().over(Window.partitionBy("vector").orderBy("id"))  # partitions pass on k + 1 ids of a vector, however often it occurs
    entries = entries.withColumn("place", place).where(F.col("place") <= k + 1)
    distinct = materialise(entries.groupBy("vector", "i", "j").agg(F.array_sort(F.collect_set("id")).alias("ids")), "ann-index")
    counted = distinct.groupBy("i", "j").count().toArrow()  # at most CENTROIDS ** 2 cells
    sizes = np.zeros((high, wide), np.int64)
    sizes[counted.column("i").to_numpy(), counted.column("j").to_numpy()] = counted.column("count").to_numpy()
    least = max(index.share * sizes.sum(), k + 1)
    queries = rows.where(F.col("id") % every == 0)
    sides = max(1, -(-queries.count() // BLOCK_QUERIES))
    blocks = spark.createDataFrame([(n, max(1, -(-size // BLOCK_ENTRIES))) for n, size in enumerate(sizes.sum(1).tolist())], "i int, blocks int")  # at most CENTROIDS rows

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, v in {(n, v.tobytes()) for n, v in zip(*(x for x in _vectors(b, dim, kind)), strict=True)}:
                visited: dict[int, list[int]] = {}
                for x, y in index.visit(np.frombuffer(v, kind), sizes, least):
                    visited.setdefault(x, []).append(y)
                size = len(visited)
                yield batch(ROUTED, list(visited), [int(n)] * size, [v] * size, [np.array(y, "<i4").tobytes() for y in visited.values()])

    def rerank(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if len(asked) and len(held):
            x, ids, j = np.frombuffer(b"".join(held.column("vector").to_pylist()), kind).reshape(-1, dim), held.column("ids").to_pylist(), held.column("j").to_numpy()
            for n, q, visited in zip(*(asked.column(c).to_pylist() for c in ("query_id", "query", "visited")), strict=True):
                inside = np.zeros(wide, bool)
                inside[np.frombuffer(visited, "<i4")] = True
                own = np.flatnonzero(inside[j])
                if len(own):
                    out += [(n, v, s) for s, v in nearest(np.frombuffer(q, kind), n, x[own], [ids[o] for o in own.tolist()], k)]
        return pa.Table.from_batches([batch(FOUND, *zip(*out, strict=True))] if out else [], schema=FOUND)

    blocks = F.broadcast(blocks)
    some = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    placed = distinct.join(blocks, "i").select("i", F.pmod(F.xxhash64("vector"), F.col("blocks")).cast("int").alias("block"), some(F.lit(sides)).alias("side"), "j", "vector", "ids")
    routed = arrow_map(queries, route, "i int, query_id long, query binary, visited binary").join(blocks, "i")
    routed = routed.select("i", some(F.col("blocks")).alias("block"), F.pmod(F.xxhash64("query_id", "query"), F.lit(sides)).cast("int").alias("side"), "query_id", "query", "visited")
    keys = ["i", "block", "side"]
    found = routed.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInArrow(rerank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    near = found.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= k).dropDuplicates(["query_id", "vec_id", "score"])
    return near.withColumn("rank", F.row_number().over(order).cast("int")).select("query_id", "rank", "vec_id", "score")
