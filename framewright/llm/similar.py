"""Near-duplicate classes: texts that share a signature band are compared by signature, what remains by exact similarity.

1. Every text gets MinHash values over its word shingles: bands of 32-bit values, and a signature of COMPARED bytes, the
   low bytes of the first values. Equal texts are one node.
2. Texts that share a band are compared by signature, STEP bytes at a time, within the band's bucket; a pair that can hardly
   reach the threshold is dropped (see `least_matches`). Buckets of the same texts count once; large ones are split into
   blocks, and each pair of blocks is one group's work. Only who is linked is wanted here, so texts that are linked already
   are not compared again. The components of what remains are the clusters; no pairs are listed, no text is sent.
3. The texts of clusters are sent to be verified: again in blocks where a cluster is large, all pairs of a block pair are
   pruned by signature and the rest is verified by exact Jaccard similarity. A group returns a row for each of its texts: the
   number of its links and its class so far.
4. Classes are the components of those links.
A pair at the threshold shares no band with a probability of at most 7e-7 (MISSED): with BANDS bands of ROWS values from a
threshold of 0.8 up, with shorter bands below it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import WordHash, arrow_groups, arrow_map, batch, discard, materialise, minhash, permutations, shingles
from framewright.llm.graph import components

WIDTH, BANDS, ROWS = 5, 36, 5
#: Probability with which a pair at the threshold may share no band; bands, at most, unless they have one value each.
MISSED, MOST_BANDS = 7e-7, 64
#: MinHash values compared for a pair, and how many at a time.
COMPARED, STEP = 128, 32
#: Probability of reaching the threshold below which a pair is dropped unverified.
TOLERANCE = 1e-9
#: Texts and characters of a block that is verified, on average; signatures of a block that is compared.
BLOCK_TEXTS, BLOCK_CHARS, BLOCK_SIGNS = 384, 2_000_000, 4096
#: Bits of the map by which texts outside all clusters are passed over: WORDS rows of 32 of them, at any size.
MAP_WORDS = 1 << 18
SIGNED = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("chars", pa.int64()), ("size", pa.int64()), ("sign", pa.binary()), ("bands", pa.list_(pa.int64()))])


def banding_for(threshold: float) -> tuple[int, int]:
    """Bands and their values: the longest bands, of ROWS values at most, that lose a pair at the threshold with MISSED at most."""
    if not 0 < threshold <= 1:
        raise ValueError(f"threshold: {threshold!r}")
    if (1 - threshold**ROWS) ** BANDS <= MISSED:
        return BANDS, ROWS
    needed = {rows: math.ceil(math.log(MISSED) / math.log1p(-(threshold**rows))) for rows in range(ROWS, 0, -1)}
    return next(((n, rows) for rows, n in needed.items() if n <= MOST_BANDS), (needed[1], 1))


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[int]:
    """For each step, the fewest equal values with which a pair stays.

    With a uniform prior the similarity given m equal values of n has the distribution Beta(m + 1, n - m + 1); its part
    from the threshold up is the chance of at most m successes in n + 1 trials at the threshold.
    """
    out = []
    for n in range(STEP, COMPARED + 1, STEP):
        chance, m = 0.0, -1
        while chance < tolerance and m < n:
            m += 1
            chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, signs: np.ndarray, threshold: float, least: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sets (sorted, distinct; signs: their signatures) with Jaccard similarity of at least the threshold; right None: within left, i < j."""
    sets = left + (right or [])
    n, m, shift = len(left), len(right if right is not None else left), 0 if right is None else len(left)
    size = np.array([len(s) for s in sets])
    a, b = size[:n, None], size[None, shift : shift + m]
    alive = np.minimum(a, b) >= threshold * np.maximum(a, b)
    if right is None:
        alive &= np.arange(n)[:, None] < np.arange(m)[None]
    i, j = np.nonzero(alive)
    same = np.zeros(len(i), np.int32)
    for k, fewest in enumerate(least or ()):
        part = slice(k * STEP, (k + 1) * STEP)
        for at in range(0, len(i), 1 << 16):
            span = slice(at, at + (1 << 16))
            same[span] += (signs[i[span], part] == signs[shift + j[span], part]).sum(1, dtype=np.int32)
        stay = same >= fewest
        i, j, same = i[stay], j[stay], same[stay]
    if not len(i):
        return i, j
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(size)])
    flat, first = codes[starts[shift] : starts[shift + m]], starts[shift : shift + m] - starts[shift]
    mask, full = np.zeros(int(codes.max(initial=-1)) + 1, bool), size[shift : shift + m] > 0
    keep_i, keep_j = [], []
    bounds = np.searchsorted(i, np.arange(n + 1))
    for x in np.unique(i):
        js, own = j[bounds[x] : bounds[x + 1]], codes[starts[x] : starts[x + 1]]
        if len(own):
            mask[own] = True
            both = np.zeros(m, np.int64)
            both[full] = np.add.reduceat(mask[flat], first[full], dtype=np.int64)
            mask[own] = False
            both = both[js]
            js = js[both / (len(own) + size[shift + js] - both) >= threshold]
        keep_i.append(np.full(len(js), x))
        keep_j.append(js)
    return np.concatenate(keep_i), np.concatenate(keep_j)


def reached(signs: np.ndarray, size: np.ndarray, threshold: float, least: list[int] | None) -> np.ndarray:
    """For each signature the first index that pairs above the pruning lead to from it; size: of the sets behind them.

    A text leaves the open ones when it is reached, so a group of alike texts takes one comparison each.
    """
    root, open_ = np.arange(len(signs)), np.arange(len(signs))
    while len(open_):
        first, open_ = open_[0], open_[1:]
        edge = [first]
        while edge and len(open_):
            x = edge.pop()
            near = open_[np.minimum(size[open_], size[x]) >= threshold * np.maximum(size[open_], size[x])]
            same = np.zeros(len(near), np.int32)
            for k, fewest in enumerate(least or ()):
                part = slice(k * STEP, (k + 1) * STEP)
                same += (signs[near, part] == signs[x, part]).sum(1, dtype=np.int32)
                near, same = near[same >= fewest], same[same >= fewest]
            if len(near):
                root[near] = first
                edge += near.tolist()
                open_ = np.setdiff1d(open_, near, assume_unique=True)
    return root


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        np.minimum.at(root, before[i], low)
        np.minimum.at(root, before[j], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def near_classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, prune: float | None = TOLERANCE) -> DataFrame:
    """One row per row of `df`: doc_id, class_id (smallest id of the near-duplicate class), n_links, text_digest.

    n_links counts the other rows whose shingle sets reach the threshold, copies of the same text among them.
    Null texts count as empty; texts without words are alike to each other. Rows with a null id take no part: class_id null,
    no links. Ids should be unique; a repeated id makes rows of its own. Other columns are not read; an empty table
    gives an empty result. prune: the tolerance of Bayesian pruning, None to verify every pair of similar sizes.
    A threshold outside ]0, 1] raises ValueError.
    """
    return _classes(df, doc_id, text, threshold, prune).drop("root")


def _classes(df: DataFrame, doc_id: str, text: str, threshold: float, prune: float | None) -> DataFrame:
    """As near_classes, and root: the class's own key, as classes of repeated ids can share their smallest id."""
    own = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    n_bands, band_rows = banding_for(threshold)
    rows = own.select("doc_id", "text", F.md5(F.col("text").cast("binary")).alias("digest"))
    least = None if prune is None else least_matches(threshold, prune)

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, permuted = WordHash(), permutations(max(COMPARED, n_bands * band_rows))
        for b in batches:
            out = []
            for i, t, digest in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "digest")), strict=True):
                items = shingles(hashed(t.split()), WIDTH)
                values = minhash(items, *permuted)
                bands = [xxhash.xxh64_intdigest(r.tobytes(), k) - (1 << 63) for k, r in enumerate(values[: n_bands * band_rows].reshape(n_bands, band_rows))]
                out.append((i, digest, len(t), len(items), values[:COMPARED].astype(np.uint8).tobytes(), bands))
            if out:
                yield batch(SIGNED, *zip(*out, strict=True))

    signed = materialise(arrow_map(rows.where("doc_id IS NOT NULL"), banded, "doc_id long, digest string, chars long, size long, sign binary, bands array<long>"), "bands")
    first = lambda c: F.first(c).alias(c)
    texts = materialise(
        signed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), *map(first, ("chars", "size", "sign", "bands"))).withColumn("node", F.monotonically_increasing_id()), "texts"
    )
    banding = texts.select("node", F.explode("bands").alias("band"))
    shared = banding.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 1))").alias("y")).where("n > 1")
    shared = shared.groupBy("n", "x", "y").agg(F.min("band").alias("band"))  # buckets of the same texts count once
    shared = materialise(shared.select("band", F.ceil(F.col("n") / BLOCK_SIGNS).cast("int").alias("blocks"), "n"), "buckets")
    bins = max(1, math.ceil((shared.where("blocks = 1").agg(F.sum("n")).first()[0] or 0) / BLOCK_SIGNS))
    dealt = _in_block_pairs(banding.join(shared.drop("n"), "band"), "band", bins, diagonal=False).join(texts.select("node", "size", "sign"), "node")

    def meet(table: pa.Table) -> pa.Table:
        work: dict[tuple, list[tuple]] = {}
        for *key, node, size, sign in zip(*(table.column(c).to_pylist() for c in ("band", "low", "high", "node", "size", "sign")), strict=True):
            work.setdefault(tuple(key), []).append((node, size, sign))
        out: set[tuple[int, int]] = set()
        for members in work.values():
            nodes, size, signs = zip(*sorted(members), strict=True)
            root = reached(np.frombuffer(b"".join(signs), np.uint8).reshape(len(nodes), -1), np.array(size), threshold, least)
            out |= {(nodes[k], nodes[r]) for k, r in enumerate(root.tolist()) if k != r}
        columns = list(zip(*out, strict=True)) or [[], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    clusters = materialise(components(arrow_groups(dealt.groupBy("task"), meet, "a long, b long")), "clusters")
    discard(shared)

    members = clusters.join(texts.drop("bands"), "node")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("c")).select("root", F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("c") / BLOCK_CHARS)).cast("int").alias("blocks"))
    members = materialise(members.join(sizes, "root"), "members")
    discard(clusters)
    total = members.where("blocks = 1").agg(F.sum("chars")).first()[0] or 0
    bodies = _passed(rows.where("doc_id IS NOT NULL"), members).join(members.withColumnsRenamed({"digest": "own_digest"}), (F.col("doc_id") == F.col("rep")) & (F.col("digest") == F.col("own_digest")))
    dealt = _in_block_pairs(bodies.select("node", "root", "copies", "sign", "text", "blocks"), "root", max(1, math.ceil(total / BLOCK_CHARS)), diagonal=True)

    def compare(table: pa.Table) -> pa.Table:
        work: dict[tuple, dict[int, tuple]] = {}
        for node, root, copies, sign, body, blk, low, high in zip(*(table.column(c).to_pylist() for c in ("node", "root", "copies", "sign", "text", "block", "low", "high")), strict=True):
            work.setdefault((root, low, high), {})[node] = (blk, copies, body, sign)
        hashed, out = WordHash(), []
        for (_, low, high), own in sorted(work.items()):
            sides = [sorted(k for k, v in own.items() if v[0] == x) for x in ((low,) if low == high else (low, high))]
            sets = [[shingles(hashed(own[k][2].split()), WIDTH) for k in side] for side in sides]
            nodes = np.array([k for side in sides for k in side], np.int64)
            signs = np.frombuffer(b"".join(own[k][3] for k in nodes.tolist()), np.uint8).reshape(len(nodes), -1)
            i, j = linked(sets[0], sets[1] if len(sets) > 1 else None, signs, threshold, least)
            j = j + (len(sides[0]) if len(sides) > 1 else 0)
            weight = np.array([own[k][1] for k in nodes.tolist()], np.int64)
            links = np.bincount(i, weight[j], len(nodes)) + np.bincount(j, weight[i], len(nodes))
            order = np.argsort(nodes)  # so that the smallest index is the smallest node
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            lead = nodes[order][_roots(len(nodes), rank[i], rank[j])[rank]]
            out += zip(nodes.tolist(), lead.tolist(), links.astype(np.int64).tolist(), strict=True)
        cols = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["node", "lead", "links"])

    found = materialise(arrow_groups(dealt.groupBy("task"), compare, "node long, lead long, links long"), "links")
    classes = components(found.select(F.col("node").alias("a"), F.col("lead").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = texts.drop("bands").join(counts, "node", "left").join(classes, "node", "left").select("digest", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    joined = materialise(joined, "classes")
    for used in (texts, members, found):
        discard(used)
    ids = joined.groupBy("root").agg(F.min("rep").alias("class_id"))
    per_text = joined.join(ids, "root").select("digest", "root", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    known = signed.select("doc_id", "digest").join(per_text, "digest").select("doc_id", "class_id", "n_links", F.col("digest").alias("text_digest"), "root")
    return known.union(rows.where("doc_id IS NULL").select("doc_id", F.lit(None).cast("long"), F.lit(0).cast("long"), "digest", F.lit(None).cast("long")))


def _in_block_pairs(rows: DataFrame, key: str, bins: int, diagonal: bool) -> DataFrame:
    """Rows (node, key, blocks and more) once for each pair of blocks that they take part in, with block, low, high and task.

    Groups of one block share `bins` tasks; without `diagonal`, the block pairs of larger ones are those of unlike blocks only.
    """
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    if not diagonal:
        rows = rows.where("blocks = 1 OR block <> other")
    low, high = F.least("block", "other"), F.greatest("block", "other")
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64(key), F.lit(bins))).otherwise(F.xxhash64(key, low, high))
    return rows.select("*", low.alias("low"), high.alias("high"), task.alias("task")).drop("other", "blocks")


def _bitmap(df: DataFrame, digest: str) -> DataFrame:
    """word, bits: a map of MAP_WORDS * 32 bits with one for each digest. Bounded at any size: it may be broadcast."""
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{digest}`), 32) as int))")
    return F.broadcast(df.select(_word(digest), bit.alias("bit")).groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")))


def _word(digest: str) -> Column:
    return F.shiftright(F.pmod(F.xxhash64(digest), F.lit(MAP_WORDS * 32)), 5).alias("word")


def _hit(digest: str) -> Column:
    """Whether the bit of a digest is set in the bits of its word; null where the word has none."""
    return F.expr(f"(shiftrightunsigned(bits, cast(pmod(xxhash64(`{digest}`), 32) as int)) & 1) = 1")


def _passed(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Rows whose digest may be one of the members': most other texts are not shuffled."""
    return rows.select("*", _word("digest")).join(_bitmap(members, "digest"), "word").where(_hit("digest")).drop("word", "bits")


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents, in all their columns, less those of each class that aren't its smallest id; rows with null ids stay.

    Where rows repeat the kept id and text, one of them stays. Null texts count as empty; an empty table stays empty. Only
    documents whose text may be among those left out, by a bitmap, are joined to these; all others pass where they are.
    """
    names = docs.columns
    classes = _classes(docs, "doc_id", "text", threshold, TOLERANCE).where("doc_id IS NOT NULL")
    per_key = materialise(classes.groupBy("doc_id", "text_digest").agg(F.first("root").alias("root"), F.first("class_id").alias("class_id"), F.count(F.lit(1)).alias("n")), "keys")
    kept = per_key.where("doc_id = class_id").groupBy("root", "doc_id").agg(F.min("text_digest").alias("text_digest"), F.lit(True).alias("kept"))
    marks = per_key.join(kept, ["root", "doc_id", "text_digest"], "left").where("kept IS NULL OR n > 1").select(F.col("doc_id").alias("key"), F.col("text_digest").alias("own"), F.col("kept").isNotNull().alias("kept"))
    marks = materialise(marks, "left-out")
    discard(per_key)
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("key"), digest.alias("own"))
    hit = F.coalesce(F.col("key").isNotNull() & _hit("own"), F.lit(False))
    told = rows.select("*", _word("own")).join(_bitmap(marks, "own"), "word", "left").withColumn("hit", hit).drop("word", "bits")
    out = told.where(~F.col("hit")).select("row.*").unionByName(told.where("hit").join(marks, ["key", "own"], "left_anti").select("row.*"))
    if marks.where("kept").isEmpty():
        return out
    return out.unionByName(told.where("hit").join(marks.where("kept"), ["key", "own"], "left_semi").dropDuplicates(["key", "own"]).select("row.*"))
