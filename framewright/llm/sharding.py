"""Sharding by jump consistent hashing, in DataFrame functions only.

A key's shard is the last landing place below the shard count of a pseudo-random walk that the key seeds
(a 64-bit linear congruential generator). No ring or table is kept. Appending a shard changes the shard of those keys
alone whose walk lands on the new one: about 1/(n+1) of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.common import materialise

# Multiplier of the generator, published with the algorithm.
MULTIPLIER = 2862933555777941757
MASK16, MASK32 = (1 << 16) - 1, (1 << 32) - 1
#: Slices of each shard whose rows are numbered independently; more slices, smaller tasks.
SLICES = 256
#: Copies of a row that are expanded at once.
COPIES = 4096


def _low_product(x: Column, factor: int) -> Column:
    """x * factor modulo 2**32 for 0 <= x < 2**32; in 16-bit steps, since ANSI arithmetic raises on overflow."""
    low, high = factor & MASK16, factor >> 16 & MASK16
    return (x * F.lit(low) + F.shiftleft((x * F.lit(high)).bitwiseAND(F.lit(MASK16)), 16)).bitwiseAND(F.lit(MASK32))


def _advance(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The 64-bit state, as two 32-bit halves, times MULTIPLIER plus one, modulo 2**64."""
    m_lo, m_hi = MULTIPLIER & MASK32, MULTIPLIER >> 32
    a, b = lo * F.lit(m_lo & MASK16), lo * F.lit(m_lo >> 16)
    low = a + F.shiftleft(b.bitwiseAND(F.lit(MASK16)), 16) + F.lit(1)
    carry = F.shiftright(low, 32) + F.shiftright(b, 16)
    return (carry + _low_product(hi, m_lo) + _low_product(lo, m_hi)).bitwiseAND(F.lit(MASK32)), low.bitwiseAND(F.lit(MASK32))


def jump_walk(key: Column, shards: int) -> Column:
    """struct(shard, grown): the key's shard among `shards` and among `shards` + 1; key: a long, null counts as 0."""
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(MASK32)).alias("lo"), F.lit(0).cast("long").alias("next"),
        F.lit(-1).cast("long").alias("shard"), F.lit(-1).cast("long").alias("grown"),
    )

    def step(s: Column, _: Column) -> Column:
        hi, lo = _advance(s["hi"], s["lo"])
        leap = (s["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double"))
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), F.least(F.floor(leap), F.lit(1 << 40)).alias("next"), F.when(s["next"] < shards, s["next"]).otherwise(s["shard"]).alias("shard"), s["next"].alias("grown"))
        return F.when(s["next"] <= shards, moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, step, lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard from 0 to shards - 1 of a 64-bit key, equal to public implementations of the algorithm."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    return jump_walk(key, shards)["shard"]


def assign(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 40) -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot, grown_shard.

    `size` is the text's UTF-8 bytes (null: none) plus 16. `slot` numbers a shard's rows from 0 without gaps.
    Law `key`: the key and the shard count alone decide, so equal keys (and null keys) share a shard. An integer key walks
    by itself (null as 0), any other by its 64-bit hash. Slots go by slice, key, size and checksum.
    Equal rows are counted before the shuffle (the counts are written, and read for offsets and slots) and expanded after
    numbering, those of more than COPIES copies in parts dealt to many tasks, so that no repeated row makes a hot task; each shard is numbered in SLICES slices whose offsets come from a count of at most shards * SLICES rows.
    Other columns, whatever their names, are not read; an empty table gives an empty result.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = df.select(F.col(key).alias("k"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    groups = rows.groupBy("k", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    whole = isinstance(df.schema[key].dataType, T.IntegralType)
    stable = F.coalesce(F.col("k").cast("long"), F.lit(0).cast("long")) if whole else F.xxhash64("k")
    walk = jump_walk(stable, shards)
    groups = groups.withColumn("w", walk).select("*", F.col("w.shard").alias("shard"), F.col("w.grown").alias("grown_shard"), F.pmod(F.col("text_crc32") + F.pmod(stable, F.lit(1_000_003)), F.lit(SLICES)).cast("int").alias("slice")).drop("w")
    groups = materialise(groups, "shards")
    per_slice = groups.groupBy("shard", "slice").agg(F.sum("n").alias("n"))
    offsets = F.broadcast(per_slice.selectExpr("shard", "slice", "sum(n) OVER (PARTITION BY shard ORDER BY slice) - n AS first"))  # at most shards * SLICES rows
    numbered = groups.join(offsets, ["shard", "slice"]).selectExpr("*", "first + sum(n) OVER (PARTITION BY shard, slice ORDER BY k, size, text_crc32 ROWS UNBOUNDED PRECEDING) - n AS start")
    columns = ["k", "size", "text_crc32", "shard", "grown_shard"]
    few = numbered.where(F.col("n") <= COPIES).selectExpr(*columns, "explode(sequence(start, start + n - 1)) AS slot")
    parts = numbered.where(F.col("n") > COPIES).selectExpr(*columns, "start", "n", f"explode(sequence(0, (n - 1) div {COPIES})) AS part")
    many = parts.repartition("part").selectExpr(*columns, f"explode(sequence(start + part * {COPIES}, least(start + n, start + (part + 1) * {COPIES}) - 1)) AS slot")
    return few.unionAll(many).select(F.col("k").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
