"""Connected components by alternating large-star and small-star rounds, each written to shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of `edges` (a, b: long): root is the component's smallest node.

    Loops and nulls are left out, repeated edges count once. Each node's smallest neighbour is aggregated map-side and
    written before it is joined to the edges, so that the join is broadcast or has plain shuffles, whose hot keys (hubs) AQE
    splits. Rounds grow with the logarithm of the longest path.
    """
    own = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    own, before = materialise(own, "edges"), None
    while (now := own.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(v, u))")).first()) != before:
        before = now
        both = own.union(own.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = materialise(both.groupBy("v").agg(F.min("u").alias("m")), "least")
        large = materialise(both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.least("m", "v").alias("u")).distinct(), "large")
        smaller = materialise(large.groupBy("v").agg(F.min("u").alias("m")), "least")
        small = large.join(smaller, "v")
        pairs = F.explode(F.array(F.struct(F.col("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")
        following = materialise(small.select(pairs).select("e.v", "e.u").where("v <> u").distinct(), "edges")
        for used in (own, least, large, smaller):
            discard(used)
        own = following
    return own.select(F.col("v").alias("node"), F.col("u").alias("root")).union(own.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
