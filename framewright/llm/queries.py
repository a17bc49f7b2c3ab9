"""The registered query of each operator: production parameters, whole tables, full results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from framewright.llm import ann, byte_bpe, fingerprints, language_id, lm, ngram_join, packing, sharding, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False).drop("ids")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = byte_bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, outputs=False)
    return found.drop("ids", "decoded")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"), shards=40)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_held_out(_table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_toxicity, op3_byte_bpe, op4_ngram_join, op5_ann, op6_language_id, op7_sharding, op8_warc, op9_lm_scoring, op10_fingerprints)}
#: DuckDB SQL of those that SQL can express.
ORACLES: dict[str, str] = {
    "op4_ngram_join": r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT w.doc_id, count(s) AS n FROM words w LEFT JOIN shingles USING (doc_id) GROUP BY w.doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
pairs AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE k / (x.n + y.n - k) >= 0.8
  UNION ALL SELECT x.doc_id, y.doc_id FROM sizes x JOIN sizes y ON x.n = 0 AND y.n = 0 AND x.doc_id < y.doc_id),
links AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reached AS (SELECT a AS node, b AS other FROM links UNION SELECT r.node, l.b FROM reached r JOIN links l ON r.other = l.a),
leads AS (SELECT node, min(other) AS low FROM reached GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(low, doc_id)) AS class_id, coalesce(n, 0) AS n_links
FROM documents LEFT JOIN leads ON node = doc_id LEFT JOIN counts ON a = doc_id""",
    "op7_sharding": r"""
WITH RECURSIVE remainders AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) b(i)),
sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, remainders),
walk AS (
  SELECT doc_id, coalesce(doc_id, 0)::HUGEINT AS state, -1::BIGINT AS place, 0::BIGINT AS next FROM (SELECT DISTINCT doc_id FROM documents)
  UNION ALL
  SELECT doc_id, s, next, least(floor((next + 1) * (2147483648.0::DOUBLE / ((s >> 33) + 1)::DOUBLE)), 1099511627776)::BIGINT
  FROM (SELECT doc_id, next, (((state + 18446744073709551616) % 18446744073709551616) * 2862933555777941757 + 1) % 18446744073709551616 AS s FROM walk WHERE next <= 40)),
placed AS (SELECT doc_id, max(place) FILTER (WHERE place < 40) AS shard, max(place) AS grown FROM walk GROUP BY doc_id),
sliced AS (
  SELECT s.*, p.shard, p.grown, (s.text_crc32 + ((coalesce(s.doc_id, 0) % 1000003) + 1000003) % 1000003) % 256 AS slice
  FROM sized s JOIN placed p ON s.doc_id IS NOT DISTINCT FROM p.doc_id)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY slice, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown::INTEGER AS grown_shard FROM sliced""",
    "op8_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS bytes, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, CASE WHEN bytes >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM p)
SELECT page_id, bytes AS payload_bytes, digest AS payload_digest, CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f""",
}
