"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import language, media, mixing, packing, pii, secrets, simhash, vectors, warc, wavelet
from .tokens import vocabulary


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_packing(spark, sf_dir):
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_warc(spark, sf_dir):
    records = warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_vectors(spark, sf_dir):
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_personal(spark, sf_dir):
    return pii.find_personal(_table(spark, sf_dir, "documents")).drop("found")


def op6_wavelet(spark, sf_dir):
    shards = wavelet.write_token_shards(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return wavelet.read_token_shards(shards).drop("shard")


def op7_secrets(spark, sf_dir):
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op8_media(spark, sf_dir):
    out = media.media_columns(_table(spark, sf_dir, "documents"))
    more = ("path", "offset", "length", "width", "height", "depth")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *more)


def op9_mixing(spark, sf_dir):
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")


def op10_language(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    got = language.identify(docs.select("doc_id", "text"), language.fit(docs), rejected_to="rejected")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return got.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def queries() -> dict:
    own = (op1_simhash, op2_packing, op3_warc, op4_vectors, op5_personal, op6_wavelet, op7_secrets, op8_media, op9_mixing, op10_language)
    return {f.__name__: f for f in own}


_OP3 = """
WITH p AS (
  SELECT page_id, coalesce(encode(html), ''::BLOB) AS body FROM pages
), h AS (
  SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM p
), d AS (
  SELECT page_id, payload_bytes, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS top,
         list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest
  FROM h
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM d
"""

_OP4 = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), f AS MATERIALIZED (
  SELECT vec_id, label, e FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r(x, y) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.b FROM r JOIN l ON l.a = r.y
), c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.x = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""


def oracle_sql() -> dict[str, str]:
    """The others hash by XXH64, encode by vocabularies, compress, or need places of matches: tested by brute force."""
    return {"op3_warc": _OP3, "op4_vectors": _OP4}
