"""Documents to packed training sequences, in five stages. Each works on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from terrane.llm import language, mixing, packing, secrets, simhash
from terrane.llm.common import unused, written
from terrane.llm.tokens import vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language identification rejects: no text, no letter, or a margin too narrow to tell."""
    lang, score, rejected = names = [unused(docs.columns, c) for c in ("predicted", "margin", "rejected")]
    told = language.identify(docs, language.fit(docs), lang_to=lang, score_to=score, rejected_to=rejected)
    return told.filter(~F.col(rejected)).drop(*names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each near-duplicate group, once if its row repeats.

    Rows without a doc_id cannot be named in a group; exact repeats among them go. Rows repeat if the JSON forms of all
    their columns are equal (columns may be of types that cannot be compared, as maps).
    """
    groups = simhash.near_duplicates(docs)
    first = groups.filter("doc_id = component_id").select("doc_id").distinct()
    whole = F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), {"ignoreNullFields": "false"})
    mark = unused(docs.columns, "row")
    named = docs.join(first, "doc_id", "left_semi").withColumn(mark, F.sha2(whole, 256)).dropDuplicates(["doc_id", mark])
    rest = docs.filter("doc_id is null").withColumn(mark, F.sha2(whole, 256)).dropDuplicates([mark])
    return named.unionByName(rest).select(*(F.col(f"`{c}`") for c in docs.columns))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets, found in plain or in encoded layers; n_chars follows. No document goes."""
    return secrets.mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0 to 3 times), in the order of its output shards."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mixed = mixing.mix(docs, shards=1 << max(0, parts - 1).bit_length())
    key, source, size, shards, n, copy, shard, order = (unused(docs.columns, f"mixed_{c}") for c in ("doc_id", "source", "size", "shards", "words", "copy", "shard", "order"))
    taken = mixed.filter("copies > 0").select("doc_id", "source", "size", "shards").dropDuplicates(["doc_id", "source", "size"])
    taken = taken.select(F.col("doc_id").alias(key), F.col("source").alias(source), F.col("size").alias(size), F.col("shards").alias(shards))
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    same = F.col("doc_id").eqNullSafe(F.col(key)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(n) == F.col(size))
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.withColumn(n, words).join(taken, same).select(*own, F.posexplode(shards).alias(copy, shard))
    rows = rows.withColumn(order, F.xxhash64(F.lit(42), shard, "doc_id", copy))
    return rows.repartition(shard).sortWithinPartitions(shard, order).select(*own)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in sequences of 1024 tokens."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Four of the five stages cannot be written in SQL (compression, XXH64 fingerprints, decoding, a public vocabulary).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
