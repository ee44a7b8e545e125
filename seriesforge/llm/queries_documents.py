"""Queries that judge, compare and clean documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm import cuckoo_dedup, decontaminate, hash_ring, quality_gbt, simhash, suffix_dedup
from seriesforge.llm.common import query, table


@query()
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts and the verdict of base rules and trees."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_gbt.quality_model(docs, table(spark, sf_dir, "labels"))
    return quality_gbt.judge(docs, model).select(
        "doc_id", *[f"judged.{c}" for c in quality_gbt.COUNTS], "judged.base_failed", "judged.kept")


@query()
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest document that links lead to."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query()
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-byte strings that a document with a smaller id has too."""
    done = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "dedup.n_bytes", "dedup.n_removed", F.size("dedup.spans").cast("long").alias("n_spans"),
                       F.sha2("dedup.kept", 256).alias("kept_sha256"))


@query()
def op6_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard of 16 and its place there."""
    return hash_ring.assign(table(spark, sf_dir, "documents")).withColumns(
        {"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


@query()
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item or a part of one, with the items."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("""
SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, t, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size
      FROM (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents))""")
def op12_cuckoo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its content that stays."""
    index = cuckoo_dedup.insert(cuckoo_dedup.create(spark), table(spark, sf_dir, "documents"))
    return cuckoo_dedup.judged(spark, index).select(
        F.col("key").alias("doc_id"), F.col("keep_key").alias("keep_id"), "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
