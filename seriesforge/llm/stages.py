"""Stages of the corpus pipeline: each takes documents and returns those it keeps, with the columns of documents.

All columns pass through, also ones that documents usually don't have. Null and empty texts fail the quality rules. Rows that
share a doc_id are near duplicates or not together; of rows equal in doc_id and text one stays. Rows without a doc_id can't be
named as duplicates and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm import byte_bpe, decontaminate, near_copies, quality_gbt, suffix_dedup
from seriesforge.llm.common import table, unused
from seriesforge.llm.queries_tokens import default_codec


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trees keep."""
    model = quality_gbt.quality_model(docs, table(spark, sf_dir, "labels"))
    out = unused(docs, "_judged")
    return quality_gbt.judge(docs, model, out=out).filter(F.col(out)["kept"]).drop(out)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (SimHash, then five words at Jaccard 0.8): the one with the smallest id."""
    found = near_copies.near_copies(docs)
    first = found.filter("doc_id = component").select("doc_id").distinct()
    named = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that a document with a smaller id has too, cut at whole characters."""
    out = unused(docs, "_dedup")
    done = suffix_dedup.remove_repeats(docs, whole_characters=True, out=out)
    text = F.decode(F.col(out)["kept"], "UTF-8")
    kept = done.withColumns({"text": text, "n_chars": F.length(text).cast("long")})
    return kept.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, packed, with digests of the ids and of what they decode to."""
    both = byte_bpe.encode_and_decode(docs.select("doc_id", "text"), default_codec())
    return both.select("doc_id", byte_bpe.n_ids("bpe.ids").alias("n_tokens"), F.col("bpe.ids").alias("ids"),
                       F.sha2("bpe.ids", 256).alias("ids_sha256"), F.sha2("bpe.decoded", 256).alias("decoded_sha256"))
