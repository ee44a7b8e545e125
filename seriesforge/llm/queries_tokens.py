"""Queries on tokenizers: counts through the digest cache, byte-level BPE."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm import byte_bpe, token_cache
from seriesforge.llm.common import query, scratch_path, table

TOKEN_LIMIT = 512


@functools.cache
def codec(path: str) -> byte_bpe.Codec:
    return byte_bpe.Codec(byte_bpe.load_ranks(path), public_tokenizers.PATTERN)


@query()
def op5_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Token counts of every document, through a cache that starts empty."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    counts = token_cache.token_counts(table(spark, sf_dir, "documents"), path, scratch_path(spark, "token-counts"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def default_codec(ranks: str | None = None) -> byte_bpe.Codec:
    return codec(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"))


def encoded_documents(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """Documents encoded and decoded again, as digests."""
    own = default_codec(ranks)
    both = byte_bpe.encode_and_decode(docs.select("doc_id", "text"), own)
    return both.select("doc_id", byte_bpe.n_ids("bpe.ids").alias("n_tokens"), F.sha2("bpe.ids", 256).alias("ids_sha256"),
                       F.sha2("bpe.decoded", 256).alias("decoded_sha256"))


@query()
def op9_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    """Every whole document encoded with the rank vocabulary, and decoded from its ids."""
    return encoded_documents(table(spark, sf_dir, "documents"), ranks)
