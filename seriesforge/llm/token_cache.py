"""Token counts through a cache of digests.

A text is looked up by the digest of its content and the digest of the tokenizer's file. Known counts come
from the cache by a join; only distinct unknown contents are encoded, once each, and their counts are
appended. Copies are combined before the shuffle, so a group of copies of any size sends one row a task.

The cache is a Parquet folder (version, digest, n_tokens). An append is a Spark write, which shows its files
only when the job has ended; a lost executor repeats its own tasks. Two runs that append the same content
at the same time may leave two equal rows, hence the lookup takes one row a digest.

Content is normalised only where no tokenizer can tell the difference: null becomes empty, and text is
its UTF-8 bytes. Defined cases: null and empty texts count 0 tokens (unless the tokenizer gives an empty text some);
repeated rows each get their row; other columns of the input are not returned; an empty table gives none.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from tokenizers import Tokenizer

from seriesforge.llm.common import in_pieces, whole_text

# Fixed value: how byte-level tokenizers split a text before they merge.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
SCHEMA = "version string, digest binary, n_tokens long"


def tokenizer_file(path: str) -> tuple[str, str]:
    """The file's content and its digest, which is the tokenizer's version."""
    raw = Path(path).read_bytes()
    return raw.decode(), hashlib.sha256(raw).hexdigest()


def read_cache(spark, cache: str, version: str) -> DataFrame:
    """Counts stored for this version, one row a digest."""
    try:
        rows = spark.read.schema(SCHEMA).parquet(cache)
    except AnalysisException as e:  # nothing was ever stored
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], SCHEMA)
    return rows.filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


class Counter:
    """Counts tokens as the library does, without begin, end or added special tokens.

    A byte-level BPE without normaliser encodes each pre-token by itself, so a text's count is the sum over its pre-tokens, and only pre-tokens
    that the task hasn't met are encoded. ``KEPT`` of them are remembered, the first ones, among which are the frequent ones; pre-tokens of more
    than ``LONG`` characters are not. A text is split at the tokenizer's added tokens first, each of which is one token. Any other tokenizer encodes whole texts.
    """

    KEPT, LONG = 500_000, 32

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core already
        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = self._added(json.loads(model))
        self.known: dict[str, int] = {}

    @staticmethod
    def _added(model: dict):
        """The pattern of the added tokens where pre-tokens can be counted one by one, else None."""
        split, bpe, added = model.get("pre_tokenizer") or {}, model["model"], model.get("added_tokens") or []
        plain = (model.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
                 and bpe["type"] == "BPE" and not any(bpe.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk"))
                 and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")))
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        return regex.compile("|".join(map(regex.escape, names)) or "(?!)") if plain else None

    def counts(self, texts: list[str]) -> list[int]:
        if self.added is None:
            return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return [self._count(text) for text in texts]

    def _count(self, text: str) -> int:
        total, at = 0, 0
        for special in self.added.finditer(text):
            total += 1 + self._pieces(text, at, special.start())
            at = special.end()
        return total + self._pieces(text, at, len(text))

    def _pieces(self, text: str, at: int, to: int) -> int:
        words, total = PRE_TOKEN.finditer(text[at:to]) if to - at > 1 << 20 else iter(PRE_TOKEN.findall(text[at:to])), 0
        while part := [w if isinstance(w, str) else w[0] for w in islice(words, 200_000)]:
            counts = list(map(self.known.get, part))
            if None in counts:
                new = list({w for w, n in zip(part, counts) if n is None})
                fresh = {w: len(e.ids) for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False))}
                counts = [fresh[w] if n is None else n for w, n in zip(part, counts)]
                if len(self.known) < self.KEPT:
                    self.known.update((w, n) for w, n in fresh.items() if len(w) <= self.LONG)
            total += sum(counts)
        return total


@functools.lru_cache(maxsize=2)
def counter(model: str) -> Counter:
    """One for all tasks of a Python worker."""
    return Counter(model)


def count_misses(misses: DataFrame, model: str) -> DataFrame:
    """(digest, n_tokens) of rows (digest, text), one a content."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model)
        for batch in batches:
            n = [n for part in in_pieces(t.as_py() for t in batch.column("text")) for n in own.counts(part)]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return misses.mapInArrow(counts, "digest binary, n_tokens long")


def token_counts(docs: DataFrame, tokenizer_path: str, cache: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) of every row of ``docs``; what was unknown is added to ``cache``."""
    spark = docs.sparkSession
    model, version = tokenizer_file(tokenizer_path)
    keyed = docs.select(F.col(key).alias("key"), whole_text(text).alias("text")).withColumn(
        "digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    distinct = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(read_cache(spark, cache, version).select("digest"), "digest", "left_anti")
    (count_misses(misses, model).select(F.lit(version).alias("version"), "digest", "n_tokens")
     .write.mode("append").parquet(cache))
    return (
        keyed.select("key", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
        .join(read_cache(spark, cache, version), "digest")
        .select(F.col("key").alias(key), "n_bytes", "n_tokens")
    )
