"""Exact duplicates through an index of cuckoo filters over the digests of live contents.

Contents are equal when they are identical without white space; their digest is SHA-256. The index deals digests into buckets.
Each bucket has a cuckoo filter: rows of four slots with 16-bit fingerprints, two rows for each digest, and beside each slot the
content stored there: the whole digest, the number of live documents that have it and the best of them.

* A fingerprint that is in neither row is a miss: the content is new and takes a slot, moving others to their second rows.
* A hit is verified against the whole digests stored in the bucket, so a shared fingerprint never merges two contents.
* Where moving finds no free slot, the filter's rows are doubled and all are placed anew from the stored digests (fingerprints alone
  don't say where a digest goes in a larger filter). Where a bucket would hold too much, the index is dealt into more buckets.
* Deleting the last document of a content frees its slot. Where the best document is deleted and others stay, the best of these
  is read from the rows of documents, for such contents only.

``insert`` and ``delete`` write a new generation in the index's folder (filters, contents, rows of documents) and leave the one before, so
a failed job leaves nothing half done and lost executors repeat their own tasks. Texts stay where they are: what is shuffled is one
row of some 70 bytes for each content of a batch, so copies are combined before they meet in a bucket. A bucket's rows pass as a stream;
its memory is its distinct contents, some ``BUCKET_KEYS``.

Of the documents with one content the one with the most code points in its original text stays, then the one with the smallest key.

Defined cases: null counts as empty, and all empty or blank texts are one content; a null key comes after all others and can be deleted like
any; of repeated rows (key and text equal) one stays; very long texts are digested whole; an empty table gives an empty index and no
rows; keys are whole numbers; further columns pass through ``unique_rows`` whatever their names, ``judged`` returns its own columns only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm.common import scratch_path, unused, whole_text

BLANKS = " \t\n\x0b\x0c\r"
SLOTS = 4
KICKS = 200
BUCKET_KEYS = 50_000  # rows of documents for each bucket when the index is dealt
HOT_GROUPS = 4096  # groups of over rows / HOT_GROUPS are joined by broadcast: there can't be more of them than this
FILTER, CONTENT, CHANGE = 0, 1, 2
SCHEMA = ("bucket long, kind int, size int, prints binary, slot int, digest binary, n long, chars int, unkeyed boolean, key long, "
          "gen int, row long")
ARROW = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("size", pa.int32()), ("prints", pa.binary()), ("slot", pa.int32()),
                   ("digest", pa.binary()), ("n", pa.int64()), ("chars", pa.int32()), ("unkeyed", pa.bool_()), ("key", pa.int64()),
                   ("gen", pa.int32()), ("row", pa.int64())])


class Cuckoo:
    """A filter of 16-bit fingerprints with the stored contents ``[digest, n, best]`` beside the slots."""

    def __init__(self, size: int = 64):
        self.size, self.prints, self.items = size, [0] * (size * SLOTS), [None] * (size * SLOTS)

    def _print(self, digest: bytes) -> int:
        return int.from_bytes(digest[16:18], "little") or 1

    def _other(self, row: int, fingerprint: int) -> int:
        return row ^ (fingerprint * 0x9E3779B1 >> 7 & self.size - 1)

    def find(self, digest: bytes) -> int:
        """The slot of a live digest, or -1; every hit of a fingerprint is verified against the stored digest."""
        fingerprint = self._print(digest)
        row = int.from_bytes(digest[8:16], "little") & self.size - 1
        for r in (row, self._other(row, fingerprint)):
            at = r * SLOTS
            for slot in range(at, at + SLOTS):
                if self.prints[slot] == fingerprint and self.items[slot][0] == digest:
                    return slot
        return -1

    def insert(self, item: list) -> None:
        """Place a content that isn't live yet."""
        while not self._place(item):
            item = self._homeless
            self.resize()

    def _place(self, item: list) -> bool:
        fingerprint = self._print(item[0])
        row = int.from_bytes(item[0][8:16], "little") & self.size - 1
        for r in (row, self._other(row, fingerprint)):
            at = r * SLOTS
            for slot in range(at, at + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.items[slot] = fingerprint, item
                    return True
        for kick in range(KICKS):
            slot = row * SLOTS + kick % SLOTS
            fingerprint, self.prints[slot] = self.prints[slot], fingerprint
            item, self.items[slot] = self.items[slot], item
            row = self._other(row, fingerprint)
            at = row * SLOTS
            for slot in range(at, at + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.items[slot] = fingerprint, item
                    return True
        self._homeless = item
        return False

    def resize(self) -> None:
        """Twice the rows, filled again from the stored digests."""
        items = [i for i in self.items if i is not None]
        self.__init__(self.size * 2)
        for item in items:
            self.insert(item)

    def delete(self, slot: int) -> None:
        self.prints[slot], self.items[slot] = 0, None


def _best(chars: int, unkeyed: bool, key: int, gen: int, row: int) -> tuple:
    """Smaller is better: most characters, then the smallest key; the last two only tell repeated rows apart."""
    return (-chars, unkeyed, key, gen, row)


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Changes of one content in a batch as one row: how many documents, and the best of them."""
    for batch in batches:
        found: dict[tuple, list] = {}
        columns = (batch.column(c).to_pylist() for c in ("bucket", "digest", "n", "chars", "unkeyed", "key", "gen", "row"))
        for bucket, digest, n, chars, unkeyed, key, gen, row in zip(*columns):
            best = _best(chars, unkeyed, key, gen, row)
            own = found.setdefault((digest, n > 0), [bucket, 0, best])
            own[1] += n
            own[2] = min(own[2], best)
        if found:
            yield _rows((bucket, CHANGE, None, None, None, digest, n, best) for (digest, _), (bucket, n, best) in found.items())


def _rows(rows) -> pa.RecordBatch:
    flat = [(*r[:7], *(r[7] and (-r[7][0], *r[7][1:]) or (None,) * 5)) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*flat), ARROW)], schema=ARROW)


def _changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and kind: the stored filter, its contents, then the changes; gives the bucket's new rows."""
    bucket, cuckoo = None, Cuckoo()

    def finished() -> Iterator[pa.RecordBatch]:
        stored = [(bucket, CONTENT, None, None, slot, i[0], i[1], i[2]) for slot, i in enumerate(cuckoo.items) if i is not None]
        prints = b"".join(p.to_bytes(2, "little") for p in cuckoo.prints)
        yield _rows([(bucket, FILTER, cuckoo.size, prints, None, None, len(stored), None)])
        for k in range(0, len(stored), 10_000):
            yield _rows(stored[k:k + 10_000])

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ARROW.names)
        for of, kind, size, prints, slot, digest, n, chars, unkeyed, key, gen, row in zip(*columns):
            if of != bucket:
                if bucket is not None:
                    yield from finished()
                bucket, cuckoo = of, Cuckoo()
            if kind == FILTER:
                cuckoo = Cuckoo(size)
                cuckoo.prints = [int.from_bytes(prints[i:i + 2], "little") for i in range(0, len(prints), 2)]
                continue
            best = None if chars is None else _best(chars, unkeyed, key, gen, row)
            if kind == CONTENT:
                cuckoo.items[slot] = [digest, n, best]
                continue
            at = cuckoo.find(digest)
            if at < 0:
                if n > 0:
                    cuckoo.insert([digest, n, best])
                continue
            item = cuckoo.items[at]
            item[1] += n
            if item[1] <= 0:
                cuckoo.delete(at)
            elif n > 0:
                item[2] = item[2] and min(item[2], best)
            elif item[2] and item[2][:3] == best[:3]:
                item[2] = None  # the best document is gone: to be read from the others
    if bucket is not None:
        yield from finished()


@dataclass(frozen=True)
class Index:
    """A generation of the index: ``folder`` holds its files, ``buckets`` says how digests are dealt."""

    folder: str
    gen: int = 0
    buckets: int = 0

    def _stored(self, spark: SparkSession, kind: int) -> DataFrame:
        return spark.read.schema(SCHEMA).parquet(f"{self.folder}/index-{self.gen}").filter(F.col("kind") == kind)

    def filters(self, spark: SparkSession) -> DataFrame:
        """(bucket, size, prints, n): the cuckoo filters, for a lookup before anything else is read."""
        return self._stored(spark, FILTER).select("bucket", "size", "prints", "n")

    def contents(self, spark: SparkSession) -> DataFrame:
        """A row for each live content: its digest, number of documents, best document."""
        return self._stored(spark, CONTENT)

    def rows(self, spark: SparkSession) -> DataFrame:
        """A row for each live document: key, unkeyed, digest, chars, gen, row."""
        all_of = spark.read.schema(ROWS).parquet(*[f"{self.folder}/rows-{g}" for g in range(1, self.gen + 1)])
        deleted = all_of.filter("n < 0")
        if self.gen == 1 or deleted.isEmpty():
            return all_of.drop("n")
        gone = deleted.groupBy("unkeyed", "key", "digest").agg(F.max("gen").alias("until"))
        return (all_of.filter("n > 0").join(gone, ["unkeyed", "key", "digest"], "left")
                .filter("until IS NULL OR gen > until").drop("n", "until"))


ROWS = "unkeyed boolean, key long, digest binary, chars int, n int, gen int, row long"


def digested(df: DataFrame, key: str, text: str) -> DataFrame:
    """(unkeyed, key, digest, chars): what the index keeps of a document."""
    return df.select(*[c.alias(name) for name, c in _kept_of(key, text).items()])


def _kept_of(key: str, text: str) -> dict:
    whole = whole_text(text)
    return {"unkeyed": F.col(key).isNull(), "key": F.coalesce(F.col(key).cast("long"), F.lit(0)),
            "digest": F.unhex(F.sha2(F.translate(whole, BLANKS, ""), 256)), "chars": F.length(whole)}


def create(spark: SparkSession, folder: str | None = None) -> Index:
    """An empty index in a folder of the shared space."""
    return Index(folder or scratch_path(spark, "digests"))


def insert(index: Index, df: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """The next generation, with the documents of ``df``."""
    spark, gen = df.sparkSession, index.gen + 1
    path = f"{index.folder}/rows-{gen}"
    (digested(df, key, text).withColumns({"n": F.lit(1), "gen": F.lit(gen), "row": F.monotonically_increasing_id()})
     .write.parquet(path))
    rows = spark.read.schema(ROWS).parquet(path)
    total = rows.count() + (index.contents(spark).count() if index.gen else 0)
    buckets = max(index.buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if total > 2 * BUCKET_KEYS * buckets or not index.gen:  # dealt anew, from the stored digests
        buckets = max(buckets, -(-total // BUCKET_KEYS))
    return _next(spark, index, Index(index.folder, gen, buckets), rows)


def delete(index: Index, df: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """The next generation, without the live documents whose key and content are in ``df``; others in ``df`` change nothing."""
    spark, gen = df.sparkSession, index.gen + 1
    path = f"{index.folder}/rows-{gen}"
    if not index.gen:
        return insert(index, df.limit(0), key, text)
    asked = digested(df, key, text).select("unkeyed", "key", "digest").distinct()
    (index.rows(spark).join(asked, ["unkeyed", "key", "digest"], "left_semi")
     .select("unkeyed", "key", "digest", "chars", F.lit(-1).alias("n"), F.lit(gen).alias("gen"), "row").write.parquet(path))
    return _next(spark, index, Index(index.folder, gen, index.buckets), spark.read.schema(ROWS).parquet(path))


def _next(spark: SparkSession, old: Index, new: Index, rows: DataFrame) -> Index:
    """Write the new generation's filters and contents."""
    bucket = F.pmod(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"), F.lit(new.buckets)).alias("bucket")
    changes = (rows.select(bucket, "digest", "n", "chars", "unkeyed", "key", "gen", "row").mapInArrow(_combined, SCHEMA))
    if old.gen:
        stored = old._stored(spark, CONTENT)
        if old.buckets == new.buckets:
            stored = stored.unionByName(old._stored(spark, FILTER))
        else:
            stored = stored.withColumns({"bucket": bucket, "kind": F.lit(CHANGE), "slot": F.lit(None).cast("int")})
        changes = stored.unionByName(changes)
    path = f"{new.folder}/index-{new.gen}"
    done = changes.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_changed, SCHEMA)
    if not old.gen or rows.filter("n < 0").isEmpty():
        done.write.parquet(path)
        return new
    done.write.parquet(f"{path}-open")
    done = spark.read.schema(SCHEMA).parquet(f"{path}-open")
    open_ = done.filter((F.col("kind") == CONTENT) & F.col("chars").isNull()).select("digest")
    best = (new.rows(spark).join(open_, "digest", "left_semi").groupBy("digest")
            .agg(F.min(F.struct((-F.col("chars")).alias("less"), "unkeyed", "key", "gen", "row")).alias("best")))
    fields = {"chars": -F.col("best.less"), **{c: F.col(f"best.{c}") for c in ("unkeyed", "key", "gen", "row")}}
    (done.join(best, "digest", "left").withColumns({c: F.coalesce(c, v) for c, v in fields.items()}).drop("best")
     .select(*ARROW.names).write.parquet(path))
    return new


def judged(spark: SparkSession, index: Index) -> DataFrame:
    """A row for each live document: key, keep_key, group_size, kept, digest, chars.

    Groups so large that only a bounded number of them can exist are joined by broadcast, so no task receives a
    large group's rows; the rest are joined by digest.
    """
    rows, groups = index.rows(spark), index.contents(spark).select(
        "digest", F.col("n").alias("group_size"), F.expr("CASE WHEN NOT unkeyed THEN key END").alias("keep_key"),
        F.col("gen").alias("_gen"), F.col("row").alias("_row"))
    large = max(groups.agg(F.sum("group_size")).first()[0] or 0, HOT_GROUPS) // HOT_GROUPS
    hot = F.broadcast(groups.filter(F.col("group_size") > large))
    cold = rows.join(F.broadcast(groups.filter(F.col("group_size") > large).select("digest")), "digest", "left_anti")
    both = rows.join(hot, "digest").unionByName(cold.join(groups.filter(F.col("group_size") <= large), "digest"))
    return both.select(F.expr("CASE WHEN NOT unkeyed THEN key END").alias("key"), "keep_key", "group_size",
                       ((F.col("gen") == F.col("_gen")) & (F.col("row") == F.col("_row"))).alias("kept"), "digest", "chars")


def unique_rows(df: DataFrame, index: Index, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` (all of them in the index) that stay, with all their columns."""
    own = {c: unused(df, f"_own_{c}") for c in ("unkeyed", "key", "digest", "chars")}
    stay = (judged(df.sparkSession, index).filter("kept")
            .select(F.col("key").isNull().alias(own["unkeyed"]), F.coalesce("key", F.lit(0)).alias(own["key"]),
                    F.col("digest").alias(own["digest"]), F.col("chars").alias(own["chars"])))
    named = df.withColumns({own[name]: c for name, c in _kept_of(key, text).items()})
    return named.join(stay, list(own.values()), "left_semi").dropDuplicates(list(own.values())).select(*df.columns)
