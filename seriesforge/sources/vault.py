"""Incremental backup of a table's files: a manifest for each run, and every content stored once.

A run lists the source's files and compares them with the manifest of the run before. Files with the same path, length and time of change are
kept without being read. Of the others the checksums are taken, and only contents that the vault doesn't hold are copied into it; a file that was
only renamed or rewritten alike is linked to the content there is. Files that are gone are dropped from the manifest; ``compacted`` writes a vault
with nothing but the contents of a run.

Layout below the vault's folder, all of it Parquet on any file system Spark can write: ``contents/<run>`` (checksum, part, content),
``manifests/<run>``, and ``commits``, whose row is written last. A run that is lost half-way isn't in ``commits``, so nothing of it counts.
Contents go from file to vault within a task and are never shuffled. They are stored in pieces of ``PIECE`` bytes, of which a batch is bounded
whatever the files' length; vaults from before, whose contents have no part, are read as contents of one piece. Paths and lengths of changed files pass through the driver, which
lists all files of a source anyway before Spark reads it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from seriesforge.sources.tables import list_files, stored

COMMITS = "run string, number int"
MANIFEST = "path string, length long, modified timestamp, checksum string, stored_in string, action string"
CONTENTS = "checksum string, part int, content binary"
BLOCK, PIECE = 1 << 20, 1 << 12  # bytes; batches for Python count rows, 10,000 by default
DROPPED = "dropped"


def runs(spark: SparkSession, vault: str) -> DataFrame:
    """(run, number) of all complete runs."""
    return stored(spark, f"{vault.rstrip('/')}/commits", COMMITS)


def _latest(spark: SparkSession, vault: str) -> tuple[str | None, int]:
    row = runs(spark, vault).orderBy(F.desc("number")).first()
    return (row.run, row.number) if row else (None, 0)


def manifest(spark: SparkSession, vault: str, run: str | None = None) -> DataFrame:
    """What a run (the last one, if none is given) did with each file: kept, copied, linked or dropped."""
    run = run or _latest(spark, vault)[0]
    return spark.read.schema(MANIFEST).parquet(f"{vault.rstrip('/')}/manifests/{run}") if run else spark.createDataFrame([], MANIFEST)


def live(spark: SparkSession, vault: str, run: str | None = None) -> DataFrame:
    """The files that a run holds."""
    return manifest(spark, vault, run).filter(F.col("action") != DROPPED)


def _relative(root: str):
    """A file's path below the root; listings may spell the root's scheme differently."""
    tail = urlsplit(root).path.rstrip("/") + "/"
    return F.expr("substring(path, locate('{0}', path) + {1})".format(tail.replace("'", "\\'"), len(tail)))


def _read(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths)


def _pieces(contents: DataFrame) -> DataFrame:
    """Contents cut into pieces, an empty one into one; first into blocks, so that no row of a whole file is repeated for each piece."""
    def cut(df: DataFrame, size: int) -> DataFrame:
        last = F.greatest(F.ceil(F.length("content") / size) - 1, F.lit(0)).cast("int")
        rows = df.select("checksum", "part", "content", F.explode(F.sequence(F.lit(0), last)).alias("at"))
        return rows.select("checksum", (F.col("part") * (BLOCK // PIECE if size == PIECE else 1) + F.col("at")).alias("part"),
                           F.expr(f"substring(content, at * {size} + 1, {size})").alias("content"))

    return cut(cut(contents.withColumn("part", F.lit(0)), BLOCK), PIECE)


def _stored_pieces(spark: SparkSession, vault: str, held: DataFrame) -> DataFrame | None:
    """(stored_in, checksum, part, content) of the folders that hold the contents of ``held``."""
    folders = [f"{vault.rstrip('/')}/contents/{r.stored_in}" for r in held.select("stored_in").distinct().collect()]  # at most one a run
    return spark.read.schema(CONTENTS).parquet(*folders).select(
        F.regexp_extract("_metadata.file_path", "([^/]+)/[^/]+$", 1).alias("stored_in"), "checksum", "part", "content") if folders else None


def back_up(spark: SparkSession, source: str, vault: str, pattern: str = r"/[^_.][^/]*$") -> str:
    """One run: bring the vault up to date with the files of ``source`` whose names match; gives the run's id."""
    vault, (before, number), run = vault.rstrip("/"), _latest(spark, vault), uuid.uuid4().hex
    now = list_files(spark, source, pattern).select("path", _relative(source).alias("name"), "length", F.col("modificationTime").alias("modified"))
    old = live(spark, vault, before).select(F.col("path").alias("name"), F.col("length").alias("old_length"), F.col("modified").alias("old_modified"),
                                            "checksum", "stored_in")
    both = now.join(old, "name", "full_outer").withColumn("action", F.when(F.col("path").isNull(), DROPPED).when(
        F.col("length").eqNullSafe(F.col("old_length")) & F.col("modified").eqNullSafe(F.col("old_modified")), "kept"))
    work = f"{vault}/work/{run}"
    both.write.parquet(f"{work}/compared")
    both = spark.read.parquet(f"{work}/compared")
    changed = both.filter("action IS NULL").select("path", "name", "length", "modified", F.col("checksum").alias("was"))
    # Checksums of changed files only.
    paths = [r.path for r in changed.select("path").collect()]
    sums = "path string, checksum string"
    if paths:
        _read(spark, paths).select("path", F.sha2("content", 256).alias("checksum")).write.parquet(f"{work}/sums")
    seen = changed.join(stored(spark, f"{work}/sums", sums), "path")
    held = old.select("checksum", "stored_in").groupBy("checksum").agg(F.min("stored_in").alias("stored_in"))
    placed = seen.join(held, "checksum", "left")
    # Of several files with one new content the first is copied, the others are linked to it.
    first = placed.filter("stored_in IS NULL").groupBy("checksum").agg(F.min("path").alias("first"))
    placed = placed.join(first, "checksum", "left").withColumn("action", F.when(F.col("checksum").eqNullSafe(F.col("was")), "kept").when(
        F.col("stored_in").isNull() & (F.col("path") == F.col("first")), "copied").otherwise("linked"))
    done = both.filter("action IS NOT NULL").select(
        F.col("name").alias("path"), F.coalesce("length", "old_length").alias("length"), F.coalesce("modified", "old_modified").alias("modified"),
        "checksum", "stored_in", "action").unionByName(placed.select(
            F.col("name").alias("path"), "length", "modified", "checksum", F.coalesce("stored_in", F.lit(run)).alias("stored_in"), "action"))
    new = [r["first"] for r in first.select("first").collect()]
    if new:
        _pieces(_read(spark, new).select(F.sha2("content", 256).alias("checksum"), "content")).write.parquet(f"{vault}/contents/{run}")
    done.write.parquet(f"{vault}/manifests/{run}")
    spark.createDataFrame([(run, number + 1)], COMMITS).write.mode("append").parquet(f"{vault}/commits")
    return run


def summary(spark: SparkSession, vault: str) -> DataFrame:
    """(number, action, n_files, n_bytes) of all runs."""
    parts = None
    for row in runs(spark, vault).orderBy("number").collect():  # one row a run
        own = manifest(spark, vault, row.run).groupBy("action").agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))
        own = own.select(F.lit(row.number).alias("number"), "action", "n_files", "n_bytes")
        parts = own if parts is None else parts.unionByName(own)
    return parts if parts is not None else spark.createDataFrame([], "number int, action string, n_files long, n_bytes long")


def pieces(spark: SparkSession, vault: str, run: str | None = None) -> DataFrame:
    """(path, part, content) of the files that a run holds, in pieces."""
    held = live(spark, vault, run).select("path", "checksum", "stored_in")
    stored_pieces = _stored_pieces(spark, vault, held)
    if stored_pieces is None:
        return spark.createDataFrame([], "path string, part int, content binary")
    return held.join(stored_pieces, ["checksum", "stored_in"]).select("path", "part", "content")


def files(spark: SparkSession, vault: str, run: str | None = None) -> DataFrame:
    """(path, content) of the files that a run holds; each is one value."""
    return pieces(spark, vault, run).groupBy("path").agg(F.expr("listagg(content) WITHIN GROUP (ORDER BY part)").alias("content"))


def restored(spark: SparkSession, vault: str, schema, run: str | None = None) -> DataFrame:
    """The rows of a backed-up Parquet table as a run holds them, in the given schema; columns that only folder names hold are not among them."""
    target = spark.createDataFrame([], schema).schema
    arrow = to_arrow_schema(target)

    def read(file) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        file.flush()
        for part in pq.ParquetFile(file.name, buffer_size=BLOCK, pre_buffer=False).iter_batches(columns=arrow.names):
            yield pa.Table.from_batches([part]).select(arrow.names).cast(arrow).combine_chunks().to_batches()[0] if part.num_rows else part

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces in order; a file is put together on the task's disk and read from there."""
        path, file = None, None
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                if name.as_py() != path:
                    if file:
                        yield from read(file)
                        file.close()
                    path, file = name.as_py(), tempfile.NamedTemporaryFile()
                file.write(content.as_buffer())
        if file:
            yield from read(file)
            file.close()

    in_order = pieces(spark, vault, run).repartition("path").sortWithinPartitions("path", "part")
    return in_order.mapInArrow(rows, target)


def compacted(spark: SparkSession, vault: str, target: str, run: str | None = None) -> str:
    """A vault of one run at ``target``: the contents that a run of ``vault`` holds, and nothing else."""
    new, held = uuid.uuid4().hex, live(spark, vault, run)
    contents = _stored_pieces(spark, vault, held)
    if contents is not None:
        wanted = held.groupBy("checksum").agg(F.min("stored_in").alias("stored_in"))
        contents.join(wanted, ["checksum", "stored_in"], "left_semi").select("checksum", "part", "content").write.parquet(f"{target.rstrip('/')}/contents/{new}")
    held.withColumns({"stored_in": F.lit(new), "action": F.lit("copied")}).write.parquet(f"{target.rstrip('/')}/manifests/{new}")
    spark.createDataFrame([(new, 1)], COMMITS).write.mode("append").parquet(f"{target.rstrip('/')}/commits")
    return new
