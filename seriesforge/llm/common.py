"""What several operators share: the queries' registry, shared scratch space, texts in bounded pieces."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows if there is one."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; only in local mode below the warehouse where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def brief_shuffles(spark: SparkSession):
    """Shuffle files of an action on a table that is made in here go when the action ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: later reads take files of the shared folder, whichever executors are lost, and its shuffles go at once."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    with brief_shuffles(spark):
        return df.select("*").checkpoint()


def written(df: DataFrame, path: str) -> DataFrame:
    """The same rows in files of the shared folder, for later reads; its shuffles go at once."""
    spark = df.sparkSession
    with brief_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as keep it apart from the columns there are."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def whole_text(column: str):
    """The text as UTF-8 string; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def map_column(df: DataFrame, column: str, out: str, kind: str, make: Callable, limit: int = 1 << 20) -> DataFrame:
    """Adds ``out`` (a type of Spark) from a column of strings or bytes, about ``limit`` bytes at a time.

    ``make()`` is called once a task and gives the function from a list of values to a list of results. All other columns
    pass as one struct, so names can't clash, and a task holds the results of a slice only, not of a whole batch.
    """
    rest = [c for c in df.columns if c != out]
    rows = df.select(F.struct(*rest).alias("_row"))
    schema = T.StructType([rows.schema["_row"], *T.StructType.fromDDL(f"_out {kind}")])
    arrow = to_arrow_schema(schema).field("_out").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            row = batch.column("_row")
            values = row.field(column)
            ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(values):
                to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")), at + 1)
                got = pa.array(function(values.slice(at, to - at).to_pylist()), arrow)
                yield pa.RecordBatch.from_arrays([row.slice(at, to - at), got], ["_row", "_out"])
                at = to

    return rows.mapInArrow(run, schema).select("_row.*", F.col("_out").alias(out))


def in_pieces(texts: Iterable[str], limit: int = 1 << 19) -> Iterator[list[str]]:
    """Consecutive texts in lists of about ``limit`` characters, so that what is derived from a list stays small."""
    part: list[str] = []
    size = 0
    for text in texts:
        if part and size + len(text) > limit:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part
