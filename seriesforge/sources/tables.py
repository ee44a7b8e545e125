"""Parquet tables: scans, views, file listings, scratch space."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def read_table(spark: SparkSession, path: str, *columns: str, view: str | None = None,
               cache: bool = False) -> DataFrame:
    """Parquet scan of the named columns, on request registered (and cached) as a temp view."""
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    return register(df, view, cache) if view else df


def register(df: DataFrame, view: str, cache: bool = False) -> DataFrame:
    df.createOrReplaceTempView(view)
    if cache:
        df.sparkSession.catalog.cacheTable(view)
    return df


def list_files(spark: SparkSession, path: str, pattern: str = ".*") -> DataFrame:
    """Files below ``path`` whose full path matches ``pattern``; file contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length", "modificationTime")
        .filter(F.col("path").rlike(pattern))
    )


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, or an empty one of that schema where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below ``spark.checkpoint.dir``, which all executors share; in local mode below the warehouse where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/seriesforge/{name}-{uuid.uuid4().hex}"


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
