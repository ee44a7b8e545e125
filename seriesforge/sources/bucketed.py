"""Series tables stored by key, so that windows and joins on the key need no shuffle later.

A written table keeps a hash of its key in the catalogue: bucket ``i`` of two tables with the same number of buckets holds the same keys. Whatever
partitions by the key afterwards (regular series, folds, models, joins of two such tables) reads its buckets where they are. Rows
of a bucket are written in order by one task each, so there is one file a bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET_ROWS = 1_000_000


def bucket_count(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """A power of two, so that tables of different sizes can still be joined by reading several buckets as one."""
    count = 1
    while count * bucket_rows < rows:
        count *= 2
    return count


def store(df: DataFrame, name: str, key: str | tuple[str, ...] = "series_id", order: tuple[str, ...] = ("idx",), buckets: int | None = None, path: str | None = None) -> DataFrame:
    """Write ``df`` as table ``name`` of the catalogue, bucketed by ``key`` and sorted inside buckets, and read it back."""
    buckets, keys = buckets or bucket_count(df.count()), (key,) if isinstance(key, str) else key
    writer = (df.repartition(buckets, *[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)
              .write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys, *order))
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def buckets_of(spark: SparkSession, name: str) -> int:
    """The number of buckets of a stored table."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Num Buckets'").collect()
    return int(rows[0].data_type) if rows else 0
