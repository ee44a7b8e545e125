"""Bulk files: JSON lines, one record per series with its whole history nested in ``data``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The fields of the two bulk layouts, in file order.
ELECTRICITY_TEXT_FIELDS = (
    "copyright", "description", "end", "f", "geography", "iso3166", "lat", "latlon", "lon", "name",
    "source", "start", "units", "last_updated",
)
TOTAL_TEXT_FIELDS = (
    "category_id", "f", "name", "notes", "parent_category_id", "units", "end", "start", "last_updated",
)
KEY_FIELD = "series_id"
MONTHLY = "M"

_TEXT = T.StringType()
_HISTORY = T.ArrayType(T.ArrayType(_TEXT))


def _layout(text_fields: tuple[str, ...], *nested: T.StructField) -> T.StructType:
    text = [T.StructField(name, _TEXT) for name in text_fields]
    key = T.StructField(KEY_FIELD, _TEXT, nullable=False)
    return T.StructType([*text, key, T.StructField("data", _HISTORY), *nested])


ELECTRICITY_SCHEMA = _layout(ELECTRICITY_TEXT_FIELDS)
TOTAL_SCHEMA = _layout(TOTAL_TEXT_FIELDS, T.StructField("childseries", T.ArrayType(_TEXT)))


def read_bulk(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Scan JSON lines under a given schema; broken lines become all-NULL rows."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def keep_frequency(raw: DataFrame, frequency: str = MONTHLY) -> DataFrame:
    """Series of one frequency that have an id.

    A file source reports the key as nullable whatever its schema says, so the key is filtered. Category
    records and broken lines have no ``f`` and go out here as well.
    """
    return raw.filter((F.col("f") == frequency) & F.col(KEY_FIELD).isNotNull())
