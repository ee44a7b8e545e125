"""Checked intake of a bulk file: one scan, broken lines put aside, and counters of what is wrong that the write itself collects.

A line that isn't a record of the layout goes to the quarantine with its text and the reason, and never to the tables. What is wrong inside a
record (a stamp, a period, a number that can't be read) leaves a NULL there, as everywhere, and is counted. The counters are observed
while the records are written, so they cost no scan and no job of their own, and they describe exactly what was written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesforge.functions.clean import SENTINELS, period_to_date, to_double, to_stamp
from seriesforge.sources.bulk import KEY_FIELD

BROKEN = "_broken"
REASON = "_reason"


def _wrong(text: Column, parsed: Column) -> Column:
    """A text that says something which can't be read."""
    return text.isNotNull() & ~text.isin(*SENTINELS) & parsed.isNull()


def reason() -> Column:
    """Why a line can't be used; null for a record."""
    return F.when(F.col(BROKEN).isNotNull(), "not a record").when(F.col(KEY_FIELD).isNull() & F.col("f").isNotNull(), "no id")


def counters() -> dict[str, Column]:
    """Aggregates over lines with their reason: lines by kind, and what is wrong inside records."""
    good = F.col(REASON).isNull()
    history = F.when(good, F.coalesce("data", F.array().cast("array<array<string>>"))).otherwise(F.array().cast("array<array<string>>"))
    period, value = (lambda p: F.get(p, F.lit(0))), (lambda p: F.get(p, F.lit(1)))

    def inside(test) -> Column:
        return F.coalesce(F.sum(F.size(F.filter(history, test))), F.lit(0))

    return {
        "n_lines": F.count("*"),
        "n_broken": F.count_if(F.col(REASON) == "not a record"),
        "n_without_id": F.count_if(F.col(REASON) == "no id"),
        "n_records": F.count_if(good),
        "n_bad_stamps": F.count_if(good & _wrong(F.col("last_updated"), to_stamp("last_updated"))),
        "n_pairs": inside(lambda p: F.lit(True)),
        "n_bad_dates": inside(lambda p: period_to_date(period(p)).isNull()),
        "n_bad_numbers": inside(lambda p: _wrong(value(p), to_double(value(p)))),
    }


def take_in(spark: SparkSession, path: str | list[str], schema: T.StructType, target: str) -> dict[str, int]:
    """Write the records and the quarantine of a bulk file below ``target`` in one pass; gives the counters.

    ``records`` and ``quarantine`` read them back.
    """
    # The key may be missing on a broken line, so nothing is required while reading.
    lines = T.StructType([*[T.StructField(f.name, f.dataType) for f in schema], T.StructField(BROKEN, T.StringType())])
    raw = spark.read.schema(lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).json(path)
    observation = Observation("intake")
    told = raw.withColumn(REASON, reason()).observe(observation, *[c.alias(name) for name, c in counters().items()])
    told.withColumn("set_aside", F.col(REASON).isNotNull()).write.mode("overwrite").partitionBy("set_aside").parquet(target)
    return observation.get


def _part(spark: SparkSession, target: str, schema: T.StructType, set_aside: bool) -> DataFrame:
    lines = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType()), T.StructField(REASON, T.StringType()), T.StructField("set_aside", T.BooleanType())])
    return spark.read.schema(lines).parquet(target).filter(F.col("set_aside") == set_aside)


def records(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """The usable records, with the columns of the layout."""
    return _part(spark, target, schema, False).select(*schema.fieldNames())


def quarantine(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """(reason, line) of what was put aside; a record without id is given as JSON again."""
    rows = _part(spark, target, schema, True)
    return rows.select(F.col(REASON).alias("reason"), F.coalesce(BROKEN, F.to_json(F.struct(*schema.fieldNames()))).alias("line"))
