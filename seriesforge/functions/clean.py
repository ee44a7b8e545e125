"""Turning the text of a bulk file into typed, null-clean columns.

Every conversion gives NULL on malformed text instead of failing the job, whether or not the session
runs in ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that stand for "no value", and the text formats of the bulk files.
SENTINELS = ("", "null")
STAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ssXXX"
PERIOD_FORMAT = "yyyyMM"


def null_sentinels(df: DataFrame) -> DataFrame:
    """Set sentinel texts to NULL in every top-level string column; other columns stay as they are."""
    return df.replace({text: None for text in SENTINELS})


def null_if_sentinel(col: Column) -> Column:
    return F.when(~col.isin(*SENTINELS), col)


def to_double(col: Column | str) -> Column:
    return F.col(col).try_cast("double") if isinstance(col, str) else col.try_cast("double")


def to_int(col: Column | str) -> Column:
    return F.col(col).try_cast("int") if isinstance(col, str) else col.try_cast("int")


def to_stamp(col: Column | str) -> Column:
    return F.try_to_timestamp(col, F.lit(STAMP_FORMAT))


def period_to_date(col: Column | str) -> Column:
    """First day of the month of a ``yyyyMM`` text."""
    return F.try_to_date(col, PERIOD_FORMAT)
