"""Long to wide and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot_mean(df: DataFrame, index: str, category: str, value: str,
               categories: list[str] | None = None) -> DataFrame:
    """One row per ``index``, one column per category, holding the mean.

    With ``categories`` the extra job that looks for them is saved. Without, Spark itself refuses more
    than ``spark.sql.pivotMaxValues`` of them.
    """
    return df.groupBy(index).pivot(category, categories).agg(F.mean(value))


def melt(df: DataFrame, ids: list[str], values: list[str] | None = None, variable: str = "variable",
         value: str = "value") -> DataFrame:
    """One row per id row and value column; NULLs stay."""
    return df.unpivot(ids, values, variable, value)


def seasonal_profile(df: DataFrame, keys: list[str], date: str = "date", value: str = "value") -> DataFrame:
    """Per key and year, the mean of each month in the columns ``m1`` to ``m12``."""
    months = df.select(*keys, F.year(date).alias("year"), F.month(date).alias("_month"), F.col(value))
    wide = months.groupBy(*keys, "year").pivot("_month", list(range(1, 13))).agg(F.mean(value))
    return wide.withColumnsRenamed({str(m): f"m{m}" for m in range(1, 13)})
