"""The two analysis tables: series by category, and one column per category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.functions.clean import to_double
from seriesforge.functions.names import column_name, label_before_comma, matches_any
from seriesforge.operators.reshape import pivot_mean
from seriesforge.operators.star import Rule, bucket_other, filter_dates, join_facts, match_rules


def category_series(dim: DataFrame, facts: DataFrame, rules: list[Rule]) -> DataFrame:
    """Observations of every series some rule matches, once per rule, as ``(category, series_id, label, units,
    date, value)``. Rules are matched on the dimension, before any fact is touched."""
    series = match_rules(dim.select("series_id", "name", "units"), rules)
    series = series.withColumn("label", label_before_comma("name"))
    rows = join_facts(series, facts, hot_rows=None).withColumn("value", to_double("value"))
    return rows.select("category", "series_id", "label", "units", "date", "value")


def wide_table(dim: DataFrame, facts: DataFrame, pattern: str, replacement: str, categories: list[str],
               since: str | None = None, before: str | None = None, after: str | None = None,
               other: str | None = None) -> DataFrame:
    """One row per month, one column per category: the mean over the series whose name gives that column.

    ``pattern`` selects the series and, with ``replacement``, names their columns. With ``other`` all names
    outside ``categories`` share the column of that name. Dates are cut before the join, in the scan.
    """
    series = dim.filter(matches_any("name", [pattern])).select(
        "series_id", column_name("name", pattern, replacement).alias("name"))
    facts = filter_dates(facts, since=since, before=before, after=after)
    rows = join_facts(series, facts, hot_rows=None).filter(F.col("date").isNotNull())
    rows = rows.withColumn("value", to_double("value"))
    columns = list(categories)
    if other:
        rows = rows.withColumn("name", bucket_other("name", categories, other))
        columns.append(other)
    return pivot_mean(rows, "date", "name", "value", columns)
