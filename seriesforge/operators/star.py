"""Facts joined to the series they belong to, and filters on either side."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesforge.functions.names import matches_any

# A key with more facts than this is split over several tasks.
HOT_ROWS = 1_000_000


def join_facts(dim: DataFrame, facts: DataFrame, key: str = "series_id", hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Every row of ``dim`` with its facts; a series without facts stays, with NULL fact columns.

    This is the outer join that keeps the dimension, written as matched part plus unmatched part. An outer join that
    keeps the small side can neither broadcast that side nor split a hot key of the large one; the inner join can do both. Whether
    a side is broadcast is left to Spark's size limit and to adaptive execution.

    A key with more than ``hot_rows`` facts is split into parts of about that size, and only its dimension row is copied to each part.
    With ``hot_rows`` None nothing is counted beforehand and hot keys are left to adaptive execution.
    """
    if hot_rows is None:
        matched = facts.join(dim, key, "inner")
        seen = facts.select(key).join(dim.select(key), key, "left_semi").distinct()
    else:
        counts = facts.groupBy(key).agg(F.count("*").alias("_rows"))
        matched = _join_by_part(dim, facts, counts, key, hot_rows)
        seen = counts.filter("_rows > 0")  # with its count, so that both uses share one aggregate
    unmatched = dim.join(seen, key, "left_anti")
    columns = [key, *[c for c in dim.columns if c != key], *[c for c in facts.columns if c != key]]
    return matched.select(*columns).unionByName(unmatched, allowMissingColumns=True)


def join_keys(few: DataFrame, many: DataFrame, key: str, hot_rows: int = HOT_ROWS, hint: str | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Inner join of a side with few rows a key to one with any number; a key with more than ``hot_rows`` rows is split. ``hint`` names
    the join where Spark can't know the sides' sizes, as behind an explode. ``counts`` (key, _rows) has the hot keys where they are
    known without counting; they are so few that they are broadcast."""
    counts = many.groupBy(key).agg(F.count("*").alias("_rows")) if counts is None else F.broadcast(counts)
    return _join_by_part(few, many, counts, key, hot_rows, hint)


def _join_by_part(dim: DataFrame, facts: DataFrame, counts: DataFrame, key: str, hot_rows: int, hint: str | None = None) -> DataFrame:
    """Inner join on (key, part); a key is split into as many parts as it has ``hot_rows`` facts.

    A fact's part depends on its values and on the task that read it: copies of one row spread too, and a recomputed
    task deals its rows out as before.
    """
    hot = counts.filter(F.col("_rows") > hot_rows).select(
        key, F.ceil(F.col("_rows") / hot_rows).cast("int").alias("_parts"))
    rest = [c for c in facts.columns if c != key]
    # Taken from the task that reads a fact, before any shuffle brings the facts of a key together.
    dealt = facts.withColumn("_salt", F.xxhash64(*rest, F.spark_partition_id()))
    part = F.coalesce(F.pmod("_salt", F.col("_parts")).cast("int"), F.lit(0))
    parted = dealt.join(hot, key, "left").withColumn("_part", part).drop("_parts", "_salt")
    last = F.coalesce(F.col("_parts"), F.lit(1)) - 1
    copies = dim.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), last))).drop("_parts")
    return parted.join(copies.hint(hint) if hint else copies, [key, "_part"], "inner").drop("_part")


def filter_series(dim: DataFrame, names: list[str] | None = None, units: list[str] | None = None,
                  name_column: str = "name", unit_column: str = "units") -> DataFrame:
    """Series whose name and unit each match one of the given patterns."""
    if names:
        dim = dim.filter(matches_any(name_column, names))
    if units:
        dim = dim.filter(matches_any(unit_column, units))
    return dim


def filter_dates(df: DataFrame, since: datetime.date | str | None = None,
                 before: datetime.date | str | None = None,
                 after: datetime.date | str | None = None, column: str = "date") -> DataFrame:
    """``since`` <= date, date < ``before``, date > ``after``."""
    date = F.col(column)
    if since is not None:
        df = df.filter(date >= F.lit(since).cast("date"))
    if before is not None:
        df = df.filter(date < F.lit(before).cast("date"))
    if after is not None:
        df = df.filter(date > F.lit(after).cast("date"))
    return df


def missing(column: str) -> Column:
    """NULL or empty."""
    return F.col(column).isNull() | (F.col(column).cast("string") == "")


def count_missing(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in all and, per column, rows where it is NULL or empty."""
    return df.agg(F.count("*").alias("n_rows"), *[F.count_if(missing(c)).alias(f"n_{c}") for c in columns])


def date_limits(df: DataFrame, column: str = "date") -> DataFrame:
    return df.agg(F.min(column).alias("min_date"), F.max(column).alias("max_date"))


@dataclass(frozen=True)
class Rule:
    """A titled pair of patterns for name and unit."""

    title: str
    name: str
    unit: str


def match_rules(dim: DataFrame, rules: list[Rule], name_column: str = "name",
                unit_column: str = "units") -> DataFrame:
    """One row per series and matching rule, with the title of the rule. Case does not matter.

    Name and unit have to match together on the same row. A row may match several rules. The rules are
    a short parameter list, so the match is a generator on each row: no join, no shuffle.
    """
    titles = F.array_compact(F.array(*[
        F.when(
            matches_any(name_column, [r.name], ignore_case=True)
            & matches_any(unit_column, [r.unit], ignore_case=True),
            F.lit(r.title),
        )
        for r in rules
    ]))
    return dim.withColumn("category", F.explode(titles))


def bucket_other(column: str, kept: list[str], other: str) -> Column:
    """The value itself when it is one of ``kept``, else ``other``."""
    return F.when(F.col(column).isin(*kept), F.col(column)).otherwise(F.lit(other))


def distinct_units(df: DataFrame, by: str, unit_column: str = "units") -> DataFrame:
    """Units per label as one text. Equal units collapse before they are shuffled."""
    units = F.array_join(F.array_sort(F.collect_set(unit_column)), ", ")
    return df.groupBy(by).agg(units.alias("unit_label"))


def tick_years(df: DataFrame, step: int = 2, column: str = "date") -> DataFrame:
    """Every ``step``-th distinct year in order; there are at most 9,999 of them."""
    years = df.agg(F.array_sort(F.collect_set(F.year(column))).alias("years"))
    return (
        years.select(F.posexplode("years").alias("pos", "year"))
        .filter(F.col("pos") % step == 0)
        .select("year")
    )
