"""Regular monthly series: gap-free index, lags, rolling means, differences, splits.

``monthly`` reduces facts to one row per series and month before anything is partitioned by series. From
there on a series has at most one row per calendar month, which bounds each window partition and each
packed array whatever the number of facts behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SEASON = 12
TASK_ROWS = 100_000  # facts whose series are one task's


def by_series(order: str = "idx", key: str = "series_id") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def trailing(rows: int | None = None, key: str = "series_id", order: str = "idx") -> WindowSpec:
    """The current row and all before it, or the last ``rows`` rows including the current one."""
    start = Window.unboundedPreceding if rows is None else 1 - rows
    return by_series(order, key).rowsBetween(start, Window.currentRow)


def whole(order: str = "idx", key: str = "series_id") -> WindowSpec:
    """All rows of the series. It names the order as the other windows do, so that they share a sort."""
    return by_series(order, key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def monthly(facts: DataFrame, value: str = "value", *others: str) -> DataFrame:
    """One row per series and month: mean of what falls in it. Combined before it is shuffled."""
    month = F.trunc("date", "month").alias("date")
    means = [F.mean(F.col(c).try_cast("double")).alias(c) for c in (value, *others)]
    return facts.filter(F.col("date").isNotNull()).groupBy("series_id", month).agg(*means)


def tasks_for(facts: DataFrame) -> int:
    """Tasks that hold the series of about ``TASK_ROWS`` facts each; of a table as it is stored only the files' footers are read."""
    return max(facts.sparkSession.sparkContext.defaultParallelism, -(-facts.count() // TASK_ROWS))


def regular(months: DataFrame, key: str = "series_id", tasks: int | None = None) -> DataFrame:
    """Fill missing months with NULL rows and number the months of each series from 1 (``idx``).

    The input has one row per series and month, as ``monthly`` gives it; rows without a date are left out.
    Each row is repeated up to the month before the next one, so the spine needs no join: one shuffle by
    series serves this step and every window after it. It deals the series over ``tasks`` tasks; without that Spark merges
    what it shuffles to about as many tasks as there are cores, and what a task sorts grows with the facts.
    """
    w = by_series("date", key)
    if tasks:
        months = months.repartition(tasks, key)
    others = [c for c in months.columns if c not in (key, "date")]
    ahead = _month_number(F.lead("date").over(w)) - _month_number(F.col("date"))
    step = F.greatest(F.coalesce(ahead, F.lit(1)), F.lit(1))
    spaced = months.filter(F.col("date").isNotNull()).withColumns({
        "_idx": _month_number(F.col("date")) - _month_number(F.min("date").over(whole("date", key))) + 1,
        "_step": step,
    })
    filled = spaced.select("*", F.explode(F.sequence(F.lit(0), F.col("_step") - 1)).alias("_skip"))
    return filled.select(
        key,
        (F.col("_idx") + F.col("_skip")).alias("idx"),
        F.add_months("date", F.col("_skip")).alias("date"),
        *[F.when(F.col("_skip") == 0, F.col(c)).alias(c) for c in others],
    )


def _month_number(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date)


def lagged(df: DataFrame, column: str, steps: int = 1, name: str | None = None) -> DataFrame:
    """Value ``steps`` months earlier. Take it before cutting dates, or the first kept row has none."""
    return df.withColumn(name or f"{column}_lag{steps}", F.lag(column, steps).over(by_series()))


def rolling_mean(df: DataFrame, column: str, width: int, name: str | None = None) -> DataFrame:
    """Mean of the last ``width`` months, NULL until all of them have a value."""
    w = trailing(width)
    full = F.count(column).over(w) == width
    return df.withColumn(name or f"{column}_mean{width}", F.when(full, F.avg(column).over(w)))


def difference(df: DataFrame, column: str, order: int = 0, seasonal_order: int = 0,
               season: int = SEASON, name: str = "diff") -> DataFrame:
    """``order`` plain and ``seasonal_order`` seasonal differences, as one sum of lagged values."""
    w = by_series()
    total = F.lit(0.0)
    for shift, weight in difference_weights(order, seasonal_order, season).items():
        total = total + weight * (F.lag(column, shift).over(w) if shift else F.col(column))
    return df.withColumn(name, total)


def difference_weights(order: int, seasonal_order: int, season: int = SEASON) -> dict[int, int]:
    """Coefficients of (1 - B)^order (1 - B^season)^seasonal_order by lag."""
    weights = {0: 1}
    for step in [1] * order + [season] * seasonal_order:
        shifted = {lag + step: -w for lag, w in weights.items()}
        weights = {lag: weights.get(lag, 0) + shifted.get(lag, 0) for lag in {*weights, *shifted}}
    return dict(sorted((lag, w) for lag, w in weights.items() if w))


def split_train_test(df: DataFrame, test_length: int, overlap: int = 0) -> DataFrame:
    """Mark each row ``train`` or ``test`` and number the test rows by horizon.

    The last ``test_length`` months are the test set. ``overlap`` starts it that many rows early; those
    rows then belong to both sets and come out twice.
    """
    n = F.col("_n")
    train, test = F.col("idx") <= n - test_length, F.col("idx") > n - test_length - overlap
    parts = F.array_compact(F.array(F.when(train, F.lit("train")), F.when(test, F.lit("test"))))
    rows = df.withColumn("_n", F.max("idx").over(whole()))
    rows = rows.select(*df.columns, "_n", F.explode(parts).alias("part"))
    return rows.withColumn("k", F.when(F.col("part") == "test", F.col("idx") - (n - test_length))).drop("_n")


def with_regressor(df: DataFrame, regressor: DataFrame, lag: int = 1, name: str = "x") -> DataFrame:
    """Add the value of one common monthly ``regressor(date, x)``, ``lag`` months earlier, by date.

    After the aggregation the regressor has one row per calendar month; that bound is what allows the
    broadcast, however many series it is joined to.
    """
    by_month = regressor.filter(F.col("date").isNotNull()).groupBy("date").agg(F.mean(name).alias(name))
    shifted = by_month.withColumn("date", F.add_months("date", lag))
    return df.join(F.broadcast(shifted), "date", "left").select(*df.columns, name)
