"""Accuracy measures, leaderboards, comparison of results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.operators.series import SEASON, by_series, whole

MEASURES = ("me", "rmse", "mae", "mpe", "mape", "mase", "acf1", "theils_u")


def with_seasonal_scale(split: DataFrame, season: int = SEASON) -> DataFrame:
    """Adds ``scale``, the unit of MASE: the mean absolute seasonal difference of the training part of each series."""
    step = F.when(F.col("part") == "train", F.abs(F.col("y") - F.lag("y", season).over(by_series())))
    return split.withColumn("_step", step).withColumn("scale", F.avg("_step").over(whole())).drop("_step")


def accuracy(rows: DataFrame, *keys: str, order: str = "idx") -> DataFrame:
    """Accuracy per ``keys`` of rows ``(part, y, yhat, scale)``; ``part`` tells training from test.

    Percentage measures leave out actual values of zero. Theil's U compares steps between neighbouring
    test months and is NULL on training rows. All measures share one partitioning by ``keys``.
    """
    if "series_id" not in keys:
        raise ValueError("accuracy is measured per series; average its result over series instead")
    ordered = Window.partitionBy(*keys).orderBy(order)
    cells = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    e, y, yhat = F.col("error"), F.col("y"), F.col("yhat")
    rows = rows.withColumn("error", y - yhat)
    rows = rows.withColumns({
        "_c": e - F.avg(e).over(cells),
        "_y0": F.lag("y").over(ordered),
        "_pct": F.when(y != 0, 100 * e / y),
    })
    # A forecast step and an actual step from the same previous actual value differ by the error.
    base = F.when(F.col("_y0") != 0, F.col("_y0"))
    rows = rows.withColumns({
        "_cc": F.col("_c") * F.lag("_c").over(ordered),
        "_miss": F.when(F.col("part") == "test", e / base),
        "_step": F.when((F.col("part") == "test") & e.isNotNull(), (y - F.col("_y0")) / base),
    })
    sq = lambda c: F.sum(c * c)
    lag1 = F.sum("_cc") / (F.count("_cc") + 1)
    level = F.try_divide(sq(F.col("_c")), F.count("_c"))
    return rows.groupBy(*keys).agg(
        F.count(e).alias("n"),
        F.avg(e).alias("me"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg("_pct").alias("mpe"),
        F.avg(F.abs("_pct")).alias("mape"),
        F.try_divide(F.avg(F.abs(e)), F.max("scale")).alias("mase"),
        F.try_divide(lag1, level).alias("acf1"),
        F.sqrt(F.try_divide(sq(F.col("_miss")), sq(F.col("_step")))).alias("theils_u"),
    )


def stack(frames: list[DataFrame]) -> DataFrame:
    """Result tables below each other, matched by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def leaderboard(metrics: DataFrame, measure: str, *ties: str, top: int | None = None,
                models: str | None = None) -> DataFrame:
    """Best first, in a total order; ``models`` filters model names regardless of case."""
    if models:
        metrics = metrics.filter(F.col("model").rlike(f"(?i){models}"))
    ranked = metrics.orderBy(F.col(measure).asc_nulls_last(), *ties)
    return ranked.limit(top) if top else ranked


def labelled(prefix: str | Column, model: Column | str = "model") -> Column:
    return F.concat_ws(" ", F.lit(prefix), model)


def compare(left: DataFrame, right: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """One row: rows on one side only, rows differing by more than ``tolerance``, largest difference."""
    a = left.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    b = right.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    both = a.join(b, keys, "full")
    gap = F.abs(F.col("_a") - F.col("_b"))
    one_missing = F.col("_in_a") & F.col("_in_b") & (F.col("_a").isNull() != F.col("_b").isNull())
    return both.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("_in_b").isNull()).alias("n_left_only"),
        F.count_if(F.col("_in_a").isNull()).alias("n_right_only"),
        F.count_if((gap > tolerance) | one_missing).alias("n_different"),
        F.max(gap).alias("max_gap"),
    )


def all_missing(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Groups without a single value."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count(value).alias("n_values")).filter(
        "n_values = 0").drop("n_values")
