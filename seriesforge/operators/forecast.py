"""Forecasts that plain aggregates can express, for any number of series at once.

Input is a regular series ``(series_id, idx, date, y[, x])``; output is long, one row per series and
horizon ``k``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesforge.operators.series import SEASON, by_series, whole

# Two-sided normal quantiles of the 80% and 95% prediction intervals.
NORMAL_QUANTILES = {80: 1.2815515655446004, 95: 1.959963984540054}


def seasonal_naive(df: DataFrame, h: int, season: int = SEASON) -> DataFrame:
    """The last season repeated ``h`` months into the future, with residual spread ``sigma``.

    Each of the last ``season`` rows is dealt out to the horizons it stands for; there is no join. A series
    shorter than a season keeps its rows, without a forecast.
    """
    residual = F.col("y") - F.lag("y", season).over(by_series())
    rows = df.withColumns({"_n": F.max("idx").over(whole()), "_end": F.max("date").over(whole()), "_e": residual})
    rows = rows.withColumn("sigma", F.sqrt(F.avg(F.col("_e") * F.col("_e")).over(whole())))
    first = F.col("idx") - F.col("_n") + season
    full = F.col("_n") >= season
    steps = F.when(full & (first >= 1) & (first <= h), F.sequence(first, F.lit(h), F.lit(season))).when(
        ~full & (F.col("idx") == F.col("_n")), F.sequence(F.lit(1), F.lit(h)))
    return rows.select(
        "series_id", F.col("_n").alias("origin"), F.when(full, F.col("y")).alias("yhat"), "sigma", "_end",
        F.explode(steps).alias("k"),
    ).select("series_id", "origin", "k", F.add_months("_end", F.col("k")).alias("date"), "yhat", "sigma")


def seasonal_naive_spread(k: Column, season: int = SEASON) -> Column:
    """Factor by which the spread grows with the number of seasons ahead."""
    return F.sqrt(F.floor((k - 1) / season) + 1)


def with_intervals(forecast: DataFrame, spread: Column) -> DataFrame:
    """Add lower and upper bounds; ``spread`` is the standard deviation of the forecast."""
    bounds = {}
    for level, z in NORMAL_QUANTILES.items():
        bounds[f"lo{level}"] = F.col("yhat") - z * spread
        bounds[f"hi{level}"] = F.col("yhat") + z * spread
    return forecast.withColumns(bounds)


def seasonal_naive_interval(df: DataFrame, h: int, season: int = SEASON) -> DataFrame:
    forecast = seasonal_naive(df, h, season)
    return with_intervals(forecast, F.col("sigma") * seasonal_naive_spread(F.col("k"), season))


def linear_trend(df: DataFrame, h: int) -> DataFrame:
    """Straight line through each series, extended ``h`` months. One aggregate per series."""
    line = df.groupBy("series_id").agg(
        F.max("idx").alias("origin"),
        F.max("date").alias("_end"),
        F.regr_slope("y", "idx").alias("slope"),
        F.regr_intercept("y", "idx").alias("intercept"),
    )
    return line.select("*", F.explode(F.sequence(F.lit(1), F.lit(h))).alias("k")).select(
        "series_id", "origin", "k", F.add_months("_end", F.col("k")).alias("date"), "slope", "intercept",
        (F.col("intercept") + F.col("slope") * (F.col("origin") + F.col("k"))).alias("yhat"),
    )


def regression(split: DataFrame) -> DataFrame:
    """Regression of ``y`` on ``x`` over the train rows, applied to the known ``x`` of the test rows.

    ``split`` comes from ``split_train_test``. Coefficients are a window aggregate over the series, so
    train and test rows are never joined.
    """
    y, x = (F.when(F.col("part") == "train", F.col(c)) for c in ("y", "x"))
    fitted = split.withColumns({
        "slope": F.regr_slope(y, x).over(whole()),
        "intercept": F.regr_intercept(y, x).over(whole()),
    })
    return fitted.filter(F.col("part") == "test").select(
        "series_id", "k", "date", "y", "slope", "intercept",
        (F.col("intercept") + F.col("slope") * F.col("x")).alias("yhat"),
    )


def seasonal_naive_test(test_length: int, season: int = SEASON) -> Column:
    """Seasonal naive forecast of the test rows of a split as lags on the windows of the series; NULL where
    the training part is shorter than a season. Horizon ``k`` takes the last training value of its own month."""
    k, choice = F.col("k"), F.lit(None).cast("double")
    for back in range(-(-test_length // season), 0, -1):
        choice = F.when(k <= back * season, F.lag("y", back * season).over(by_series())).otherwise(choice)
    return F.when((F.col("part") == "test") & (F.col("idx") - k >= season), choice)


def of_test_months(split: DataFrame, test_length: int) -> DataFrame:
    """Test rows with the forecasts of three models side by side: trend, regression on ``x``, seasonal naive.

    All are windows on the same partitioning and sort, so the split is read once and nothing is joined.
    """
    train = {c: F.when(F.col("part") == "train", F.col(c)) for c in ("y", "x", "idx")}
    rows = split.withColumns({
        "_b": F.regr_slope(train["y"], train["idx"]).over(whole()), "_a": F.regr_intercept(train["y"], train["idx"]).over(whole()),
        "_bx": F.regr_slope(train["y"], train["x"]).over(whole()), "_ax": F.regr_intercept(train["y"], train["x"]).over(whole()),
        "_naive": seasonal_naive_test(test_length),
    })
    return rows.filter(F.col("part") == "test").select(
        "series_id", "k", "y", (F.col("_a") + F.col("_b") * F.col("idx")).alias("Trend"),
        (F.col("_ax") + F.col("_bx") * F.col("x")).alias("Regression"), F.col("_naive").alias("Seasonal Naive"))
