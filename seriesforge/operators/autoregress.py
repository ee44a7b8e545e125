"""Autoregression of order one by conditional least squares, for any number of series and folds at once.

With one AR term, a constant and no MA term, conditional least squares is the regression of a value on the one before. So
coefficients, residuals, score, forecasts, intervals and folds are window aggregates; no row goes to Python and nothing is joined. A
month whose own or earlier value is missing takes no part. Input is a regular series ``(series_id, idx, date, y)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.operators.backtest import _errors
from seriesforge.operators.forecast import with_intervals
from seriesforge.operators.series import by_series, whole

PARAMETERS = 2  # constant and coefficient


def _lagged(df: DataFrame) -> DataFrame:
    """The value before, as ``_x``; without one, or without the value itself, neither counts."""
    before = F.lag("y").over(by_series())
    return df.withColumn("_x", F.when(F.col("y").isNotNull(), before))


def fitted(df: DataFrame) -> DataFrame:
    """Adds phi, constant, one-step ``yhat`` and ``residual``, and the series' n_obs and sigma2 to every row."""
    w = whole()
    rows = _lagged(df).withColumns({
        "phi": F.regr_slope("y", "_x").over(w), "constant": F.regr_intercept("y", "_x").over(w),
        "n_obs": F.count("_x").over(w)})
    rows = rows.withColumn("yhat", F.col("constant") + F.col("phi") * F.col("_x"))
    rows = rows.withColumn("residual", F.col("y") - F.col("yhat"))
    degrees = F.col("n_obs") - PARAMETERS
    return rows.withColumn("sigma2", F.when(degrees > 0, F.sum(F.col("residual") ** 2).over(w) / degrees)).drop("_x")


def aicc(residual: Column, parameters: int) -> Column:
    """Corrected information criterion of an aggregate of residuals; the variance counts as a parameter."""
    m, k = F.count(residual), parameters + 1
    loss = F.avg(residual * residual)
    return F.when((m - k - 1 > 0) & (loss > 0), m * F.ln(loss) + 2 * k + F.try_divide(F.lit(2.0 * k * (k + 1)), m - k - 1))


def order_choice(df: DataFrame) -> DataFrame:
    """Per series the best by AICc of mean, random walk, and AR(1) of the values, scored on the same months.

    One row per series: model, aicc and n_obs; a series that none can score keeps a row without model.
    """
    rows = fitted(df.withColumn("_mean", F.avg("y").over(whole())))
    errors = {"mean": (F.col("y") - F.col("_mean"), 1), "random walk": (F.col("y") - F.lag("y").over(by_series()), 0),
              "ar1": (F.col("residual"), PARAMETERS)}
    common = F.col("residual").isNotNull()
    rows = rows.select("series_id", *[F.when(common, e).alias(name) for name, (e, _) in errors.items()])
    scores = rows.groupBy("series_id").agg(
        F.count("ar1").alias("n_obs"), F.array(*[F.struct(aicc(F.col(f"`{name}`"), p).alias("aicc"), F.lit(name).alias("model"))
                                                 for name, (_, p) in errors.items()]).alias("_all"))
    best = F.array_min(F.filter("_all", lambda s: s["aicc"].isNotNull()))
    return scores.select("series_id", best["model"].alias("model"), best["aicc"].alias("aicc"), "n_obs")


def forecast(df: DataFrame, h: int) -> DataFrame:
    """``h`` months ahead of every series with 80 and 95% intervals, whose spread grows by the weights phi^j.

    A series that can't be fitted, or whose last value is missing, has rows without forecast.
    """
    last = fitted(df).withColumn("_n", F.max("idx").over(whole())).filter(F.col("idx") == F.col("_n"))
    phi, step = F.col("phi"), F.lit(1.0)
    value, variance = F.col("y"), F.lit(0.0)
    steps = F.sequence(F.lit(1), F.lit(h))
    start = F.struct(value.alias("v"), variance.alias("s"), step.alias("w"), F.array().cast("array<struct<v: double, s: double>>").alias("out"))

    def one(acc, _):
        v, s = F.col("constant") + phi * acc["v"], acc["s"] + acc["w"] * acc["w"]
        return F.struct(v.alias("v"), s.alias("s"), (acc["w"] * phi).alias("w"),
                        F.array_append(acc["out"], F.struct(v.alias("v"), s.alias("s"))).alias("out"))

    path = F.aggregate(steps, start, one, lambda acc: acc["out"])
    rows = last.select("series_id", F.col("_n").alias("origin"), F.col("date").alias("_end"), "sigma2", F.posexplode(path).alias("_k", "_f"))
    rows = rows.select("series_id", "origin", (F.col("_k") + 1).alias("k"), F.add_months("_end", F.col("_k") + 1).alias("date"),
                       F.col("_f.v").alias("yhat"), F.sqrt(F.col("sigma2") * F.col("_f.s")).alias("_sd"))
    return with_intervals(rows, F.col("_sd")).drop("_sd")


def cv(df: DataFrame, h: int, window: int | None = None, initial: int = 0, full_horizon_only: bool = False) -> DataFrame:
    """Errors of every fold; a fold's pairs lie inside its training part, so a window of w months has w - 1 of them."""
    start = Window.unboundedPreceding if window is None else 2 - window
    w = by_series().rowsBetween(start, 0)
    coefficients = {"_x": F.when(F.col("y").isNotNull(), F.lag("y").over(by_series())),
                    "_b": F.regr_slope("y", "_x").over(w), "_a": F.regr_intercept("y", "_x").over(w)}
    rows = df.withColumn("_x", coefficients.pop("_x"))
    forecasts, value = [], F.col("y")
    for _ in range(h):
        value = F.col("_a") + F.col("_b") * value
        forecasts.append(value)
    return _errors(rows, forecasts, window, initial, full_horizon_only, coefficients)
