"""Rolling-origin cross-validation.

A fold is an origin row of a regular series: train on the months up to it, forecast the ``h`` months
after it. Origins run over an expanding or a sliding training window. For models that window aggregates
can express, the folds are rows of one window pass; nothing is joined and no fold is copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesforge.operators.series import SEASON, by_series, trailing, whole


def check_settings(h: int, window: int | None = None, initial: int = 0) -> None:
    """Settings that no series could meet are errors, not empty results."""
    if h < 1:
        raise ValueError(f"the horizon is {h}; it must be one month at least")
    if window is not None and window < 2:
        raise ValueError(f"a window of {window} is too small; it must hold two months at least")
    if initial < 0:
        raise ValueError(f"the initial period is {initial}; it can't be negative")


def is_origin(window: int | None = None, initial: int = 0, h: int | None = None) -> Column:
    """Condition on ``idx`` and series length ``n``; with ``h`` only folds with a full horizon count."""
    first = (window or 1) + initial
    last = F.col("n") - (h or 1)
    return (F.col("idx") >= first) & (F.col("idx") <= last)


def with_length(df: DataFrame) -> DataFrame:
    return df.withColumn("n", F.max("idx").over(whole()))


def folds(df: DataFrame, h: int = 1, window: int | None = None, initial: int = 0,
          full_horizon_only: bool = False) -> DataFrame:
    """One row per series and origin with the bounds of the training part and the reachable horizon.

    A series not longer than the first origin has no fold.
    """
    check_settings(h, window, initial)
    rows = with_length(df).filter(is_origin(window, initial, h if full_horizon_only else None))
    start = F.lit(1) if window is None else F.col("idx") - window + 1
    return rows.select(
        "series_id",
        F.col("idx").alias("origin"),
        start.alias("train_start"),
        F.col("idx").alias("train_end"),
        (F.col("idx") - start + 1).alias("n_train"),
        F.least(F.lit(h), F.col("n") - F.col("idx")).alias("max_k"),
    )


def _errors(df: DataFrame, forecasts: list[Column], window: int | None, initial: int,
            full_horizon_only: bool, extra: dict[str, Column] | None = None) -> DataFrame:
    """Unroll the forecasts of each origin row to rows ``(series_id, origin, k, y, yhat, error)``."""
    h, w = len(forecasts), by_series()
    check_settings(h, window, initial)
    ahead = F.array(*[
        F.struct(F.lit(k).alias("k"), F.lead("y", k).over(w).alias("y"), f.alias("yhat"))
        for k, f in enumerate(forecasts, start=1)
    ])
    rows = with_length(df).withColumns(extra or {})
    rows = rows.withColumn("_ahead", ahead).filter(is_origin(window, initial, h if full_horizon_only else None))
    return rows.select("series_id", F.col("idx").alias("origin"), F.inline_outer("_ahead")).withColumn(
        "error", F.col("y") - F.col("yhat"))


def cv_seasonal_naive(df: DataFrame, h: int, window: int | None = None, initial: int = 0,
                      full_horizon_only: bool = False, season: int = SEASON) -> DataFrame:
    """Seasonal naive forecast from every origin; NULL while the training part is under a season long."""
    w = by_series()
    back = [season - 1 - (k - 1) % season for k in range(1, h + 1)]
    if window is not None and window < season:
        forecasts = [F.lit(None).cast("double")] * h
    else:
        # idx >= season: a training part shorter than a season has no forecast at any horizon.
        forecasts = [
            F.when(F.col("idx") >= season, F.lag("y", b).over(w) if b else F.col("y")) for b in back
        ]
    return _errors(df, forecasts, window, initial, full_horizon_only)


def cv_linear_trend(df: DataFrame, h: int, window: int | None = None, initial: int = 0,
                    full_horizon_only: bool = False) -> DataFrame:
    """Line through the training part of every origin."""
    w = trailing(window)
    line = {"_b": F.regr_slope("y", "idx").over(w), "_a": F.regr_intercept("y", "idx").over(w)}
    forecasts = [F.col("_a") + F.col("_b") * (F.col("idx") + k) for k in range(1, h + 1)]
    return _errors(df, forecasts, window, initial, full_horizon_only, line)


def cv_regression(df: DataFrame, h: int, window: int | None = None, initial: int = 0,
                  full_horizon_only: bool = False) -> DataFrame:
    """Regression on ``x`` over the training part; horizon ``k`` uses the regressor of its own month."""
    w, ahead = trailing(window), by_series()
    line = {"_b": F.regr_slope("y", "x").over(w), "_a": F.regr_intercept("y", "x").over(w)}
    forecasts = [F.col("_a") + F.col("_b") * F.lead("x", k).over(ahead) for k in range(1, h + 1)]
    return _errors(df, forecasts, window, initial, full_horizon_only, line)


def cv_two_regressors(df: DataFrame, h: int, regressors: tuple[str, str] = ("x", "z"), window: int | None = None, initial: int = 0,
                      full_horizon_only: bool = False) -> DataFrame:
    """Regression on two columns over the training part, by the covariances of its complete rows; horizon ``k`` uses both of its own month."""
    w, ahead = trailing(window), by_series()
    complete = F.col("y").isNotNull() & F.col(regressors[0]).isNotNull() & F.col(regressors[1]).isNotNull()
    y, a, b = (F.when(complete, F.col(c)) for c in ("y", *regressors))
    moments = {"_ab": F.covar_pop(a, b).over(w), "_aa": F.var_pop(a).over(w), "_bb": F.var_pop(b).over(w),
               "_ya": F.covar_pop(y, a).over(w), "_yb": F.covar_pop(y, b).over(w),
               "_y": F.avg(y).over(w), "_a": F.avg(a).over(w), "_b": F.avg(b).over(w)}
    m = {name: F.col(name) for name in moments}
    shared = m["_aa"] * m["_bb"] - m["_ab"] * m["_ab"]
    slope_a = F.try_divide(m["_ya"] * m["_bb"] - m["_yb"] * m["_ab"], shared)
    slope_b = F.try_divide(m["_yb"] * m["_aa"] - m["_ya"] * m["_ab"], shared)
    forecasts = [m["_y"] + slope_a * (F.lead(regressors[0], k).over(ahead) - m["_a"]) + slope_b * (F.lead(regressors[1], k).over(ahead) - m["_b"])
                 for k in range(1, h + 1)]
    return _errors(df, forecasts, window, initial, full_horizon_only, moments)


def metrics_by_horizon(errors: DataFrame, *keys: str) -> DataFrame:
    """Error means per ``keys`` and horizon; missing errors are left out, failed forecasts counted, and so are
    forecasts of a search that did not end where ``converged`` tells it."""
    e = F.col("error")
    ended = [F.count_if(~F.col("converged")).alias("n_unconverged")] if "converged" in errors.columns else []
    return errors.groupBy(*keys, "k").agg(
        F.count(e).alias("n"),
        F.count_if(F.col("yhat").isNull()).alias("n_failed"),
        *ended,
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
    )


def horizons_wide(metrics: DataFrame, key: str, horizons: list[int],
                  measures: tuple[str, ...] = ("mae", "rmse")) -> DataFrame:
    """One row per ``key`` with the measures of the chosen horizons side by side: ``h12_mae`` ..."""
    picked = metrics.filter(F.col("k").isin(*horizons))
    columns = [
        F.max(F.when(F.col("k") == k, F.col(m))).alias(f"h{k}_{m}") for k in horizons for m in measures
    ]
    return picked.groupBy(key).agg(*columns)


def longest_horizon(errors: DataFrame, *keys: str) -> DataFrame:
    """Largest horizon each fold has a forecast for, 0 when it has none."""
    reached = F.max(F.when(F.col("yhat").isNotNull(), F.col("k")))
    return errors.groupBy(*keys, "origin").agg(F.coalesce(reached, F.lit(0)).alias("max_k"))
