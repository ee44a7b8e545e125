"""ARIMA models and user forecast functions over many series, configurations and folds.

The unit of work is one row: a series packed as arrays, one configuration, one block of origins. Spark
builds the rows, deals them out, and aggregates what comes back; Python fits what is in a row.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.operators import backtest
from seriesforge.operators.css import fit
from seriesforge.operators.forecast import NORMAL_QUANTILES
from seriesforge.operators.grid import ARIMA_RANGES, ARIMA_TYPES, add_grid, arima_allowed, arima_grid, arima_name, grid_size, grid_slice
from seriesforge.operators.series import SEASON

PARAMETERS = ("w", "l", "dr", "p", "d", "q", "ps", "ds", "qs")
# Interval bounds and their normal quantiles: lo80, hi80, lo95, hi95.
BOUNDS = {f"{side}{level}": sign * z for level, z in NORMAL_QUANTILES.items() for side, sign in (("lo", -1), ("hi", 1))}
# forecaster(y, h, x, x_future, **parameters) -> h values; x and x_future are None without regressor.
Forecaster = Callable[..., Sequence[float]]


def pack(df: DataFrame, regressors: Sequence[str] = ("x",)) -> DataFrame:
    """One row per series: ``n``, last date, and ``y`` and ``x`` as arrays, each value in the place of its ``idx``.

    ``x`` has the values of the regressor, or with several an array of their values for each month; without any it is NULL.

    A month without a row has no value. An array has one entry per calendar month at most; an ``idx`` that
    occurs twice stops the job.
    """
    given = [c for c in regressors if c in df.columns]
    if len(given) < len(regressors) and tuple(regressors) != ("x",):
        raise ValueError(f"no such regressors: {sorted(set(regressors) - set(given))}")
    if len(given) > 1 or given not in ([], ["x"]):
        df = df.withColumn("x", F.array(*given))
    values = ["y", "x"] if given else ["y"]
    packed = df.groupBy("series_id").agg(
        F.map_from_entries(F.collect_list(F.struct("idx", F.struct(*values)))).alias("_rows"),
        F.max("idx").alias("n"),
        F.max("date").alias("last_date"),
    )
    months = F.sequence(F.lit(1), F.col("n"))
    arrays = [F.transform(months, _value_at(c)).alias(c) for c in values]
    if "x" not in values:
        arrays.append(F.lit(None).cast("array<double>").alias("x"))
    return packed.select("series_id", "n", "last_date", *arrays)


def _value_at(column: str) -> Callable:
    return lambda month: F.try_element_at("_rows", month)[column]


def _spread_out(work: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """Deal work rows out by key. A fixed number, since rows are small for their computing time and
    adaptive execution would join them into few tasks."""
    n = partitions or int(work.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return work.repartition(n, *keys)


def _origin_blocks(work: DataFrame, h: int, initial: int, full_horizon_only: bool, block: int) -> DataFrame:
    """Split the origins of each row into blocks, so that a long history is not one task."""
    first = F.coalesce(F.col("w"), F.lit(1)) + initial
    last = F.col("n") - (h if full_horizon_only else 1)
    starts = F.when(first <= last, F.sequence(first, last, F.lit(block)))
    work = work.select("*", F.explode(starts).alias("_from"))
    return work.withColumn("_to", F.least(F.col("_from") + block - 1, last))


def _records(batch: pd.DataFrame) -> Iterator[dict]:
    for values in zip(*(batch[c] for c in batch.columns)):
        yield dict(zip(batch.columns, values))


def _array(values) -> np.ndarray | None:
    """Values of a series, or of several regressors as rows; what is missing is NaN."""
    if values is None:
        return None
    width = next((len(v) for v in values if isinstance(v, (list, np.ndarray))), None)
    if width is None:
        return np.array([np.nan if v is None else v for v in values], float)
    return np.array([[np.nan] * width if v is None else [np.nan if u is None else u for u in v] for v in values], float)


def _whole_numbers(params: dict) -> dict:
    return {k: int(v) if k in ("w", "p", "d", "q", "ps", "ds", "qs") and v is not None else v for k, v in params.items()}


def _parameter(value):
    return None if value is None or (isinstance(value, float) and np.isnan(value)) else value


def _fit(y, x, origins, h, **params) -> dict[str, np.ndarray]:
    """The fit, or one without any value when the numbers defeat the linear algebra."""
    try:
        return fit(y, x, origins, h, **params)
    except np.linalg.LinAlgError:
        return fit(np.full_like(y, np.nan), x, origins, h, **params)


def _arima_folds(y, x, origins, h, params) -> tuple[np.ndarray, np.ndarray]:
    fits = _fit(y, x, origins, h, **params)
    return fits["yhat"], fits["converged"]


def each_fold(forecaster: Forecaster):
    """Run a user's function on each training part; a failing fold gives no forecast."""

    def run(y, x, origins, h, params) -> tuple[np.ndarray, np.ndarray]:
        window = params.pop("w", None)
        out = np.full((len(origins), h), np.nan)
        for i, o in enumerate(origins):
            start = 0 if window is None else o - window
            past = None if x is None else x[start:o]
            future = None if x is None else x[o:o + h]
            try:
                values = np.asarray(forecaster(y[start:o], h, past, future, **params), float)[:h]
            except Exception:  # noqa: BLE001 - any failure of a fold is a missing forecast
                continue
            out[i, :len(values)] = values
        return out, np.isfinite(out).all(axis=1)

    return run


def _cross_validate(work: DataFrame, names: Sequence[str], h: int, run) -> DataFrame:
    """Errors per work row, long. A fold's regressor for horizon k is that of the forecast month."""
    names = list(names)

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in _records(batch):
                y, x = _array(row["y"]), _array(row["x"])
                origins = np.arange(int(row["_from"]), int(row["_to"]) + 1)
                params = _whole_numbers({name: _parameter(row[name]) for name in names})
                yhat, converged = run(y, x, origins, h, params)
                months = origins[:, None] + np.arange(1, h + 1)
                actual = np.where(months <= len(y), y[np.minimum(months, len(y)) - 1], np.nan)
                yield pd.DataFrame({
                    "series_id": row["series_id"], "config_id": row["config_id"],
                    "origin": np.repeat(origins, h), "k": np.tile(np.arange(1, h + 1), len(origins)),
                    "y": actual.ravel(), "yhat": yhat.ravel(), "converged": np.repeat(converged, h),
                })

    schema = "series_id string, config_id string, origin int, k int, y double, yhat double, converged boolean"
    rows = work.mapInPandas(errors, schema)
    null = lambda c: F.when(~F.isnan(c), F.col(c))
    return rows.withColumns({"y": null("y"), "yhat": null("yhat")}).withColumn(
        "error", F.col("y") - F.col("yhat"))


def work_rows(df: DataFrame, ranges: Mapping[str, Sequence] = ARIMA_RANGES, regressors: Sequence[str] = ("x",)) -> DataFrame:
    """Each packed series with each allowed configuration; drop finished ones before fitting."""
    return arima_grid(pack(df, regressors), ranges)


def arima_cv(work: DataFrame, h: int, initial: int = 0, full_horizon_only: bool = False,
             block: int = 120, partitions: int | None = None) -> DataFrame:
    """Cross-validation errors of all rows of ``work_rows`` as one job."""
    backtest.check_settings(h, None, initial)
    blocks = _origin_blocks(work, h, initial, full_horizon_only, block)
    blocks = _spread_out(blocks, "series_id", "config_id", "_from", partitions=partitions)
    return _cross_validate(blocks, PARAMETERS, h, _arima_folds)


def grid_cv_metrics(df: DataFrame, ranges: Mapping[str, Sequence] = ARIMA_RANGES, h: int = 24, initial: int = 0,
                    full_horizon_only: bool = True, block: int = 120, rows_per_task: int = 200,
                    regressors: Sequence[str] = ("x",)) -> DataFrame:
    """Error means per configuration and horizon over all series, as ``backtest.metrics_by_horizon`` gives them.

    A series is shuffled once for each slice of the grid, not for each configuration; the slice is expanded behind the
    shuffle. The number of slices follows the number of configurations, so a task has about ``rows_per_task`` rows for
    every series it gets. A task sends sums for each configuration and horizon of its rows, no single error.
    """
    backtest.check_settings(h, None, initial)
    full = {**{name: values[:1] for name, values in ARIMA_RANGES.items()}, **ranges}
    slices = max(1, -(-grid_size(full) // rows_per_task))
    packed = pack(df, regressors)
    tasks = max(slices, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = packed.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).repartition(tasks, "series_id", "_slice")
    work = grid_slice(dealt, full, F.col("_slice"), slices, ARIMA_TYPES).filter(arima_allowed()).withColumn("config_id", arima_name())
    blocks = _origin_blocks(work, h, initial, full_horizon_only, block)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["config_id", "k", "n", "n_failed", "n_unconverged", "s_abs", "s_square"]
        for batch in batches:
            totals: dict[str, np.ndarray] = {}
            for row in _records(batch):
                y, x = _array(row["y"]), _array(row["x"])
                origins = np.arange(int(row["_from"]), int(row["_to"]) + 1)
                yhat, converged = _arima_folds(y, x, origins, h, _whole_numbers({name: _parameter(row[name]) for name in PARAMETERS}))
                months = origins[:, None] + np.arange(1, h + 1)
                e = np.where(months <= len(y), y[np.minimum(months, len(y)) - 1], np.nan) - yhat
                own = totals.setdefault(row["config_id"], np.zeros((5, h)))
                own += np.stack([np.isfinite(e).sum(axis=0), (~np.isfinite(yhat)).sum(axis=0), np.full(h, (~converged).sum()),
                                 np.nansum(np.abs(e), axis=0), np.nansum(e * e, axis=0)])
            yield pd.DataFrame([(c, k + 1, *own[:, k]) for c, own in totals.items() for k in range(h)], columns=columns).astype(
                {"n": "int64", "n_failed": "int64", "n_unconverged": "int64"})

    parts = blocks.mapInPandas(sums, "config_id string, k int, n long, n_failed long, n_unconverged long, s_abs double, s_square double")
    totals = parts.groupBy("config_id", "k").agg(*[F.sum(c).alias(c) for c in ("n", "n_failed", "n_unconverged", "s_abs", "s_square")])
    mae, mse = F.try_divide("s_abs", "n"), F.try_divide("s_square", "n")
    return totals.select("config_id", "k", "n", "n_failed", "n_unconverged", mae.alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"))


def custom_cv(df: DataFrame, forecaster: Forecaster, h: int, ranges: Mapping[str, Sequence] | None = None,
              types: Mapping[str, str] | None = None, window: int | None = None, initial: int = 0,
              full_horizon_only: bool = False, block: int = 120, partitions: int | None = None,
              regressors: Sequence[str] = ("x",)) -> DataFrame:
    """Cross-validation errors of a user's forecast function over a grid of its parameters. With several regressors it
    gets them as the columns of a matrix."""
    backtest.check_settings(h, window, initial)
    ranges = dict(ranges or {})
    work = add_grid(pack(df, regressors), ranges, types).withColumn("w", F.lit(window).cast("int"))
    texts = [F.coalesce(F.col(name).cast("string"), F.lit("NULL")) for name in ranges]
    label = F.concat_ws("_", *itertools.chain(*zip(map(F.lit, ranges), texts))) if ranges else F.lit("custom")
    work = _origin_blocks(work.withColumn("config_id", label), h, initial, full_horizon_only, block)
    work = _spread_out(work, "series_id", "config_id", "_from", partitions=partitions)
    return _cross_validate(work, ["w", *ranges], h, each_fold(forecaster))


def arima_fit(work: DataFrame, h: int, skip: int | None = None, partitions: int | None = None) -> DataFrame:
    """Fit whole series: one row per work row with score, spread, one-step fitted values and forecast.

    A column ``model`` of the work rows, if there is one, names what the configuration belongs to.
    ``fitted``, ``yhat`` and the interval bounds ``lo80`` to ``hi95`` are arrays. The intervals come from
    the psi weights; with a lambda they are built on the transformed scale and transformed back.
    """

    def fit_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in _records(batch):
                y, x = _array(row["y"]), _array(row["x"])
                params = _whole_numbers({name: _parameter(row[name]) for name in PARAMETERS})
                n = int(row["n"])
                if params["w"] is not None and params["w"] > n:
                    params["w"] = n
                m = _fit(y, x, np.array([n]), h, skip=skip, quantiles=tuple(BOUNDS.values()), **params)
                fitted = np.full(n, np.nan)
                fitted[n - m["fitted"].shape[1]:] = m["fitted"][0]
                out.append({
                    **{key: row[key] for key in keys}, "n": n,
                    "last_date": row["last_date"], "n_obs": int(m["n_obs"][0]),
                    "converged": bool(m["converged"][0]), "sigma2": m["sigma2"][0], "aicc": m["aicc"][0],
                    "fitted": _list(fitted), "yhat": _list(m["yhat"][0]),
                    **{name: _list(values) for name, values in zip(BOUNDS, m["bounds"][0])},
                })
            yield pd.DataFrame(out, columns=columns)

    keys = fit_keys(work)
    schema = ", ".join(f"{key} string" for key in keys) + (
        ", n int, last_date date, n_obs int, converged boolean, sigma2 double, aicc double, fitted array<double>, yhat array<double>"
    ) + "".join(f", {name} array<double>" for name in BOUNDS)
    columns = [c.split()[0] for c in schema.split(", ")]
    work = _spread_out(work, *keys, partitions=partitions)
    fits = work.mapInPandas(fit_rows, schema)
    return fits.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("sigma2", "aicc")})


def fit_keys(df: DataFrame) -> list[str]:
    return [c for c in ("series_id", "model", "config_id") if c in df.columns]


def _list(values: np.ndarray) -> list:
    return [float(v) if np.isfinite(v) else None for v in values]


def common_skip(ranges: Mapping[str, Sequence]) -> int:
    """Months the longest-reaching configuration of a grid cannot score."""
    top = {name: max(ranges.get(name, (0,))) for name in ("p", "d", "ps", "ds")}
    return top["d"] + top["p"] + SEASON * (top["ds"] + top["ps"])


def auto_arima(df: DataFrame, ranges: Mapping[str, Sequence], h: int, partitions: int | None = None) -> DataFrame:
    """Per series the configuration of the grid with the smallest AICc, with its fit.

    All configurations are scored on the same months, so orders of differencing can be compared.
    """
    return best_fits(arima_fit(work_rows(df, ranges), h, common_skip(ranges), partitions))


def best_fits(fits: DataFrame) -> DataFrame:
    """Per series (and model) the fit with the smallest AICc, ties by ``config_id``.

    Fits without a score come last, so a series that nothing fits keeps a row without score and forecast. ``n_unscored`` and
    ``n_unconverged`` count such fits among all of the series.
    """
    keys = [key for key in fit_keys(fits) if key != "config_id"]
    unscored = F.col("aicc").isNull()
    best = F.min_by(F.struct(*[c for c in fits.columns if c not in keys]), F.struct(unscored, "aicc", "config_id"))
    return fits.groupBy(*keys).agg(
        best.alias("_best"), F.count_if(unscored).alias("n_unscored"), F.count_if(~F.col("converged")).alias("n_unconverged"),
    ).select(*keys, "_best.*", "n_unscored", "n_unconverged")


def forecast_rows(fits: DataFrame) -> DataFrame:
    """Forecasts of fitted models as rows with prediction intervals."""
    keys = fit_keys(fits)
    rows = fits.select(*keys, "n", "last_date", F.posexplode(F.arrays_zip("yhat", *BOUNDS)).alias("_k", "_f"))
    return rows.select(*keys, F.col("n").alias("origin"), (F.col("_k") + 1).alias("k"),
                       F.add_months("last_date", F.col("_k") + 1).alias("date"), "_f.*")


def fitted_rows(fits: DataFrame) -> DataFrame:
    """One-step fitted values as rows ``(series_id, config_id, idx, yhat)``."""
    rows = fits.select(*fit_keys(fits), F.posexplode("fitted").alias("_i", "yhat"))
    return rows.select(*fit_keys(fits), (F.col("_i") + 1).alias("idx"), "yhat")
