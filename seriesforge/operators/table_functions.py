"""Table functions for SQL: cross-validation of a user's forecast function over a partitioned, ordered table.

    register_cross_validation(spark, "cross_validate", mean_of_training)
    SELECT * FROM cross_validate(TABLE(SELECT series_id, y FROM months) PARTITION BY series_id ORDER BY idx, h => 4, initial => 24)

Spark brings the rows of a series together and in order; the function takes them one by one and holds one series, which has at most one
row per calendar month. What it gives equals ``arima.custom_cv``: a fold that fails has no forecast, and a regressor ``x`` is that of the
forecast month.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from seriesforge.operators.arima import Forecaster, each_fold
from seriesforge.operators.backtest import check_settings

SCHEMA = "series_id: string, origin: int, k: int, y: double, yhat: double, error: double"


def _known(value: float) -> float | None:
    return float(value) if np.isfinite(value) else None


def cross_validation(forecaster: Forecaster, **parameters):
    """A table function class for the forecaster with fixed values of its own parameters."""

    class CrossValidation:
        def __init__(self):
            self.y: list[float] = []
            self.x: list[float] = []
            self.key, self.settings = None, None

        def eval(self, row, h: int, initial: int = 0, window: int = None):
            self.key, self.settings = row["series_id"], (h, initial, window)
            self.y.append(np.nan if row["y"] is None else float(row["y"]))
            if "x" in row:
                self.x.append(np.nan if row["x"] is None else float(row["x"]))

        def terminate(self):
            if self.settings is None:
                return
            h, initial, window = self.settings
            check_settings(h, window, initial)
            y, x = np.array(self.y), np.array(self.x) if self.x else None
            origins = np.arange((window or 1) + initial, len(y))
            forecasts, _ = each_fold(forecaster)(y, x, origins, h, dict(parameters, w=window))
            for origin, values in zip(origins.tolist(), forecasts):
                for k, value in enumerate(values, 1):
                    actual = _known(y[origin + k - 1]) if origin + k <= len(y) else None
                    yhat = _known(value)
                    yield self.key, origin, k, actual, yhat, None if actual is None or yhat is None else actual - yhat

    return udtf(CrossValidation, returnType=SCHEMA)


def register_cross_validation(spark: SparkSession, name: str, forecaster: Forecaster, **parameters) -> None:
    """Make the forecaster's cross-validation a function of SQL; ``parameters`` are those of the forecaster."""
    spark.udtf.register(name, cross_validation(forecaster, **parameters))
