"""The forecasting study: one target category, one lagged regressor, several models, one leaderboard."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesforge.operators import arima, linear, stepwise
from seriesforge.operators.evaluate import accuracy, labelled, leaderboard, stack, with_seasonal_scale
from seriesforge.operators.forecast import seasonal_naive_test
from seriesforge.operators.grid import arima_grid
from seriesforge.operators.series import SEASON, by_series, split_train_test, whole
from seriesforge.sources.sinks import write_table

# The two models chosen by hand, both with the regressor.
HYPER = {"p": (2,), "d": (0,), "q": (1,), "ps": (1,), "ds": (0,), "qs": (2,), "dr": (True,)}
HYPER_NO_DRIFT = {"p": (2,), "d": (0,), "q": (1,), "ps": (2,), "ds": (1,), "qs": (1,), "dr": (False,)}


def export_series(df: DataFrame, path: str) -> DataFrame:
    """Write the prepared series and regressor as a table and read it back: models fitted later, or by
    another job, start from files instead of from the raw facts."""
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _labelled(rows: DataFrame, model: Column) -> DataFrame:
    set_name = F.when(F.col("part") == "test", "Test set").otherwise("Training set")
    return rows.select("series_id", "idx", "part", "y", "yhat", "scale", labelled(model, set_name).alias("model"))


def seasonal_naive_rows(split: DataFrame, test_length: int, model: str = "Seasonal Naive") -> DataFrame:
    """Seasonal naive fit of the training part and its forecast of the test part, as one window pass over the split."""
    fit = F.when(F.col("part") == "train", F.lag("y", SEASON).over(by_series()))
    rows = with_seasonal_scale(split).withColumn("yhat", F.coalesce(fit, seasonal_naive_test(test_length)))
    return _labelled(rows, F.lit(model))


def model_accuracy(df: DataFrame, test_length: int, auto_ranges: Mapping[str, Sequence],
                   models: Mapping[str, Mapping[str, Sequence]] | None = None,
                   partitions: int | None = None) -> DataFrame:
    """Training and test accuracy of every model on every series ``(series_id, idx, date, y, x)``.

    Models: those given (default: the two chosen by hand), the best of ``auto_ranges`` with and without
    the regressor, and seasonal naive.
    """
    models = models or {"Hyper": HYPER, "Hyper No Drift": HYPER_NO_DRIFT}
    split = with_seasonal_scale(split_train_test(df, test_length))
    train = _training_part(df, test_length)
    bare = train.withColumn("x", F.lit(None).cast("array<double>"))
    candidates = [(name, train, ranges) for name, ranges in models.items()]
    candidates += [("Auto", train, auto_ranges), ("Auto Simple", bare, auto_ranges)]
    # All models are rows of one job.
    work = stack([arima_grid(base, ranges).withColumn("model", F.lit(name)) for name, base, ranges in candidates])
    skip = max(arima.common_skip(ranges) for _, _, ranges in candidates)
    fits = arima.best_fits(arima.arima_fit(work, test_length, skip, partitions))
    # Fitted values and forecast one after the other, so that the fits are run once.
    values = fits.select("series_id", "model", F.posexplode(F.concat("fitted", "yhat")).alias("_i", "yhat"))
    # Every model has rows for every series, also where nothing could be fitted.
    rows = split.withColumn("model", F.explode(F.array(*[F.lit(name) for name, _, _ in candidates]))).join(
        values.withColumn("idx", F.col("_i") + 1).drop("_i"), ["series_id", "model", "idx"], "left")
    parts = [_labelled(rows, F.col("model")), seasonal_naive_rows(split, test_length)]
    return accuracy(stack(parts), "model", "series_id", "part").drop("part")


def linear_accuracy(df: DataFrame, test_length: int, models: Mapping[str, linear.Model], auto: bool = False) -> DataFrame:
    """(model, series_id, n, rmse, mape) on held-out months of linear models, on request of the stepwise choice with and without the
    regressors, and of seasonal naive. No row goes to Python.
    """
    last = F.max("idx").over(whole())
    known = df.withColumn("y", F.when(F.col("idx") <= last - test_length, F.col("y")))
    ahead = {name: linear.forecast(known, model, test_length) for name, model in models.items()}
    if auto:
        regressors = tuple(c for c in df.columns if c not in ("series_id", "idx", "date", "y"))
        for name, own in (("Auto", regressors), ("Auto Simple", ())):
            chosen = stepwise.choice(stepwise.search(known, max_p=3, max_ps=1, regressors=own))
            ahead[name] = stepwise.forecast(known, chosen, test_length, regressors=own)
    rows = [f.select("series_id", (F.col("origin") + F.col("k")).alias("idx"), "yhat", F.lit(name).alias("model")) for name, f in ahead.items()]
    split = split_train_test(df, test_length).withColumn("yhat", seasonal_naive_test(test_length)).filter("part = 'test'")
    rows.append(split.select("series_id", "idx", "yhat", F.lit("Seasonal Naive").alias("model")))
    actual = df.withColumn("_last", last).filter(F.col("idx") > F.col("_last") - test_length).select("series_id", "idx", "y")
    e = F.col("y") - F.col("yhat")
    return stack(rows).join(actual, ["series_id", "idx"]).groupBy("series_id", "model").agg(
        F.count(e).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(100 * e / F.when(F.col("y") != 0, F.col("y")))).alias("mape"),
    ).select(labelled(F.col("model"), F.lit("Test set")).alias("model"), "series_id", "n", "rmse", "mape")


def _training_part(df: DataFrame, test_length: int) -> DataFrame:
    """Packed series cut before the test months; the regressor, known beforehand, stays whole. A series of test months
    only has nothing to train on and no row here."""
    n = F.col("n") - test_length
    return arima.pack(df).filter(n > 0).select(
        "series_id", n.alias("n"), F.add_months("last_date", -test_length).alias("last_date"),
        F.slice("y", F.lit(1), n).alias("y"), "x")


def leaderboard_of_tests(accuracies: DataFrame, top: int | None = None) -> DataFrame:
    """Test rows only, smallest RMSE first."""
    return leaderboard(accuracies, "rmse", "model", "series_id", top=top, models="test")


