"""Forecasts, cross-validation, accuracy, grids."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.operators import arima, autoregress, backtest, diagnose, evaluate, forecast, grid, series
from seriesforge.operators.table_functions import register_cross_validation
from seriesforge.plans import study
from seriesforge.sources import bucketed
from seriesforge.sources.sinks import append_pending
from seriesforge.sources.tables import scratch_path
from workload import catalogs as c
from workload.analysis import _ACF, _CENTRED, parts_regular, regional_regular, with_order_value
from workload.registry import query


def orders_regular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.regular(c.order_series(spark, sf_dir))


_SNAIVE = """
    SELECT s.series_id, CAST(s.n AS INTEGER) AS origin, k, CAST(last + to_months(CAST(k AS INTEGER)) AS DATE) AS date,
           CASE WHEN s.n >= 12 THEN y END AS yhat
    FROM (SELECT series_id, max(idx) AS n, max(date) AS last FROM {0} GROUP BY 1) s
    CROSS JOIN (SELECT CAST(unnest(range(1, {1} + 1)) AS INTEGER) AS k)
    LEFT JOIN {0} v ON v.series_id = s.series_id AND v.idx = s.n + k - 12 * CAST(ceil(k / 12.0) AS INTEGER)"""


@query(_SNAIVE.format("prt_ser", 24), "prt_ser")
def snaive_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.seasonal_naive(parts_regular(spark, sf_dir), 24).drop("sigma")


@query(f"""
SELECT f.series_id, origin, k, date, yhat, round(yhat - 1.2815515655446004 * sd, 2) AS lo80, round(yhat + 1.2815515655446004 * sd, 2) AS hi80,
       round(yhat - 1.959963984540054 * sd, 2) AS lo95, round(yhat + 1.959963984540054 * sd, 2) AS hi95
FROM (SELECT f.*, sigma * sqrt(floor((k - 1) / 12) + 1) AS sd FROM ({_SNAIVE.format("reg_ser", 36)}) f
      JOIN (SELECT a.series_id, sqrt(avg(pow(a.y - b.y, 2))) AS sigma FROM reg_ser a
            JOIN reg_ser b ON b.series_id = a.series_id AND b.idx = a.idx - 12 GROUP BY 1) s USING (series_id)) f""", "reg_ser")
def snaive_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forecast.seasonal_naive_interval(regional_regular(spark, sf_dir), 36).drop("sigma")
    return rows.withColumns({b: F.round(b, 2) for b in ("lo80", "hi80", "lo95", "hi95")})


@query("""
SELECT series_id, CAST(n AS INTEGER) AS origin, k, CAST(last + to_months(CAST(k AS INTEGER)) AS DATE) AS date,
       round(slope, 3) AS slope, round(intercept, 3) AS intercept, round(intercept + slope * (n + k), 3) AS yhat
FROM (SELECT series_id, max(idx) AS n, max(date) AS last, regr_slope(y, idx) AS slope, regr_intercept(y, idx) AS intercept
      FROM reg_ser GROUP BY 1) CROSS JOIN (SELECT CAST(unnest(range(1, 25)) AS INTEGER) AS k)""", "reg_ser")
def drift_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forecast.linear_trend(regional_regular(spark, sf_dir), 24)
    return rows.withColumns({"slope": F.round("slope", 3), "intercept": F.round("intercept", 3), "yhat": F.round("yhat", 3)})


@query("""
, s AS (SELECT *, max(idx) OVER (PARTITION BY series_id) AS n FROM reg_x),
f AS (SELECT series_id, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM s WHERE idx <= n - 24 GROUP BY 1)
SELECT series_id, CAST(idx - n + 24 AS INTEGER) AS k, date, y, round(slope, 7) AS slope, round(intercept, 1) AS intercept,
       round(intercept + slope * x, 1) AS yhat
FROM s JOIN f USING (series_id) WHERE idx > n - 24""", "reg_x")
def xreg_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forecast.regression(series.split_train_test(with_order_value(spark, sf_dir), 24))
    return rows.withColumns({"slope": F.round("slope", 7), "intercept": F.round("intercept", 1), "yhat": F.round("yhat", 1)})


_FOLDS = """
SELECT series_id, idx AS origin, {start} AS train_start, idx AS train_end, CAST(idx - ({start}) + 1 AS INTEGER) AS n_train,
       CAST(least({h}, n - idx) AS INTEGER) AS max_k
FROM (SELECT series_id, idx, max(idx) OVER (PARTITION BY series_id) AS n FROM prt_ser) WHERE idx >= {first} AND idx <= n - {end}"""


@query(_FOLDS.format(start="1", h=12, first=25, end=1), "prt_ser")
def cv_folds_expanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.folds(parts_regular(spark, sf_dir), 12, initial=24)


@query(_FOLDS.format(start="idx - 35", h=12, first=36, end=1), "prt_ser")
def cv_folds_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.folds(parts_regular(spark, sf_dir), 12, window=36)


@query(_FOLDS.format(start="idx - 35", h=24, first=46, end=24), "prt_ser")
def cv_full_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.folds(parts_regular(spark, sf_dir), 24, window=36, initial=10, full_horizon_only=True)


def _cv_snaive(src: str, h: int, first: int, end: int = 1) -> str:
    return f"""
    SELECT o.series_id, o.idx AS origin, k, a.y, f.y AS yhat, a.y - f.y AS error
    FROM (SELECT series_id, idx, max(idx) OVER (PARTITION BY series_id) AS n FROM {src}) o
    CROSS JOIN (SELECT CAST(unnest(range(1, {h} + 1)) AS INTEGER) AS k)
    LEFT JOIN {src} a ON a.series_id = o.series_id AND a.idx = o.idx + k
    LEFT JOIN {src} f ON o.idx >= 12 AND f.series_id = o.series_id AND f.idx = o.idx + k - 12 * CAST(ceil(k / 12.0) AS INTEGER)
    WHERE o.idx >= {first} AND o.idx <= n - {end}"""


@query(_cv_snaive("reg_ser", 24, 37), "reg_ser")
def cv_errors_snaive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.cv_seasonal_naive(regional_regular(spark, sf_dir), 24, window=24, initial=13)


@query(_cv_snaive("reg_ser", 24, 37), "reg_ser")
def cv_over_stored_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same folds over series that are stored by key: nothing is shuffled any more."""
    name = f"regional_{uuid.uuid4().hex}"
    df = bucketed.store(regional_regular(spark, sf_dir), name, path=scratch_path(spark, "by-series"))
    return backtest.cv_seasonal_naive(df, 24, window=24, initial=13)


_METRICS = "count(error) AS n, count(*) - count(yhat) AS n_failed, avg(abs(error)) AS mae, sqrt(avg(error * error)) AS rmse"


@query(f"""
SELECT k, n, n_failed, round(mae, 3) AS mae, round(rmse, 3) AS rmse
FROM (SELECT k, {_METRICS} FROM ({_cv_snaive("prt_ser", 12, 25)}) GROUP BY 1)""", "prt_ser")
def cv_metrics_by_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = backtest.cv_seasonal_naive(parts_regular(spark, sf_dir), 12, initial=24)
    metrics = backtest.metrics_by_horizon(errors)
    return metrics.select("k", "n", "n_failed", F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"))


@query(f"""
SELECT series_id, {", ".join(f"round(avg(abs(error)) FILTER (k = {k}), 3) AS h{k}_mae, round(sqrt(avg(error * error) FILTER (k = {k})), 3) AS h{k}_rmse" for k in (12, 24))}
FROM ({_cv_snaive("reg_ser", 24, 13, 24)}) GROUP BY 1""", "reg_ser")
def cv_metrics_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error at horizons 12 and 24 of folds with a full horizon."""
    errors = backtest.cv_seasonal_naive(regional_regular(spark, sf_dir), 24, initial=12, full_horizon_only=True)
    wide = backtest.horizons_wide(backtest.metrics_by_horizon(errors, "series_id"), "series_id", [12, 24])
    return wide.withColumns({f"h{k}_{m}": F.round(f"h{k}_{m}", 3) for k in (12, 24) for m in ("mae", "rmse")})


@query(f"""
SELECT series_id, origin, coalesce(max(k) FILTER (yhat IS NOT NULL), 0) AS max_k FROM ({_cv_snaive("reg_ser", 6, 1)}) GROUP BY 1, 2""",
       "reg_ser")
def cv_longest_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = backtest.cv_seasonal_naive(regional_regular(spark, sf_dir), 6)
    return backtest.longest_horizon(errors, "series_id")


def _cv_line(y: str, x: str, first: int, width: str, src: str, h: int) -> str:
    return f"""
    SELECT o.series_id, o.idx AS origin, k, a.y, o.a + o.b * {"(o.idx + k)" if x == "idx" else f"a.{x}"} AS yhat
    FROM (SELECT series_id, idx, n, regr_slope({y}, {x}) OVER w AS b, regr_intercept({y}, {x}) OVER w AS a
          FROM (SELECT *, max(idx) OVER (PARTITION BY series_id) AS n FROM {src})
          WINDOW w AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN {width} PRECEDING AND CURRENT ROW)) o
    CROSS JOIN (SELECT CAST(unnest(range(1, {h} + 1)) AS INTEGER) AS k)
    LEFT JOIN {src} a ON a.series_id = o.series_id AND a.idx = o.idx + k
    WHERE o.idx >= {first} AND o.idx <= n - 1"""


@query(f"""
SELECT series_id, origin, k, y, round(yhat, 3) AS yhat FROM ({_cv_line("y", "idx", 24, "23", "reg_ser", 3)})""", "reg_ser")
def cv_errors_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = backtest.cv_linear_trend(regional_regular(spark, sf_dir), 3, window=24)
    return errors.select("series_id", "origin", "k", "y", F.round("yhat", 3).alias("yhat"))


@query(f"""
SELECT series_id, origin, k, y, round(yhat, 1) AS yhat FROM ({_cv_line("y", "x", 25, "UNBOUNDED", "reg_x", 3)})""", "reg_x")
def cv_errors_xreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = backtest.cv_regression(with_order_value(spark, sf_dir), 3, initial=24)
    return errors.select("series_id", "origin", "k", "y", F.round("yhat", 1).alias("yhat"))


@query("""
, cnt AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, CAST(count(*) AS DOUBLE) AS z FROM orders GROUP BY 1),
t AS (SELECT r.*, z FROM reg_x r LEFT JOIN cnt ON r.date = CAST(cnt.date + INTERVAL 1 MONTH AS DATE)),
g AS (SELECT *, CASE WHEN y IS NOT NULL AND x IS NOT NULL AND z IS NOT NULL THEN 1 END AS ok, max(idx) OVER (PARTITION BY series_id) AS n FROM t),
m AS (SELECT series_id, idx, n, avg(y * ok) OVER w AS my, avg(x * ok) OVER w AS mx, avg(z * ok) OVER w AS mz,
             covar_pop(x * ok, z * ok) OVER w AS xz, var_pop(x * ok) OVER w AS xx, var_pop(z * ok) OVER w AS zz,
             covar_pop(y * ok, x * ok) OVER w AS yx, covar_pop(y * ok, z * ok) OVER w AS yz
      FROM g WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
b AS (SELECT *, (yx * zz - yz * xz) / (xx * zz - xz * xz) AS bx, (yz * xx - yx * xz) / (xx * zz - xz * xz) AS bz FROM m)
SELECT b.series_id, b.idx AS origin, k, t.y, round(my + bx * (t.x - mx) + bz * (t.z - mz), 0) AS yhat
FROM b CROSS JOIN (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS k) LEFT JOIN t ON t.series_id = b.series_id AND t.idx = b.idx + k
WHERE b.idx >= 25 AND b.idx <= n - 1""", "reg_x")
def cv_errors_two_regressors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds of a regression on order value and number of orders of the month before."""
    month = F.trunc(F.col("o_orderdate").cast("date"), "month").alias("date")
    orders = c.table(spark, sf_dir, "orders").groupBy(month).agg(F.count("*").cast("double").alias("z"))
    df = series.with_regressor(with_order_value(spark, sf_dir), orders, name="z")
    errors = backtest.cv_two_regressors(df, 3, initial=24)
    return errors.select("series_id", "origin", "k", "y", F.round("yhat", 0).alias("yhat"))


_ACCURACY = """
, s AS (SELECT *, max(idx) OVER (PARTITION BY series_id) AS n FROM reg_ser),
rows AS (
  SELECT s.series_id, s.idx, s.y, f.y AS yhat, 'Training set' AS part FROM s LEFT JOIN s f ON f.series_id = s.series_id AND f.idx = s.idx - 12
  WHERE s.idx <= s.n - 24
  UNION ALL
  SELECT s.series_id, s.idx, s.y, f.y, 'Test set' FROM s LEFT JOIN s f ON f.series_id = s.series_id
     AND f.idx = s.idx - 12 * CAST(ceil((s.idx - s.n + 24) / 12.0) AS INTEGER) WHERE s.idx > s.n - 24),
scale AS (SELECT series_id, avg(abs(y - yhat)) AS scale FROM rows WHERE part = 'Training set' GROUP BY 1),
e AS (SELECT *, y - yhat AS e, lag(y) OVER w AS y0, y - yhat - avg(y - yhat) OVER (PARTITION BY series_id, part) AS c
      FROM rows WINDOW w AS (PARTITION BY series_id, part ORDER BY idx)),
l AS (SELECT *, lag(c) OVER (PARTITION BY series_id, part ORDER BY idx) AS c0 FROM e),
acc AS (
SELECT 'Seasonal Naive ' || part AS model, series_id, count(e) AS n, avg(e) AS me, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae,
       avg(100 * e / y) AS mpe, avg(abs(100 * e / y)) AS mape, avg(abs(e)) / max(scale) AS mase,
       (sum(c * c0) / (count(c * c0) + 1)) / avg(c * c) AS acf1,
       CASE WHEN part = 'Test set' THEN sqrt(sum(pow((yhat - y) / y0, 2)) / sum(pow(y / y0 - 1, 2)) FILTER (yhat IS NOT NULL)) END AS theils_u
FROM l JOIN scale USING (series_id) GROUP BY series_id, part)"""
_ROUNDED = "round(me, 3) AS me, round(rmse, 3) AS rmse, round(mae, 3) AS mae, round(mpe, 6) AS mpe, round(mape, 6) AS mape, round(mase, 6) AS mase, round(acf1, 6) AS acf1, round(theils_u, 6) AS theils_u"


def _snaive_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = series.split_train_test(regional_regular(spark, sf_dir), 24)
    rows = study.seasonal_naive_rows(split, 24)
    return evaluate.accuracy(rows, "model", "series_id", "part").drop("part")


def _rounded(table: DataFrame) -> DataFrame:
    places = {"me": 3, "rmse": 3, "mae": 3}
    return table.withColumns({m: F.round(m, places.get(m, 6)) for m in evaluate.MEASURES})


@query(f"{_ACCURACY} SELECT model, series_id, n, {_ROUNDED} FROM acc", "reg_ser")
def accuracy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_snaive_accuracy(spark, sf_dir))


_TESTS = """
, s AS (SELECT *, max(idx) OVER (PARTITION BY series_id) AS n FROM reg_x),
t AS (SELECT series_id, regr_slope(y, idx) AS b, regr_intercept(y, idx) AS a, regr_slope(y, x) AS bx, regr_intercept(y, x) AS ax
      FROM s WHERE idx <= n - 24 GROUP BY 1),
f AS (
  SELECT 'Trend' AS model, series_id, y - (a + b * idx) AS e, y FROM s JOIN t USING (series_id) WHERE idx > n - 24
  UNION ALL SELECT 'Regression', series_id, y - (ax + bx * x), y FROM s JOIN t USING (series_id) WHERE idx > n - 24
  UNION ALL SELECT 'Seasonal Naive', s.series_id, s.y - v.y, s.y FROM s JOIN s v ON v.series_id = s.series_id
     AND v.idx = s.idx - 12 * CAST(ceil((s.idx - s.n + 24) / 12.0) AS INTEGER) WHERE s.idx > s.n - 24)"""


@query(f"""{_TESTS}
SELECT model || ' Test set' AS model, series_id, round(sqrt(avg(e * e)), 2) AS rmse, round(avg(abs(100 * e / y)), 5) AS mape
FROM f GROUP BY f.model, series_id ORDER BY sqrt(avg(e * e)), 1, 2 LIMIT 10""", "reg_x")
def model_leaderboard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best (model, series) pairs on the test months; three models from one window pass, stacked."""
    ahead = forecast.of_test_months(series.split_train_test(with_order_value(spark, sf_dir), 24), 24)
    rows = ahead.unpivot(["series_id", "k", "y"], ["Trend", "Regression", "Seasonal Naive"], "model", "yhat")
    e = F.col("y") - F.col("yhat")
    table = rows.groupBy("series_id", "model").agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(100 * e / F.when(F.col("y") != 0, F.col("y")))).alias("mape"))
    table = table.withColumn("model", evaluate.labelled(F.col("model"), F.lit("Test set")))
    best = evaluate.leaderboard(table, "rmse", "model", "series_id", top=10, models="test")
    return best.select("model", "series_id", F.round("rmse", 2).alias("rmse"), F.round("mape", 5).alias("mape"))


@query(f"""
, a AS ({_cv_snaive("reg_ser", 12, 25)}), b AS ({_cv_snaive("reg_ser", 12, 30, 12)})
SELECT count(*) AS n_rows, count(*) FILTER (b.k IS NULL) AS n_left_only, count(*) FILTER (a.k IS NULL) AS n_right_only,
       count(*) FILTER (abs(a.yhat - b.yhat) > 0.1) AS n_different, max(abs(a.yhat - b.yhat)) AS max_gap
FROM a FULL JOIN b ON a.series_id = b.series_id AND a.origin = b.origin AND a.k = b.k""", "reg_ser")
def result_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All folds against full-horizon folds of a sliding window: equal where both exist."""
    df = regional_regular(spark, sf_dir)
    left = backtest.cv_seasonal_naive(df, 12, initial=24)
    right = backtest.cv_seasonal_naive(df, 12, window=24, initial=6, full_horizon_only=True)
    return evaluate.compare(left, right, ["series_id", "origin", "k"], "yhat", 0.1)


@query("""
, r AS (SELECT CAST(unnest(range(0, 3)) AS INTEGER) AS v)
SELECT series_id, concat_ws('_', 'arima', 'dr', upper(CAST(dr AS VARCHAR)), 'w', coalesce(CAST(w AS VARCHAR), 'NULL'), 'l', coalesce(l, 'NULL'),
       'ps', ps.v, 'ds', ds.v, 'qs', qs.v, 'p', p.v, 'd', d.v, 'q', q.v) AS config_id, w, l, dr, ps.v AS ps, ds.v AS ds, qs.v AS qs,
       p.v AS p, d.v AS d, q.v AS q
FROM (SELECT DISTINCT series_id FROM ord), (VALUES (NULL), (60)) t1(w), (VALUES (NULL), ('auto'), ('0')) t2(l),
     (VALUES (FALSE), (TRUE)) t3(dr), r ps, r ds, r qs, r p, r d, r q
WHERE NOT (d.v > 1 AND dr)""", "ord")
def param_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full grid for every order series: 7,290 configurations each."""
    ids = c.order_series(spark, sf_dir).select("series_id").distinct()
    return grid.arima_grid(ids).select("series_id", "config_id", *grid.ARIMA_RANGES)


def mean_of_training(y: np.ndarray, h: int, x: np.ndarray | None, x_future: np.ndarray | None, last: int = 0) -> np.ndarray:
    """A user's forecast function: mean of the last ``last`` months, of all when 0."""
    part = y[-last:] if last else y
    known = part[~np.isnan(part)]
    return np.full(h, known.mean() if len(known) else np.nan)


@query("""
, o AS (SELECT series_id, idx, max(idx) OVER (PARTITION BY series_id) AS n,
           avg(y) OVER (PARTITION BY series_id ORDER BY idx) AS f0,
           avg(y) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS f6 FROM reg_ser),
e AS (SELECT o.series_id, config_id, k, CASE config_id WHEN 'last_0' THEN f0 ELSE f6 END AS yhat, a.y - yhat AS error
      FROM o CROSS JOIN (VALUES ('last_0'), ('last_6')) v(config_id) CROSS JOIN (SELECT CAST(unnest(range(1, 5)) AS INTEGER) AS k)
      LEFT JOIN reg_ser a ON a.series_id = o.series_id AND a.idx = o.idx + k WHERE o.idx >= 25 AND o.idx < n)
SELECT config_id, k, count(error) AS n, count(*) - count(yhat) AS n_failed, round(avg(abs(error)), 2) AS mae, round(sqrt(avg(error * error)), 2) AS rmse
FROM e GROUP BY 1, 2""", "reg_ser")
def custom_forecaster_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validation of a forecast function passed in by the user, over two of its parameters."""
    errors = arima.custom_cv(regional_regular(spark, sf_dir), mean_of_training, 4, {"last": (0, 6)}, initial=24)
    metrics = backtest.metrics_by_horizon(errors, "config_id")
    return metrics.select("config_id", "k", "n", "n_failed", F.round("mae", 2).alias("mae"), F.round("rmse", 2).alias("rmse"))


@query("""
, o AS (SELECT series_id, idx, y, max(idx) OVER (PARTITION BY series_id) AS n,
           avg(y) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS f FROM reg_ser)
SELECT o.series_id, CAST(o.idx AS INTEGER) AS origin, CAST(k AS INTEGER) AS k, a.y, round(f, 3) AS yhat
FROM o CROSS JOIN (SELECT unnest(range(1, 5)) AS k) LEFT JOIN reg_ser a ON a.series_id = o.series_id AND a.idx = o.idx + k WHERE o.idx >= 25 AND o.idx < n""", "reg_ser")
def forecaster_from_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same user's forecast function as a table function of SQL, over each series in order."""
    register_cross_validation(spark, "mean_of_six", mean_of_training, last=6)
    regional_regular(spark, sf_dir).createOrReplaceTempView("regional_months")
    return spark.sql("""SELECT series_id, origin, k, y, round(yhat, 3) AS yhat
                        FROM mean_of_six(TABLE(SELECT series_id, idx, y FROM regional_months) PARTITION BY series_id ORDER BY idx, h => 4, initial => 24)""")


@query(f"""
SELECT series_id, config_id, n, round(mae, 3) AS mae, round(rmse, 3) AS rmse, TRUE AS is_timed FROM (
  SELECT series_id, 'initial_' || i AS config_id, {_METRICS}
  FROM ({_cv_snaive("reg_ser", 12, 1)}) CROSS JOIN (VALUES (12), (24), (36)) v(i) WHERE origin >= 1 + i GROUP BY ALL)""", "reg_ser")
def metrics_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of three settings, run in two calls; the second one finds the first one's work done."""
    df = study.export_series(regional_regular(spark, sf_dir), scratch_path(spark, "resume"))
    path = scratch_path(spark, "metrics")

    def evaluate_work(work: DataFrame) -> DataFrame:
        errors = backtest.cv_seasonal_naive(df.join(work.select("series_id").distinct(), "series_id", "left_semi"), 12).join(work, "series_id").filter(F.col("origin") > F.col("initial"))
        e = F.col("error")
        return errors.groupBy("series_id", "config_id").agg(
            F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))

    ids = df.select("series_id").distinct()
    for initials in ((12, 24), (12, 24, 36)):
        work = grid.add_grid(ids, {"initial": initials}).withColumn(
            "config_id", F.concat(F.lit("initial_"), F.col("initial").cast("string")))
        done = append_pending(work, ["series_id", "config_id"], path, evaluate_work)
    return done.select("series_id", "config_id", "n", F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"),
                       F.col("run_time").isNotNull().alias("is_timed"))


@query("""
, o AS (SELECT *, max(idx) OVER (PARTITION BY series_id) AS n, first(y) OVER w AS y1, avg(y) OVER w AS m,
           regr_slope(y, idx) OVER w AS b, regr_intercept(y, idx) OVER w AS a, avg(y - y12) OVER w AS s
        FROM (SELECT *, lag(y, 12) OVER (PARTITION BY series_id ORDER BY idx) AS y12 FROM typ_ser)
        WINDOW w AS (PARTITION BY series_id ORDER BY idx))
SELECT o.series_id, o.idx AS origin, k, dr, d, ds, round(CASE
         WHEN d = 0 AND ds = 0 THEN CASE WHEN dr THEN a + b * (o.idx + k) ELSE m END
         WHEN d = 1 AND ds = 0 THEN o.y + CASE WHEN dr THEN k * (o.y - y1) / (o.idx - 1) ELSE 0 END
         WHEN d = 0 AND ds = 1 THEN l.y + CASE WHEN dr THEN s ELSE 0 END
         ELSE o.y + l.y - o.y12 END, 3) AS yhat
FROM o CROSS JOIN (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS k)
CROSS JOIN (VALUES (FALSE), (TRUE)) t(dr) CROSS JOIN (VALUES (0), (1)) u(d) CROSS JOIN (VALUES (0), (1)) v(ds)
JOIN typ_ser l ON l.series_id = o.series_id AND l.idx = o.idx + k - 12
WHERE o.idx >= 25 AND o.idx <= n - 3""", "typ_ser")
def arima_closed_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validation of the ARIMA configurations whose forecast has a closed form: mean, trend, random
    walk, seasonal random walk, each with and without drift, and both differences together."""
    df = series.regular(c.type_series(spark, sf_dir))
    work = arima.work_rows(df, {"dr": (False, True), "d": (0, 1), "ds": (0, 1)})
    errors = arima.arima_cv(work, 3, initial=24, full_horizon_only=True)
    part = lambda name: F.regexp_extract("config_id", f"_{name}_([^_]*)", 1)
    return errors.select("series_id", "origin", "k", part("dr").cast("boolean").alias("dr"), part("d").cast("int").alias("d"),
                         part("ds").cast("int").alias("ds"), F.round("yhat", 3).alias("yhat"))


_AR1 = """
l AS (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY idx) AS x1 FROM {0}),
ar AS (SELECT series_id, regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a, regr_count(y, x1) AS m FROM l GROUP BY 1),
res AS (SELECT l.series_id, l.idx, l.y, l.date, a, b, m, l.y - (a + b * x1) AS e FROM l JOIN ar USING (series_id))"""
_AHEAD = "a * list_sum(list_transform(range(0, k), lambda j: pow(b, j))) + pow(b, k) * y"


def _cv_ar1(width: str, first: int) -> str:
    return f"""
    SELECT series_id, o.idx, k, z.y - ({_AHEAD.replace("* y", "* o.y")}) AS error, {_AHEAD.replace("* y", "* o.y")} AS yhat FROM (
      SELECT series_id, idx, y, max(idx) OVER (PARTITION BY series_id) AS n, regr_slope(y, x1) OVER w AS b, regr_intercept(y, x1) OVER w AS a
      FROM l WINDOW w AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN {width} PRECEDING AND CURRENT ROW)) o
    CROSS JOIN (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS k)
    LEFT JOIN (SELECT series_id, idx, y FROM l) z USING (series_id) WHERE z.idx = o.idx + k AND o.idx >= {first} AND o.idx <= n - 12"""


@query(f"""
, {_AR1.format("reg_ser")},
e AS (SELECT 'arima_w_NULL_p_1' AS config_id, * FROM ({_cv_ar1("UNBOUNDED", 25)})
      UNION ALL SELECT 'arima_w_36_p_1', * FROM ({_cv_ar1("34", 36)}))
SELECT config_id, {", ".join(f"round(avg(abs(error)) FILTER (k = {k}), 2) AS h{k}_mae, round(sqrt(avg(error * error) FILTER (k = {k})), 2) AS h{k}_rmse" for k in (6, 12))}
FROM e GROUP BY 1""", "reg_ser")
def arima_grid_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-order autoregression of every regional series over an expanding and a sliding window, as window aggregates."""
    df = regional_regular(spark, sf_dir)
    errors = evaluate.stack([
        autoregress.cv(df, 12, window, initial, full_horizon_only=True).withColumn("config_id", F.lit(f"arima_w_{window or 'NULL'}_p_1"))
        for window, initial in ((None, 24), (36, 0))])
    best = backtest.horizons_wide(backtest.metrics_by_horizon(errors, "config_id"), "config_id", [6, 12])
    return best.withColumns({f"h{k}_{m}": F.round(f"h{k}_{m}", 2) for k in (6, 12) for m in ("mae", "rmse")})


@query(f"""
, {_AR1.format("prt_ser")},
q AS (SELECT series_id, idx, e, y - lag(y) OVER w AS d, y - avg(y) OVER (PARTITION BY series_id) AS c FROM res WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
s AS (SELECT series_id, unnest(['ar1', 'mean', 'random walk']) AS model, unnest([3, 2, 1]) AS k, CAST(count(e) AS DOUBLE) AS m,
             unnest([avg(e * e), avg(c * c) FILTER (e IS NOT NULL), avg(d * d) FILTER (e IS NOT NULL)]) AS loss FROM q GROUP BY 1),
v AS (SELECT *, CASE WHEN m - k - 1 > 0 AND loss > 0 THEN m * ln(loss) + 2 * k + 2 * k * (k + 1) / (m - k - 1) END AS aicc FROM s)
SELECT series_id, arg_min(model, aicc) AS model, round(min(aicc), 4) AS aicc, CAST(max(m) AS BIGINT) AS n_obs FROM v GROUP BY 1""", "prt_ser")
def arima_auto_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of every part's series, short and gappy ones included, by AICc on common months."""
    return autoregress.order_choice(parts_regular(spark, sf_dir)).withColumn("aicc", F.round("aicc", 4))


@query(f"""
, {_AR1.format("reg_ser")},
s AS (SELECT series_id, CASE WHEN max(m) > 2 THEN sum(e * e) / (max(m) - 2) END AS sigma2, max(idx) AS n FROM res GROUP BY 1),
f AS (SELECT series_id, CAST(n AS INTEGER) AS origin, k, CAST(date + to_months(CAST(k AS INTEGER)) AS DATE) AS date, {_AHEAD} AS yhat,
             sqrt(sigma2 * list_sum(list_transform(range(0, k), lambda j: pow(b, 2 * j)))) AS sd
      FROM res JOIN s USING (series_id) CROSS JOIN (SELECT CAST(unnest(range(1, 25)) AS INTEGER) AS k) WHERE idx = n)
SELECT series_id, origin, k, date, round(yhat, 2) AS yhat, round(yhat - 1.2815515655446004 * sd, 2) AS lo80, round(yhat + 1.2815515655446004 * sd, 2) AS hi80,
       round(yhat - 1.959963984540054 * sd, 2) AS lo95, round(yhat + 1.959963984540054 * sd, 2) AS hi95 FROM f""", "reg_ser")
def arima_forecast_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = autoregress.forecast(regional_regular(spark, sf_dir), 24)
    return rows.withColumns({b: F.round(b, 2) for b in ("yhat", "lo80", "hi80", "lo95", "hi95")})


@query(f"""
, {_AR1.format("reg_ser")}, {_CENTRED.format("e", "res")},
s AS (SELECT series_id, max(n) AS n, max(n) * (max(n) + 2) * sum(acf * acf / (n - lag)) AS q FROM ({_ACF.replace("range(1, 25)", "range(1, 26)")}) GROUP BY 1)
SELECT series_id, n, round(q, 5) AS statistic, 24 AS df,
       round(exp(-q / 2) * list_sum(list_transform(range(0, 12), lambda j: pow(q / 2, j) / factorial(CAST(j AS INTEGER)))), 6) AS p_value
FROM (SELECT series_id, n, CASE WHEN n > 25 THEN q END AS q FROM s)""", "reg_ser")
def arima_residual_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ljung-Box test on the one-step residuals of a fitted model."""
    test = diagnose.ljung_box(autoregress.fitted(regional_regular(spark, sf_dir)), 25, fitted=1)
    return test.withColumns({"statistic": F.round("statistic", 5), "p_value": F.round("p_value", 6)})


@query(f"""
, s0 AS (SELECT *, max(idx) OVER (PARTITION BY series_id) AS n FROM reg_ser), t0 AS (SELECT series_id, idx, date, y FROM s0 WHERE idx <= n - 48),
{_AR1.format("t0")},
o AS (SELECT DISTINCT ON (series_id) series_id, idx, y, a, b FROM res ORDER BY series_id, idx DESC),
f AS (SELECT 'Autoregression' AS model, s0.series_id, s0.y - ({_AHEAD.replace("k", "(s0.idx - o.idx)").replace("* y", "* o.y")}) AS e FROM s0 JOIN o USING (series_id) WHERE s0.idx > n - 48
      UNION ALL SELECT 'Seasonal Naive', s0.series_id, s0.y - v.y FROM s0 JOIN s0 v ON v.series_id = s0.series_id
         AND v.idx = s0.idx - 12 * CAST(ceil((s0.idx - s0.n + 48) / 12.0) AS INTEGER) WHERE s0.idx > s0.n - 48)
SELECT model || ' Test set' AS model, series_id, round(sqrt(avg(e * e)), 2) AS rmse FROM f GROUP BY f.model, series_id""", "reg_ser")
def ar1_test_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Autoregression and seasonal naive on the 48 held-out months of every regional series."""
    split = series.split_train_test(regional_regular(spark, sf_dir), 48)
    train, test = (split.filter(F.col("part") == p) for p in ("train", "test"))
    ahead = {"Autoregression": autoregress.forecast(train, 48), "Seasonal Naive": forecast.seasonal_naive(train, 48)}
    forecasts = evaluate.stack([rows.select("series_id", "k", "yhat", F.lit(name).alias("model")) for name, rows in ahead.items()])
    e = F.col("y") - F.col("yhat")
    table = test.join(forecasts, ["series_id", "k"], "left").groupBy("series_id", "model").agg(F.sqrt(F.avg(e * e)).alias("rmse"))
    return table.select(evaluate.labelled(F.col("model"), F.lit("Test set")).alias("model"), "series_id", F.round("rmse", 2).alias("rmse"))


def from_first_regressor(df: DataFrame) -> DataFrame:
    """Each series from the first month whose regressor is known, numbered from 1."""
    first = F.min(F.when(F.col("x").isNotNull(), F.col("idx"))).over(series.whole())
    rows = df.withColumn("_first", first).filter(F.col("idx") >= F.col("_first"))
    return rows.withColumn("idx", F.col("idx") - F.col("_first") + 1).drop("_first")


# Every parameter of the full grid, ``auto`` included, with its first two values; the series are too short for a window of 60.
GRID_RANGES = {name: values[:2] for name, values in grid.ARIMA_RANGES.items()} | {"w": (None, 48)}


@query()
def arima_grid_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """512 configurations of all nine parameters, MA terms included, with a regressor on every order series; 24 months ahead
    from each origin with a full horizon. Conditional least squares with MA terms has no SQL; tests check it."""
    x = c.part_series(spark, sf_dir).groupBy("date").agg(F.sum("y").alias("x"))
    df = from_first_regressor(series.with_regressor(orders_regular(spark, sf_dir), x))
    metrics = arima.grid_cv_metrics(df, GRID_RANGES, 24, initial=6)
    return evaluate.leaderboard(backtest.horizons_wide(metrics, "config_id", [12, 24]), "h24_rmse", "config_id")


@query()
def study_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two models chosen by hand, automatic ones and seasonal naive on every regional series, ranked on 48 held-out months."""
    df = study.export_series(from_first_regressor(with_order_value(spark, sf_dir)), scratch_path(spark, "study"))
    table = study.model_accuracy(df, 48, {"p": (0, 1), "d": (0, 1), "q": (0, 1)})
    return study.leaderboard_of_tests(table)
