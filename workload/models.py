"""Linear models of any order: fits, forecasts, folds and the stepwise choice of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.operators import backtest, linear, series, stepwise
from seriesforge.operators.linear import Model
from seriesforge.plans import study
from workload import catalogs as c
from workload.analysis import regional_regular, with_order_value
from workload.registry import query

TWO_SEASONS = Model(p=2, ps=1, dr=True, regressors=("x", "z"))
ONE_REGRESSOR = Model(p=2, ps=1, regressors=("x",))
YEARLY = Model(p=1, ds=1, dr=True, regressors=("x",))


def with_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regional series with order value (x) and number of orders (z) of the month before."""
    month = F.trunc(F.col("o_orderdate").cast("date"), "month").alias("date")
    orders = c.table(spark, sf_dir, "orders").groupBy(month).agg(F.count("*").cast("double").alias("z"))
    return series.with_regressor(with_order_value(spark, sf_dir), orders, name="z")


_REG_XZ = """
cnt AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, CAST(count(*) AS DOUBLE) AS z FROM orders GROUP BY 1),
src AS (SELECT r.*, z FROM reg_x r LEFT JOIN cnt ON r.date = CAST(cnt.date + INTERVAL 1 MONTH AS DATE))"""


def _design(raw: list[str], terms: list[str], src: str = "src", tag: str = "") -> str:
    """Steps d0-d2 (with a tag): columns as they are, scaled by series (v0 the target), and the list of all terms and the target where all are known."""
    o = "(PARTITION BY series_id ORDER BY idx)"
    scaled = ", ".join(f"(r{i} - avg(r{i}) OVER s) / coalesce(nullif(stddev_pop(r{i}) OVER s, 0), 1) AS v{i}, avg(r{i}) OVER s AS m{i}, "
                       f"coalesce(nullif(stddev_pop(r{i}) OVER s, 0), 1) AS s{i}" for i in range(len(raw)))
    listed = f"[{', '.join(terms)}, v0]"
    return f"""
d0{tag} AS (SELECT series_id, idx, date, y, max(idx) OVER (PARTITION BY series_id) AS last, {", ".join(f"{r} AS r{i}" for i, r in enumerate(raw))} FROM {src} WINDOW o AS {o}),
d1{tag} AS (SELECT *, {scaled} FROM d0{tag} WINDOW s AS (PARTITION BY series_id)),
d2{tag} AS (SELECT *, CASE WHEN len([x FOR x IN {listed} IF x IS NULL]) = 0 THEN {listed} END AS v FROM d1{tag} WINDOW o AS {o})"""


def _moments(size: int, over: str = "") -> str:
    """n and the normal equations, the target's row last."""
    rows = ", ".join("[" + ", ".join(f"sum(v[{i}] * v[{j}]){over}" for j in range(1, size + 2)) + "]" for i in range(1, size + 2))
    return f"count(v){over} AS n, [{rows}] AS m"


def _elimination(src: str, keys: str, size: str, tag: str = "") -> str:
    """Steps e and sol (with a tag): the equations solved for each key, where there are more months than terms and no pivot vanishes."""
    return f"""
e{tag} AS (
    SELECT {keys}, n, 0 AS i, {size} AS size, m FROM {src} WHERE n > {size}
    UNION ALL
    SELECT {keys}, n, i + 1, size, [CASE WHEN r = i THEN [x / piv FOR x IN m[i + 1]]
                                   ELSE [m[r + 1][k + 1] - m[r + 1][i + 1] * m[i + 1][k + 1] / piv FOR k IN range(size + 1)] END FOR r IN range(size)]
    FROM (SELECT *, CASE WHEN m[i + 1][i + 1] > 1e-9 * n THEN m[i + 1][i + 1] END AS piv FROM e{tag} WHERE i < size)),
sol{tag} AS (SELECT {keys}, [r[-1] FOR r IN m] AS c FROM e{tag} WHERE i = size AND len([r FOR r IN m IF r[-1] IS NULL]) = 0)"""


_LOSS = "greatest(f.m[{0}][{0}] - list_inner_product(sol.c, [f.m[{0}][i + 1] FOR i IN range({0} - 1)]), 1e-12 * f.m[{0}][{0}])"
_TERMS = ["1.0", "v1", "lag(v0, 1) OVER o", "lag(v0, 2) OVER o", "lag(v0, 12) OVER o", "v2", "v3"]


@query(f"""
, {_REG_XZ}, {_design(["y", "CAST(idx AS DOUBLE)", "x", "z"], _TERMS)},
f AS (SELECT series_id, any_value(m0) AS m0, any_value(s0) AS s0, any_value(m1) AS m1, any_value(s1) AS s1, any_value(m2) AS m2, any_value(s2) AS s2,
             any_value(m3) AS m3, any_value(s3) AS s3, {_moments(7)} FROM d2 GROUP BY 1),
{_elimination("f", "series_id", "7")},
u AS (SELECT f.*, c, {_LOSS.format(8)} * s0 * s0 AS loss, c[2] * s0 / s1 AS bt, c[6] * s0 / s2 AS bx, c[7] * s0 / s3 AS bz FROM f LEFT JOIN sol USING (series_id)),
t AS (SELECT *, unnest(['constant', 'trend', 'lag1', 'lag2', 'lag12', 'x', 'z']) AS term,
             unnest([m0 + s0 * c[1] - bt * m1 - (c[3] + c[4] + c[5]) * m0 - bx * m2 - bz * m3, bt, c[3], c[4], c[5], bx, bz]) AS estimate FROM u)
SELECT series_id, term, CASE WHEN term = 'constant' THEN round(estimate, 1) ELSE round(estimate, 6) END AS estimate, n AS n_obs,
       CASE WHEN n > 7 THEN round(loss / (n - 7), 0) END AS sigma2,
       CASE WHEN n > 9 THEN round(n * ln(loss / n) + 16 + 2.0 * 8 * 9 / (n - 9), 5) END AS aicc FROM t""", "reg_x")
def ar_seasonal_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two months back, a year back, trend and two regressors: the coefficients of every regional series."""
    rows = linear.coefficients(with_orders(spark, sf_dir), TWO_SEASONS)
    estimate = F.when(F.col("term") == "constant", F.round("estimate", 1)).otherwise(F.round("estimate", 6))
    return rows.withColumns({"estimate": estimate, "sigma2": F.round("sigma2", 0), "aicc": F.round("aicc", 5)})


def _ahead(start: str, h: int, value: str, tag: str = "") -> str:
    """Step a (with a tag): from rows (c, past, ...) the list ``past`` grown by ``h`` forecasts."""
    return f"""
a{tag} AS (SELECT *, 0 AS k FROM {start}
      UNION ALL SELECT * REPLACE (list_append(past, {value}) AS past, k + 1 AS k) FROM a{tag} WHERE k < {h})"""


_PAST = "list(v0) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"
_NEXT = "list(v1) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND {} FOLLOWING)"
_AR_X = "c[1] + c[2] * past[-1] + c[3] * past[-2] + c[4] * past[-12] + c[5] * next[k + 1]"


@query(f"""
, src AS (SELECT * FROM reg_x),
{_design(["y", "x"], ["1.0", "lag(v0, 1) OVER o", "lag(v0, 2) OVER o", "lag(v0, 12) OVER o", "v1"])},
w AS (SELECT *, {_PAST} AS past, {_NEXT.format(12)} AS next FROM d2),
f AS (
    SELECT series_id, CAST(NULL AS INTEGER) AS win, idx, last, past, next, m0, s0, {_moments(5, " OVER x")} FROM w WINDOW x AS (PARTITION BY series_id ORDER BY idx)
    UNION ALL
    SELECT series_id, 48, idx, last, past, next, m0, s0, {_moments(5, " OVER x")} FROM w WINDOW x AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)),
g AS (SELECT * FROM f WHERE idx >= coalesce(win, 1) + 24 AND idx < last),
{_elimination("g", "series_id, win, idx", "5")},
st AS (SELECT g.series_id, g.win, g.idx, m0, s0, past, next, c FROM g LEFT JOIN sol ON sol.series_id = g.series_id AND sol.idx = g.idx AND sol.win IS NOT DISTINCT FROM g.win),
{_ahead("st", 12, _AR_X)},
p AS (SELECT series_id, win, idx, unnest(range(1, 13)) AS k, m0 + s0 * unnest(past[-12:]) AS yhat FROM a WHERE k = 12),
r AS (SELECT p.*, z.y - yhat AS error FROM p LEFT JOIN src z ON z.series_id = p.series_id AND z.idx = p.idx + p.k)
SELECT CAST(win AS INTEGER) AS "window", CAST(k AS INTEGER) AS k, count(error) AS n, count(*) - count(yhat) AS n_failed, round(avg(abs(error)), 1) AS mae,
       round(sqrt(avg(error * error)), 1) AS rmse FROM r GROUP BY 1, 2""", "reg_x")
def cv_ar_seasonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds of autoregression two months and a year back with a regressor, expanding and over 48 months, in one pass."""
    errors = linear.cv(with_order_value(spark, sf_dir), ONE_REGRESSOR, 12, (None, 48), initial=24)
    metrics = backtest.metrics_by_horizon(errors, "window")
    return metrics.select("window", "k", "n", "n_failed", F.round("mae", 1).alias("mae"), F.round("rmse", 1).alias("rmse"))


@query(f"""
, src AS (SELECT series_id, idx, date, CASE WHEN idx <= max(idx) OVER (PARTITION BY series_id) - 24 THEN y END AS y, x FROM reg_x),
{_design(["y - lag(y, 12) OVER o", "x - lag(x, 12) OVER o"], ["1.0", "lag(v0, 1) OVER o", "v1"])},
w AS (SELECT *, {_PAST} AS past, {_NEXT.format(24)} AS next,
             list(y) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS told,
             max(CASE WHEN y IS NOT NULL THEN idx END) OVER (PARTITION BY series_id) AS origin FROM d2),
f AS (SELECT series_id, {_moments(3)} FROM d2 GROUP BY 1),
{_elimination("f", "series_id", "3")},
st AS (SELECT w.series_id, idx, date, m0, s0, past, next, told, c, sqrt({_LOSS.format(4)} / (f.n - 3)) * s0 AS sd
       FROM w JOIN f USING (series_id) LEFT JOIN sol USING (series_id) WHERE idx = coalesce(origin, last)),
{_ahead("st", 24, "c[1] + c[2] * past[-1] + c[3] * next[k + 1]")},
p AS (SELECT * EXCLUDE (k, past, told, next), k + 1 AS k, CASE WHEN k < 12 THEN told[k + 1] + m0 + s0 * past[-24 + k]
             ELSE told[k - 11] + 2 * m0 + s0 * (past[-24 + k] + past[-36 + k]) END AS yhat
      FROM (SELECT * EXCLUDE (k), unnest(range(0, 24)) AS k FROM a WHERE k = 24)),
q AS (SELECT *, sd * sqrt(list_sum([pow(CASE WHEN j < 12 THEN pow(c[2], j) ELSE pow(c[2], j) + pow(c[2], j - 12) END, 2) FOR j IN range(k)])) AS spread FROM p)
SELECT series_id, CAST(idx AS INTEGER) AS origin, CAST(k AS INTEGER) AS k, CAST(date + to_months(CAST(k AS INTEGER)) AS DATE) AS date, round(yhat, 2) AS yhat,
       round(yhat - 1.959963984540054 * spread, 2) AS lo95, round(yhat + 1.959963984540054 * spread, 2) AS hi95 FROM q""", "reg_x")
def ar_seasonal_difference_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 held-out months by an autoregression of the yearly differences with drift and a regressor, with intervals."""
    df = with_order_value(spark, sf_dir)
    known = df.withColumn("y", F.when(F.col("idx") <= F.max("idx").over(series.whole()) - 24, F.col("y")))
    rows = linear.forecast(known, YEARLY, 24)
    return rows.select("series_id", "origin", "k", "date", *[F.round(v, 2).alias(v) for v in ("yhat", "lo95", "hi95")])


# All models up to p = 3, ps = 1, with and without trend: the terms of each as places in the largest model's list.
_STEPWISE = f"""
, src AS (SELECT * FROM reg_ser),
{_design(["y", "CAST(idx AS DOUBLE)"], ["1.0", "v1", "lag(v0, 1) OVER o", "lag(v0, 2) OVER o", "lag(v0, 3) OVER o", "lag(v0, 12) OVER o"])},
f AS (SELECT series_id, any_value(s0) AS s0, {_moments(6)} FROM d2 GROUP BY 1),
orders AS (SELECT CAST(p AS INTEGER) AS p, CAST(ps AS INTEGER) AS ps, dr, [0] || CASE WHEN dr THEN [1] ELSE [] END || [1 + i FOR i IN range(1, p + 1)] || CASE WHEN ps = 1 THEN [5] ELSE [] END AS pick
           FROM range(4) a(p), range(2) b(ps), (VALUES (false), (true)) v(dr)),
g AS (SELECT series_id, p, ps, dr, n, s0, len(pick) AS size, f.m[7][7] AS own, [f.m[7][i + 1] FOR i IN pick] AS rhs,
             [[f.m[i + 1][j + 1] FOR j IN pick] || [f.m[7][i + 1]] FOR i IN pick] AS m FROM f, orders),
{_elimination("g", "series_id, p, ps, dr", "size")},
l AS (SELECT g.*, CASE WHEN sol.c IS NOT NULL THEN greatest(own - list_inner_product(sol.c, rhs), 1e-12 * own) * s0 * s0 END AS loss, size + 1 AS kk FROM g LEFT JOIN sol USING (series_id, p, ps, dr)),
sc AS (SELECT series_id, p, ps, dr, CASE WHEN n - kk - 1 > 0 AND loss > 0 THEN n * ln(loss / n) + 2 * kk + 2.0 * kk * (kk + 1) / (n - kk - 1) END AS aicc FROM l),
mv(dp, dq) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, -1), (0, 0)),
walk AS (
    SELECT series_id, 0 AS round, list({{'p': p, 'ps': ps, 'dr': dr}}) AS visited, list({{'p': p, 'ps': ps, 'dr': dr}}) AS fresh,
           min(CASE WHEN aicc IS NOT NULL THEN {{'aicc': aicc, 'p': p, 'ps': ps, 'dr': dr}} END) AS best, true AS gained
    FROM sc WHERE NOT dr AND (p, ps) IN ((2, 1), (0, 0), (1, 0), (0, 1)) GROUP BY series_id
    UNION ALL
    SELECT series_id, round + 1, any_value(visited) || list(s), list(s), least(any_value(best), min(CASE WHEN aicc IS NOT NULL THEN {{'aicc': aicc, 'p': s.p, 'ps': s.ps, 'dr': s.dr}} END)),
           coalesce(min(CASE WHEN aicc IS NOT NULL THEN {{'aicc': aicc, 'p': s.p, 'ps': s.ps, 'dr': s.dr}} END) < any_value(best), false)
    FROM (SELECT w.*, {{'p': sc.p, 'ps': sc.ps, 'dr': sc.dr}} AS s, sc.aicc FROM walk w, mv JOIN sc ON sc.series_id = w.series_id
          WHERE w.gained AND w.best IS NOT NULL AND sc.p = w.best.p + dp AND sc.ps = w.best.ps + dq
            AND sc.dr = CASE WHEN dp = 0 AND dq = 0 THEN NOT w.best.dr ELSE w.best.dr END)
    WHERE NOT list_contains(visited, s) GROUP BY series_id, round)"""


@query(f"""{_STEPWISE}
SELECT sc.series_id, m.p AS p, m.ps AS ps, m.dr AS dr, CAST(round AS INTEGER) AS round, round(aicc, 5) AS aicc
FROM (SELECT series_id, round, unnest(fresh) AS m FROM walk) v JOIN sc ON sc.series_id = v.series_id AND sc.p = m.p AND sc.ps = m.ps AND sc.dr = m.dr""", "reg_ser")
def ar_stepwise_visited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every model that the stepwise search tries for every regional series, and in which round."""
    visited = stepwise.search(regional_regular(spark, sf_dir), max_p=3, max_ps=1)
    return visited.withColumn("aicc", F.round("aicc", 5))


@query(f"""{_STEPWISE}
SELECT series_id, arg_max(best, round).p AS p, arg_max(best, round).ps AS ps, arg_max(best, round).dr AS dr, round(arg_max(best, round).aicc, 5) AS aicc,
       CAST(max(len(visited)) AS BIGINT) AS n_visited, CAST(max(round) + 1 AS INTEGER) AS rounds FROM walk GROUP BY 1""", "reg_ser")
def ar_stepwise_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model that the stepwise search ends with for every regional series."""
    found = stepwise.choice(stepwise.search(regional_regular(spark, sf_dir), max_p=3, max_ps=1))
    return found.withColumn("aicc", F.round("aicc", 5))


def _held_out(tag: str, raw: list[str], terms: list[str], value: str) -> str:
    """Steps from the training months of src to st (past, next, values told, coefficients at the origin) and the 24 forecasts of a."""
    size = len(terms)
    x = f"list(v{len(raw) - 1}) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING)"
    return f"""
{_design(raw, terms, tag=tag)},
w{tag} AS (SELECT *, {_PAST} AS past, {x} AS next, list(y) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS told,
             max(CASE WHEN y IS NOT NULL THEN idx END) OVER (PARTITION BY series_id) AS origin FROM d2{tag}),
f{tag} AS (SELECT series_id, {_moments(size)} FROM d2{tag} GROUP BY 1),
{_elimination(f"f{tag}", "series_id", str(size), tag)},
st{tag} AS (SELECT * FROM w{tag} LEFT JOIN sol{tag} USING (series_id) WHERE idx = coalesce(origin, last)),
{_ahead(f"st{tag}", 24, value, tag)}"""


HELD_OUT = {"Hyper AR": Model(p=2, ps=1, dr=True, regressors=("x",)), "Hyper AR Seasonal": Model(p=2, ps=1, ds=1, dr=True, regressors=("x",))}


@query(f"""
, src AS (SELECT series_id, idx, date, CASE WHEN idx <= max(idx) OVER (PARTITION BY series_id) - 24 THEN y END AS y, x FROM reg_x),
{_held_out("1", ["y", "CAST(idx AS DOUBLE)", "x"], ["1.0", "v1", "lag(v0, 1) OVER o", "lag(v0, 2) OVER o", "lag(v0, 12) OVER o", "v2"],
           "c[1] + c[2] * (idx + k + 1 - m1) / s1 + c[3] * past[-1] + c[4] * past[-2] + c[5] * past[-12] + c[6] * next[k + 1]")},
{_held_out("2", ["y - lag(y, 12) OVER o", "x - lag(x, 12) OVER o"], ["1.0", "lag(v0, 1) OVER o", "lag(v0, 2) OVER o", "lag(v0, 12) OVER o", "v1"], _AR_X)},
n AS (SELECT *, max(idx) OVER (PARTITION BY series_id) AS last FROM reg_x),
p AS (
    SELECT 'Hyper AR' AS model, series_id, idx + k + 1 AS idx, m0 + s0 * past[-24 + k] AS yhat FROM (SELECT * EXCLUDE (k), unnest(range(0, 24)) AS k FROM a1 WHERE k = 24)
    UNION ALL
    SELECT 'Hyper AR Seasonal', series_id, idx + k + 1, CASE WHEN k < 12 THEN told[k + 1] + m0 + s0 * past[-24 + k] ELSE told[k - 11] + 2 * m0 + s0 * (past[-24 + k] + past[-36 + k]) END
    FROM (SELECT * EXCLUDE (k), unnest(range(0, 24)) AS k FROM a2 WHERE k = 24)
    UNION ALL
    SELECT 'Seasonal Naive', n.series_id, n.idx, v.y FROM n JOIN n v ON v.series_id = n.series_id AND v.idx = n.idx - 12 * CAST(ceil((n.idx - n.last + 24) / 12.0) AS INTEGER)
    WHERE n.idx > n.last - 24)
SELECT p.model || ' Test set' AS model, p.series_id, count(n.y - yhat) AS n, round(sqrt(avg(pow(n.y - yhat, 2))), 1) AS rmse,
       round(avg(abs(100 * (n.y - yhat) / nullif(n.y, 0))), 4) AS mape
FROM p JOIN n ON n.series_id = p.series_id AND n.idx = p.idx WHERE p.idx > n.last - 24 GROUP BY p.model, p.series_id""", "reg_x")
def linear_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hand-chosen models with seasonal orders and a regressor beside seasonal naive, on 24 held-out months of every regional series."""
    table = study.linear_accuracy(with_order_value(spark, sf_dir), 24, HELD_OUT)
    return table.select("model", "series_id", "n", F.round("rmse", 1).alias("rmse"), F.round("mape", 4).alias("mape"))
