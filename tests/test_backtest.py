import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import indexed, month, rows
from seriesforge.operators import arima, autoregress, backtest, css, diagnose, evaluate, forecast, grid
from seriesforge.operators.css import fit
from seriesforge.sources.sinks import explain_text

SEASONAL = [100 + 10 * (i % 12) + i for i in range(40)]


def test_seasonal_naive(spark):
    df = indexed(spark, s=SEASONAL, short=[1.0] * 11, gap=[None if i == 30 else float(i) for i in range(36)])
    out = {(r["series_id"], r["k"]): r for r in forecast.seasonal_naive_interval(df, 26).collect()}
    assert {s for s, _ in out} == {"s", "gap", "short"}
    assert sorted(k for s, k in out if s == "short") == list(range(1, 27))  # a row for each month, without a forecast
    assert all(r["yhat"] is None and r["lo80"] is None for (s, _), r in out.items() if s == "short")
    for k in range(1, 27):
        assert out["s", k]["yhat"] == SEASONAL[28 + (k - 1) % 12]
    assert out["s", 1]["date"] == month(40) and out["s", 26]["origin"] == 40
    assert out["gap", 7]["yhat"] is None and out["gap", 8]["yhat"] == 31.0
    assert out["s", 1]["sigma"] == 12.0
    assert out["s", 25]["hi95"] - out["s", 25]["yhat"] == pytest.approx(1.959963984540054 * 12 * np.sqrt(3))


def test_trend_and_regression(spark):
    line = forecast.linear_trend(indexed(spark, s=[3.0 + 2 * i for i in range(10)]), 3)
    assert [r["yhat"] for r in line.orderBy("k").collect()] == pytest.approx([23, 25, 27])
    from seriesforge.operators.series import split_train_test

    x = [1, 4, 2, 8, 5, 7, 3, 9]
    df = indexed(spark, x=x, s=[10 + 3 * v if i < 5 else 0.0 for i, v in enumerate(x)])
    out = forecast.regression(split_train_test(df, 3)).orderBy("k").collect()
    assert [r["yhat"] for r in out] == pytest.approx([31, 19, 37])


def brute_folds(n, h, window, initial, full):
    first = (window or 1) + initial
    last = n - h if full else n - 1
    return [(i, i - window + 1 if window else 1, min(h, n - i)) for i in range(first, last + 1)]


@pytest.mark.parametrize("window, initial, full", [(None, 0, False), (None, 5, True), (6, 2, False), (6, 0, True)])
def test_folds(spark, window, initial, full):
    df = indexed(spark, s=range(15), one=[1], two=range(2))
    out = backtest.folds(df, 4, window, initial, full)
    assert rows(out.filter("series_id = 's'"), "origin", "train_start", "max_k") == sorted(
        brute_folds(15, 4, window, initial, full), key=repr)
    assert out.filter("series_id = 'one'").count() == 0


def brute_snaive(y, h, window, initial, full):
    out = []
    for i, start, _ in brute_folds(len(y), h, window, initial, full):
        train = y[start - 1:i]
        for k in range(1, h + 1):
            yhat = float(train[-12 + (k - 1) % 12]) if len(train) >= 12 else None
            actual = float(y[i + k - 1]) if i + k <= len(y) else None
            out.append((i, k, actual, yhat, None if actual is None or yhat is None else actual - yhat))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window, initial, full", [(None, 0, False), (20, 3, False), (None, 10, True), (6, 0, False)])
def test_cv_seasonal_naive_against_a_loop(spark, window, initial, full):
    errors = backtest.cv_seasonal_naive(indexed(spark, s=SEASONAL), 14, window, initial, full)
    assert rows(errors, "origin", "k", "y", "yhat", "error") == brute_snaive(SEASONAL, 14, window, initial, full)


def test_joined_folds_equal_a_user_function(spark):
    """Differential test: window version against the function run fold by fold in Python."""

    def snaive_function(y, h, x, x_future):
        if len(y) < 12:
            raise ValueError("too short")
        return [y[len(y) - 12 + k % 12] for k in range(h)]

    df = indexed(spark, s=SEASONAL, t=[float((i * 7) % 13) for i in range(30)])
    native = backtest.cv_seasonal_naive(df, 5, initial=3)
    custom = arima.custom_cv(df, snaive_function, 5, initial=3, block=7)
    for column in ("yhat", "error"):
        result = evaluate.compare(native, custom, ["series_id", "origin", "k"], column, 1e-9).first()
        assert result["n_left_only"] == result["n_right_only"] == result["n_different"] == 0 and result["n_rows"] > 0
    assert evaluate.all_missing(custom, "error", "series_id").count() == 0


def test_cv_trend_and_regression_against_numpy(spark):
    rng = np.random.default_rng(5)
    y, x = rng.normal(size=30), rng.normal(size=30)
    df = indexed(spark, x=list(x), s=list(y))
    for window in (None, 10):
        trend = {(r["origin"], r["k"]): r["yhat"] for r in backtest.cv_linear_trend(df, 2, window, 5).collect()}
        fit = {(r["origin"], r["k"]): r["yhat"] for r in backtest.cv_regression(df, 2, window, 5).collect()}
        for i in range((window or 1) + 5, 30):
            a = i - window if window else 0
            b1, b0 = np.polyfit(np.arange(a + 1, i + 1), y[a:i], 1)
            c1, c0 = np.polyfit(x[a:i], y[a:i], 1)
            assert trend[i, 2] == pytest.approx(b0 + b1 * (i + 2))
            assert fit[i, 1] == pytest.approx(c0 + c1 * x[i])
            assert i < 29 or fit[i, 2] is None


def test_metrics(spark):
    df = spark.createDataFrame(
        [(1, 1, 5.0, 3.0, 2.0), (2, 1, 1.0, 5.0, -4.0), (1, 2, None, 3.0, None), (2, 2, 4.0, None, None), (3, 2, 1.0, 0.0, 1.0)],
        "origin int, k int, y double, yhat double, error double")
    out = {r["k"]: r for r in backtest.metrics_by_horizon(df).collect()}
    assert (out[1]["n"], out[1]["mae"], out[1]["mse"], out[1]["rmse"]) == (2, 3.0, 10.0, pytest.approx(10 ** 0.5))
    assert (out[2]["n"], out[2]["n_failed"], out[2]["mae"]) == (1, 1, 1.0)
    assert rows(backtest.longest_horizon(df)) == [(1, 2), (2, 1), (3, 2)]
    wide = backtest.horizons_wide(backtest.metrics_by_horizon(df.withColumn("m", F.lit("x")), "m"), "m", [1, 2])
    assert wide.columns == ["m", "h1_mae", "h1_rmse", "h2_mae", "h2_rmse"] and wide.first()["h2_rmse"] == 1.0


def test_full_grid(spark):
    one = spark.range(1).select(F.lit("s").alias("series_id"))
    full = grid.arima_grid(one)
    assert full.count() == 7290 and full.select("config_id").distinct().count() == 7290
    assert full.filter("d > 1 and dr").count() == 0
    small = grid.arima_grid(one, {"p": (2,), "dr": (True,), "l": ("auto",), "w": (60,)}).collect()
    assert [r["config_id"] for r in small] == ["arima_dr_TRUE_w_60_l_auto_ps_0_ds_0_qs_0_p_2_d_0_q_0"]
    plan = explain_text(full, "simple")
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def ar_series(n=120, phi=0.6, seed=1):
    rng = np.random.default_rng(seed)
    y = np.zeros(n)
    for t in range(1, n):
        y[t] = phi * y[t - 1] + rng.normal()
    return y * 10 + 100


def test_ar1_is_least_squares_on_the_lag():
    y = ar_series()
    out = css.fit(y, None, np.array([60, len(y)]), 2, p=1)
    for row, n in enumerate((60, len(y))):
        b1, b0 = np.polyfit(y[:n - 1], y[1:n], 1)
        assert out["yhat"][row, 0] == pytest.approx(b0 + b1 * y[n - 1], rel=1e-5)
        assert out["psi"][row, 1] == pytest.approx(b1, abs=1e-4)


def test_regression_term_and_drift_and_differences():
    rng = np.random.default_rng(2)
    x = rng.normal(size=130)
    y = 10 + 3 * x[:120] + rng.normal(size=120) * 0.01
    out = css.fit(y, x, np.array([120]), 4)
    assert out["yhat"][0] == pytest.approx(10 + 3 * x[120:124], abs=0.05)
    line = 5.0 + 2.0 * np.arange(40) + rng.normal(size=40) * 1e-3
    future = 5.0 + 2.0 * np.arange(40, 43)
    for order in ({"dr": True}, {"d": 1, "dr": True}, {"d": 2}, {"ds": 1, "dr": True}):
        assert css.fit(line, None, np.array([40]), 3, **order)["yhat"][0] == pytest.approx(future, abs=0.5)
    # Without drift a seasonal difference repeats the last season: 12 months of slope 2 behind the line.
    assert css.fit(line, None, np.array([40]), 3, ds=1)["yhat"][0] == pytest.approx(future - 24, abs=0.5)


def test_moving_average_and_lambda():
    rng = np.random.default_rng(4)
    e = rng.normal(size=401)
    y = 50 + e[1:] + 0.5 * e[:-1]
    out = css.fit(y, None, np.array([400]), 3, q=1)
    assert out["psi"][0, 1] == pytest.approx(0.5, abs=0.1) and out["psi"][0, 2] == 0
    assert out["yhat"][0, 2] == pytest.approx(np.mean(y), abs=0.2)
    growth = np.exp(0.03 * np.arange(60)) * (2 + np.sin(np.arange(60) * np.pi / 6))
    for lam in ("0", "auto"):
        got = css.fit(growth, None, np.array([48]), 12, l=lam, ds=1, dr=True)["yhat"][0]
        assert got == pytest.approx(growth[48:], rel=0.1)


def test_intervals_are_transformed_back():
    growth = np.exp(0.03 * np.arange(60) + np.random.default_rng(1).normal(size=60) * 0.1)
    out = css.fit(growth, None, np.array([60]), 4, l="0", d=1, dr=True, quantiles=(-1.96, 1.96))
    low, high = out["bounds"][0]
    sd = np.sqrt(out["sigma2"][0] * np.arange(1, 5))
    assert np.log(high) - np.log(out["yhat"][0]) == pytest.approx(1.96 * sd)
    assert (low > 0).all() and (high - out["yhat"][0] > out["yhat"][0] - low).all()


def test_folds_are_windows_on_one_partitioning(spark):
    from seriesforge.operators.series import regular
    from helpers import series_frame

    errors = backtest.cv_seasonal_naive(regular(series_frame(spark, s=range(30))), 12, window=24)
    plan = explain_text(errors, "simple")
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Pandas" not in plan and "Python" not in plan
    metrics = explain_text(backtest.metrics_by_horizon(errors), "simple")
    assert metrics.count("Exchange") == 2 and "partial_avg" in metrics


def test_unfittable_folds_give_no_forecast_and_no_fold_sees_the_future():
    y = ar_series(40)
    out = css.fit(y, None, np.arange(1, 40), 3, p=2, ds=1)
    assert np.isnan(out["yhat"][:15]).all() and not np.isnan(out["yhat"][25:]).any()
    changed = y.copy()
    changed[30:] = 1e6
    again = css.fit(changed, None, np.arange(1, 31), 3, p=2, ds=1)
    first = css.fit(y, None, np.arange(1, 31), 3, p=2, ds=1)
    assert np.allclose(first["yhat"], again["yhat"], rtol=1e-3, equal_nan=True)
    gap = y.copy()
    gap[[0, 10]] = np.nan
    assert not np.isnan(css.fit(gap, None, np.array([40]), 2, p=1)["yhat"]).any()


@pytest.mark.parametrize("y", [[np.nan] * 30, [1.0], [5.0] * 30, [0.0] * 30, [np.nan] * 29 + [1.0]])
@pytest.mark.parametrize("order", [{"p": 1, "q": 1}, {"d": 1, "ds": 1, "qs": 1}, {"l": "auto", "dr": True}, {"l": "0"}])
def test_degenerate_series_never_fail(y, order):
    y = np.array(y)
    for x in (None, np.ones(len(y)), np.full(len(y), np.nan)):
        out = css.fit(y, x, np.arange(1, len(y) + 1), 3, quantiles=(1.0,), **order)
        assert out["yhat"].shape == (len(y), 3)
        if np.isnan(y).all() or len(y) == 1:
            assert np.isnan(out["yhat"]).all()
        if (y == 5).all() and x is None and "q" in order:
            assert out["yhat"][-1] == pytest.approx([5.0] * 3)


def test_arima_cv_blocks_do_not_matter(spark):
    df = indexed(spark, s=list(ar_series(60)), t=list(ar_series(40, seed=8)))
    ranges = {"p": (0, 1), "w": (None, 24)}
    whole = arima.arima_cv(arima.work_rows(df, ranges), 2, initial=10, full_horizon_only=True)
    blocks = arima.arima_cv(arima.work_rows(df, ranges), 2, initial=10, full_horizon_only=True, block=5)
    result = evaluate.compare(whole, blocks, ["series_id", "config_id", "origin", "k"], "yhat", 1e-2).first()
    assert result["n_left_only"] == result["n_right_only"] == result["n_different"] == 0
    expected = sum(2 * 2 * (n - 2 - ((w or 1) + 10) + 1) for n in (60, 40) for w in (None, 24))
    assert result["n_rows"] == expected
    mean_only = whole.filter("config_id = 'arima_dr_FALSE_w_24_l_NULL_ps_0_ds_0_qs_0_p_0_d_0_q_0' and series_id = 't' and k = 1").orderBy("origin").first()
    y = ar_series(40, seed=8)
    assert mean_only["yhat"] == pytest.approx(y[mean_only["origin"] - 24:mean_only["origin"]].mean())


def test_auto_choice_prefers_the_true_order(spark):
    walk = np.cumsum(np.random.default_rng(6).normal(size=150)) + 50
    df = indexed(spark, ar=list(ar_series(150, 0.8)), walk=list(walk))
    best = {r["series_id"]: r["config_id"] for r in arima.auto_arima(df, {"p": (0, 1), "d": (0, 1)}, 3).collect()}
    assert best["ar"].endswith("p_1_d_0_q_0") and best["walk"].endswith("_d_1_q_0")


def test_forecast_rows_and_residuals(spark):
    df = indexed(spark, s=list(ar_series(80)))
    fits = arima.arima_fit(arima.work_rows(df, {"p": (1,)}), 3)
    out = arima.forecast_rows(fits).orderBy("k").collect()
    assert [r["k"] for r in out] == [1, 2, 3] and out[0]["date"] == month(80) and out[0]["origin"] == 80
    assert out[0]["hi80"] - out[0]["lo80"] < out[1]["hi80"] - out[1]["lo80"] and out[0]["lo95"] < out[0]["lo80"] < out[0]["yhat"] < out[0]["hi80"]
    fitted = arima.fitted_rows(fits).filter("yhat is not null")
    assert fitted.agg(F.min("idx"), F.max("idx")).first()[:] == (2, 80)


def test_settings_that_no_series_can_meet(spark):
    df = indexed(spark, s=SEASONAL)
    for h, window, initial in ((0, None, 0), (2, 1, 0), (2, None, -1)):
        with pytest.raises(ValueError):
            backtest.folds(df, h, window, initial)
    with pytest.raises(ValueError):
        arima.grid_cv_metrics(df, {"p": (1,)}, 0)


def test_pack_puts_values_in_the_place_of_their_month(spark):
    df = indexed(spark, s=[1.0, 2.0, 3.0, 4.0, 5.0]).filter("idx <> 3")
    packed = arima.pack(df).first()
    assert packed["n"] == 5 and list(packed["y"]) == [1.0, 2.0, None, 4.0, 5.0]


def test_a_fold_does_not_depend_on_the_others():
    rng = np.random.default_rng(8)
    y = np.cumsum(rng.normal(size=70)) + 50
    params = {"p": 1, "q": 1, "ps": 1}
    together = fit(y, None, np.arange(30, 61), 3, **params)
    for i, o in enumerate(range(30, 61)):
        alone = fit(y, None, np.array([o]), 3, **params)
        assert alone["yhat"][0] == pytest.approx(together["yhat"][i], rel=1e-6)
        assert alone["converged"][0] == together["converged"][i]


def test_a_search_that_is_cut_short_says_so():
    y = np.cumsum(np.random.default_rng(9).normal(size=80))
    assert not fit(y, None, np.array([80]), 2, p=2, q=2, steps=1)["converged"].any()
    assert fit(y, None, np.array([80]), 2, p=1)["converged"].all()
    assert fit(y, None, np.array([80]), 2, dr=True)["converged"].all()  # solved directly


def test_moving_averages_reach_the_least_sum_of_squares():
    """The search against a fine grid over the two coefficients."""
    rng = np.random.default_rng(11)
    e = rng.normal(size=121)
    y = np.zeros(121)
    for t in range(1, 121):
        y[t] = 0.5 * y[t - 1] + e[t] + 0.4 * e[t - 1]
    y = y[1:]

    def loss(phi, theta, mean):
        z, shock, total = y - mean, 0.0, 0.0
        for t in range(1, len(z)):
            shock = z[t] - phi * z[t - 1] - theta * shock
            total += shock * shock
        return total

    found = fit(y, None, np.array([len(y)]), 1, p=1, q=1)
    sse = found["sigma2"][0] * (found["n_obs"][0] - 3)
    grid_least = min(loss(a, b, m) for a in np.linspace(-0.95, 0.95, 39) for b in np.linspace(-0.95, 0.95, 39) for m in (y.mean() - 0.1, y.mean(), y.mean() + 0.1))
    assert sse <= grid_least * 1.0001


@pytest.mark.parametrize("window", [None, 20])
def test_autoregression_is_the_models_special_case(spark, window):
    rng = np.random.default_rng(4)
    y = np.zeros(60)
    for t in range(1, 60):
        y[t] = 0.6 * y[t - 1] + rng.normal() + 2
    df = indexed(spark, s=y.tolist(), short=[1.0, 2.0])
    exact = {(r["origin"], r["k"]): r["yhat"] for r in autoregress.cv(df, 3, window, 25).filter("series_id = 's'").collect()}
    origins = np.array(sorted({o for o, _ in exact}))
    python = fit(y, None, origins, 3, w=window, p=1)["yhat"]
    for i, o in enumerate(origins):
        for k in range(1, 4):
            assert exact[o, k] == pytest.approx(python[i, k - 1], rel=1e-3)
    whole_fit = fit(y, None, np.array([60]), 12, p=1, quantiles=(-1.2815515655446004,))
    ahead = {(r["series_id"], r["k"]): r for r in autoregress.forecast(df, 12).collect()}
    assert len(ahead) == 24 and all(ahead["short", k]["lo80"] is None for k in range(1, 13))
    for k in range(1, 13):
        assert ahead["s", k]["yhat"] == pytest.approx(whole_fit["yhat"][0, k - 1], rel=1e-4)
        assert ahead["s", k]["lo80"] == pytest.approx(whole_fit["bounds"][0, 0, k - 1], rel=1e-3)
    assert {r["series_id"]: r["model"] for r in autoregress.order_choice(df).collect()} == {"s": "ar1", "short": None}


def test_the_grid_is_expanded_behind_the_shuffle(spark):
    df = indexed(spark, a=SEASONAL, b=[v + i % 5 for i, v in enumerate(SEASONAL)])
    ranges = {"p": (0, 1), "d": (0, 1), "dr": (False, True), "w": (None, 20)}
    got = arima.grid_cv_metrics(df, ranges, 2, initial=8, rows_per_task=3)
    plan = explain_text(got, "simple")
    top = plan.index("Generate explode(sequence(_slice")
    assert "hashpartitioning(series_id" in plan[top:] and "REPARTITION_BY_NUM" in plan[top:]
    assert "hashpartitioning(config_id" in plan[:top] and "hashpartitioning(series_id" not in plan[:top]
    slow = backtest.metrics_by_horizon(arima.arima_cv(arima.work_rows(df, ranges), 2, initial=8, full_horizon_only=True), "config_id")
    a, b = ({(r["config_id"], r["k"]): r for r in x.collect()} for x in (got, slow))
    assert set(a) == set(b) and len(a) == 32
    for key, r in a.items():
        assert (r["n"], r["n_failed"], r["n_unconverged"]) == (b[key]["n"], b[key]["n_failed"], b[key]["n_unconverged"])
        assert r["rmse"] == pytest.approx(b[key]["rmse"], rel=1e-6) and r["mae"] == pytest.approx(b[key]["mae"], rel=1e-6)


def test_every_series_keeps_a_fit(spark):
    df = indexed(spark, good=SEASONAL, short=[1.0, 2.0], empty=[None] * 30)
    fits = {r["series_id"]: r for r in arima.auto_arima(df, {"p": (0, 1), "d": (0, 1)}, 2).collect()}
    assert set(fits) == {"good", "short", "empty"}
    assert fits["good"]["aicc"] is not None and fits["empty"]["aicc"] is None and fits["empty"]["n_unscored"] == 4


def test_short_series_keep_a_row_in_the_portmanteau_test(spark):
    df = indexed(spark, good=SEASONAL, short=[1.0, 3.0, 2.0])
    test = {r["series_id"]: r for r in diagnose.ljung_box(df, 6, column="y").collect()}
    assert test["short"]["statistic"] is None and test["short"]["p_value"] is None and test["good"]["p_value"] is not None
    assert all(r["p_value"] is None for r in diagnose.ljung_box(df, 6, fitted=6, column="y").collect())


def test_several_regressors(spark):
    rng = np.random.default_rng(12)
    x, z = rng.normal(size=(2, 60))
    y = 3 + 2 * x - 5 * z
    df = indexed(spark, x=x.tolist(), s=y.tolist()).join(
        spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(z)], "idx int, z double"), "idx")
    for errors in (backtest.cv_two_regressors(df, 2, initial=10), arima.arima_cv(arima.work_rows(df, {}, ("x", "z")), 2, initial=10),
                   arima.custom_cv(df, lambda y, h, x, x_future: 3 + x_future @ [2.0, -5.0], 2, initial=10, regressors=("x", "z"))):
        got = [r for r in errors.collect() if r["y"] is not None]
        assert len(got) == 49 + 48 and all(r["yhat"] == pytest.approx(r["y"], abs=1e-6) for r in got)
    with pytest.raises(ValueError):
        arima.pack(df, ("x", "nothing"))
