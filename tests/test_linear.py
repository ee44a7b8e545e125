"""Linear models against numpy's least squares."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import indexed, month
from seriesforge.operators import linear, stepwise
from seriesforge.operators.linear import Model
from seriesforge.plans import study

RND = np.random.default_rng(4)
X, Z = RND.normal(50, 9, 90), RND.normal(0, 1, 90)


def simulated(n=90):
    y = [1000.0, 1010.0]
    for t in range(2, n):
        y.append(200 + 0.5 * y[-1] + 0.2 * y[-2] + (0.1 * y[t - 12] if t >= 12 else 100) + 2 * X[t] + RND.normal(0, 5))
    return y


SERIES = {"a": simulated(), "gap": [None if i in (30, 31, 60) else v for i, v in enumerate(simulated())], "short": simulated(9), "flat": [7.0] * 60}
MODELS = [
    Model(p=2, ps=1, regressors=("x", "z")), Model(p=1, d=1, dr=True), Model(p=3, dr=True), Model(ps=2, ds=1, regressors=("x",)), Model(d=1, ds=1, p=1),
    Model(), Model(d=1), Model(d=1, dr=True), Model(ds=1, dr=True, p=1),
]


def frame(spark):
    df = indexed(spark, x=list(X), **SERIES)
    return df.withColumn("z", F.get(F.array(*[F.lit(float(z)) for z in Z]), F.col("idx") - 1))


def differenced(v, model):
    v = np.array([np.nan if a is None else a for a in v], float)
    for step in [1] * model.d + [model.season] * model.ds:
        v = np.concatenate([np.full(step, np.nan), v[step:] - v[:-step]])[:len(v)]
    return v


def design(y, model):
    """Target and terms in the months' own units, NaN where unknown."""
    n = len(y)
    w = differenced(y, model)
    own = {"x": differenced(X[:n], model), "z": differenced(Z[:n], model)}
    columns = []
    for term in model.terms:
        if term == "constant":
            columns.append(np.ones(n))
        elif term == "trend":
            columns.append(np.arange(1, n + 1.0))
        elif term.startswith("lag"):
            lag = int(term[3:])
            columns.append(np.concatenate([np.full(min(lag, n), np.nan), w[:-lag]])[:n])
        else:
            columns.append(own[term])
    return w, np.array(columns).reshape(len(columns), n).T


def slow_fit(y, model, first=0, last=None):
    """Coefficients over the months from ``first`` to ``last`` whose terms all lie there."""
    last = len(y) if last is None else last
    w, z = design(y, model)
    ok = ~np.isnan(w) & ~np.isnan(z).any(axis=1)
    ok[:min(first + model.reach, len(y))] = False
    ok[last:] = False
    k = len(model.terms)
    if ok.sum() <= k or k and np.linalg.matrix_rank(z[ok] - z[ok].mean(0) * (np.ptp(z[ok], axis=0) > 0)) < k:
        return None, int(ok.sum()), np.nan
    c = np.linalg.lstsq(z[ok], w[ok], rcond=None)[0] if k else np.zeros(0)
    return c, int(ok.sum()), float(((w[ok] - z[ok] @ c) ** 2).sum())


def slow_ahead(y, model, c, origin, h):
    """Forecasts of the months after the first ``origin`` ones."""
    y = list(y[:origin])
    w, out = list(differenced(y, model)), []
    for k in range(h):
        t = origin + k
        if t >= len(X) and model.regressors:
            out.append(None)
            y.append(None)
            w.append(np.nan)
            continue
        value = 0.0
        for term, coefficient in zip(model.terms, c):
            if term == "constant":
                value += coefficient
            elif term == "trend":
                value += coefficient * (t + 1)
            elif term.startswith("lag"):
                value += coefficient * (w[t - int(term[3:])] if t >= int(term[3:]) else np.nan)
            else:
                value += coefficient * differenced({"x": X, "z": Z}[term], model)[t]
        w.append(value)
        weights = linear.difference_weights(model.d, model.ds, model.season)
        for shift, weight in weights.items():
            if shift:
                value -= weight * (y[t - shift] if t >= shift and y[t - shift] is not None else np.nan)
        value = None if np.isnan(value) else float(value)
        out.append(value)
        y.append(value)
    return out


@pytest.mark.parametrize("model", MODELS, ids=lambda m: m.label + "".join(m.regressors))
def test_fit(spark, model):
    got = {r.series_id: r for r in linear.fit(frame(spark), model).collect()}
    assert set(got) == set(SERIES)
    for name, y in SERIES.items():
        c, n, loss = slow_fit(y, model)
        assert got[name].n_obs == n
        if c is None:
            assert got[name].coefficients is None and got[name].aicc is None
            continue
        assert got[name].coefficients == pytest.approx(list(c), rel=1e-6, abs=1e-6)
        if n > len(c) and loss > 1e-3:
            assert got[name].sigma2 == pytest.approx(loss / (n - len(c)), rel=1e-6)


@pytest.mark.parametrize("model", MODELS, ids=lambda m: m.label + "".join(m.regressors))
def test_folds(spark, model):
    errors = linear.cv(frame(spark), model, 5, (None, 48), initial=24).collect()
    got = {(r.series_id, r.window, r.origin, r.k): r for r in errors}
    assert len(got) == len(errors)
    expected = {(s, w, o, k) for s, y in SERIES.items() for w in (None, 48) for o in range((w or 1) + 24, len(y)) for k in range(1, 6)}
    assert set(got) == expected
    seen = 0
    for name, window, origin in {k[:3] for k in expected if k[2] % 7 == 0}:
        y = SERIES[name]
        c, _, _ = slow_fit(y, model, 0 if window is None else origin - window, origin)
        ahead = [None] * 5 if c is None else slow_ahead(y, model, c, origin, 5)
        for k, value in enumerate(ahead, 1):
            r = got[name, window, origin, k]
            assert r.y == (y[origin + k - 1] if origin + k <= len(y) else None)
            assert (r.yhat is None) == (value is None)
            if value is not None:
                assert r.yhat == pytest.approx(value, rel=1e-6, abs=1e-5)
                seen += 1
    assert seen > 50


@pytest.mark.parametrize("model", MODELS[:6], ids=lambda m: m.label + "".join(m.regressors))
def test_forecast(spark, model):
    df = frame(spark).withColumn("y", F.when((F.col("series_id") != "a") | (F.col("idx") <= 80), F.col("y")))
    got = {(r.series_id, r.k): r for r in linear.forecast(df, model, 6).collect()}
    assert set(got) == {(s, k) for s in SERIES for k in range(1, 7)}
    c, n, loss = slow_fit(SERIES["a"][:80], model)
    for k, value in enumerate(slow_ahead(SERIES["a"], model, c, 80, 6), 1):
        r = got["a", k]
        assert (r.origin, r.date) == (80, month(80 + k - 1)) and r.yhat == pytest.approx(value, rel=1e-6)
        sd = (r.hi95 - r.yhat) / 1.959963984540054
        ar = np.zeros(40)
        ar[0] = 1
        for term, coefficient in zip(model.terms, c):
            if term.startswith("lag"):
                ar[int(term[3:])] -= coefficient
        full = np.convolve(ar, [linear.difference_weights(model.d, model.ds).get(i, 0) for i in range(30)])
        psi = [1.0]
        for j in range(1, k):
            psi.append(-sum(full[i] * psi[j - i] for i in range(1, j + 1)))
        assert sd == pytest.approx(np.sqrt(loss / (n - len(c)) * sum(p * p for p in psi)), rel=1e-6)


def test_known_coefficients(spark):
    rows = linear.coefficients(frame(spark), MODELS[0]).filter("series_id = 'a'").collect()
    assert [r.term for r in rows] == ["constant", "lag1", "lag2", "lag12", "x", "z"]
    assert dict((r.term, r.estimate) for r in rows)["x"] == pytest.approx(2, abs=0.3)


def test_no_python_and_one_shuffle(spark):
    for df, most in ((linear.fit(frame(spark), MODELS[0]), 1), (linear.cv(frame(spark), MODELS[0], 12, (None, 36, 48)), 1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == most


def test_impossible_settings(spark):
    with pytest.raises(ValueError):
        Model(d=1, ds=1, dr=True)
    with pytest.raises(ValueError):
        Model(p=-1)
    with pytest.raises(ValueError):
        linear.cv(frame(spark), Model(), 0)


def test_stepwise_against_exhaustive_walk(spark):
    """The search by hand: the same moves over all models' scores, fitted one by one on common months."""
    df = frame(spark)
    visited = stepwise.search(df, max_p=2, max_ps=1, regressors=("x",)).collect()
    scores = {}
    for name, y in SERIES.items():
        w, z = design(y, Model(p=2, ps=1, dr=True, regressors=("x",)))
        ok = ~np.isnan(w) & ~np.isnan(z).any(axis=1)
        for p, ps, dr in [(p, ps, dr) for p in range(3) for ps in range(2) for dr in (False, True)]:
            own = Model(p=p, ps=ps, dr=dr, regressors=("x",))
            zz, k, n = design(y, own)[1][ok], len(own.terms), int(ok.sum())
            if n > k and np.linalg.matrix_rank(zz - zz.mean(0) * (np.ptp(zz, axis=0) > 0)) == k:
                loss = max(((w[ok] - zz @ np.linalg.lstsq(zz, w[ok], rcond=None)[0]) ** 2).sum(), 1e-300)
                if n - k - 2 > 0:
                    scores[name, p, ps, dr] = n * np.log(loss / n) + 2 * (k + 1) + 2 * (k + 1) * (k + 2) / (n - k - 2)
    for name in ("a", "gap"):
        seen, fresh, best, rounds = {}, {(2, 1, False), (0, 0, False), (1, 0, False), (0, 1, False)}, None, 0
        while fresh:
            seen.update({m: rounds for m in fresh})
            top = min((scores[(name, *m)], *m) for m in seen)
            rounds += 1
            if best == top:
                break
            best, (_, p, ps, dr) = top, top
            fresh = {(p + a, ps + b, dr) for a, b in stepwise.MOVES if 0 <= p + a <= 2 and 0 <= ps + b <= 1} | {(p, ps, not dr)}
            fresh -= set(seen)
        own = {(r.p, r.ps, r.dr): r for r in visited if r.series_id == name}
        assert {m: r.round for m, r in own.items()} == seen
        assert all(r.aicc == pytest.approx(scores[(name, *m)], rel=1e-7) for m, r in own.items())
    chosen = {r.series_id: r for r in stepwise.choice(spark.createDataFrame(visited)).collect()}
    assert set(chosen) == set(SERIES) and chosen["short"].p is None and chosen["flat"].aicc is None


def test_forecasts_of_chosen_models(spark):
    df = frame(spark)
    chosen = spark.createDataFrame([("a", 2, 1, True), ("gap", 1, 0, False), ("short", None, None, None)], "series_id string, p int, ps int, dr boolean")
    got = stepwise.forecast(df, chosen, 4).collect()
    for name, model in (("a", Model(p=2, ps=1, dr=True)), ("gap", Model(p=1))):
        own = {r.k: r.yhat for r in linear.forecast(df, model, 4).filter(F.col("series_id") == name).collect()}
        assert {r.k: r.yhat for r in got if r.series_id == name} == own and {r.model for r in got if r.series_id == name} == {model.label}
    assert {r.series_id for r in got} == {"a", "gap"}


def test_study(spark):
    df = frame(spark).drop("z").filter("series_id = 'a'")
    table = {r.model: r for r in study.linear_accuracy(df, 12, {"Own": Model(p=2, ps=1, regressors=("x",))}, auto=True).collect()}
    assert set(table) == {f"{m} Test set" for m in ("Own", "Auto", "Auto Simple", "Seasonal Naive")} and all(r.n == 12 for r in table.values())
    y = SERIES["a"]
    c, _, _ = slow_fit(y[:78], Model(p=2, ps=1, regressors=("x",)))
    e = np.array(y[78:]) - np.array(slow_ahead(y, Model(p=2, ps=1, regressors=("x",)), c, 78, 12))
    assert table["Own Test set"].rmse == pytest.approx(np.sqrt((e * e).mean()))
    naive = np.array(y[78:]) - np.array(y[66:78])
    assert table["Seasonal Naive Test set"].rmse == pytest.approx(np.sqrt((naive * naive).mean())) and table["Own Test set"].rmse < table["Seasonal Naive Test set"].rmse
