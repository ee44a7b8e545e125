"""Linear models of monthly series: autoregression of any order, plain and seasonal, differences, drift, any number of regressors.

The model is least squares of a (differenced) month on a constant, its earlier months and the regressors of the same month, which is what
conditional least squares gives without MA terms. All it needs of the data are the sums of products of its terms. So

* a fit of every series is one aggregate, and the equations are solved by array functions: no row goes to Python;
* cross-validation takes running sums over each series; a fold's sums are the difference of two of them, so expanding and sliding
  windows of any number of lengths cost one pass, and no fold is copied before its equations are solved;
* models within one another share their sums, so a search over orders (``stepwise``) never reads the series again.

Months are scaled by the series' mean and deviation first (only by the deviation where the model has no constant). That changes no
forecast, and keeps differences of running sums exact enough.

Input is a regular series ``(series_id, idx, date, y, regressors)``. A month that lacks its own value, an earlier one or a regressor takes no
part. A fold's earlier months lie inside its training part too. A fit with fewer months than terms, or with
terms that determine each other, has null coefficients and forecasts; no series disappears.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesforge.operators.backtest import check_settings, is_origin, with_length
from seriesforge.operators.forecast import with_intervals
from seriesforge.operators.series import SEASON, by_series, difference_weights, trailing, whole

SINGULAR = 1e-9  # least pivot, as a share of the number of months


@dataclass(frozen=True)
class Model:
    """Orders as in an ARIMA grid without MA terms; ``dr`` is a trend, which is the constant of a differenced model."""

    p: int = 0
    d: int = 0
    ps: int = 0
    ds: int = 0
    dr: bool = False
    regressors: tuple[str, ...] = ()
    season: int = SEASON

    def __post_init__(self):
        if min(self.p, self.d, self.ps, self.ds) < 0:
            raise ValueError("orders can't be negative")
        if self.dr and self.d + self.ds > 1:
            raise ValueError("a trend needs one difference at most")

    @property
    def lags(self) -> list[int]:
        return sorted({*range(1, self.p + 1), *(self.season * j for j in range(1, self.ps + 1))})

    @property
    def constant(self) -> bool:
        return self.d + self.ds == 0 or self.dr

    @property
    def trend(self) -> bool:
        return self.dr and self.d + self.ds == 0

    @property
    def terms(self) -> list[str]:
        return [*["constant"] * self.constant, *["trend"] * self.trend, *[f"lag{lag}" for lag in self.lags], *self.regressors]

    @property
    def reach(self) -> int:
        """Months before a target month that its terms need."""
        return max(self.lags, default=0) + self.d + self.season * self.ds

    @property
    def label(self) -> str:
        return f"ar_p_{self.p}_d_{self.d}_ps_{self.ps}_ds_{self.ds}_dr_{str(self.dr).upper()}"


def _differenced(column: str, model: Model) -> Column:
    w, total = by_series(), None
    for shift, weight in difference_weights(model.d, model.ds, model.season).items():
        part = weight * (F.lag(column, shift).over(w) if shift else F.col(column).cast("double"))
        total = part if total is None else total + part
    return total


def prepared(df: DataFrame, model: Model) -> DataFrame:
    """Adds ``_v`` (the scaled target), ``_x`` (scaled regressors), ``_z`` (all terms; null unless all are known) and scales ``_m``, ``_s``."""
    names = ["y", *model.regressors, *["idx"] * model.trend]
    rows = df.withColumns({f"_raw{i}": F.col(c).cast("double") if c == "idx" else _differenced(c, model) for i, c in enumerate(names)})
    mean = [F.avg(f"_raw{i}").over(whole()) if model.constant else F.lit(0.0) for i in range(len(names))]
    spread = [F.stddev_pop(f"_raw{i}").over(whole()) if model.constant else F.sqrt(F.avg(F.col(f"_raw{i}") ** 2).over(whole()))
              for i in range(len(names))]
    rows = rows.withColumns({"_m": F.array(*mean), "_s": F.array(*[F.when(s > 0, s).otherwise(1.0) for s in spread])})
    scaled = [(F.col(f"_raw{i}") - F.get("_m", F.lit(i))) / F.get("_s", F.lit(i)) for i in range(len(names))]
    rows = rows.withColumns({"_v": scaled[0], "_x": F.array(*scaled[1:1 + len(model.regressors)]).cast("array<double>")})
    terms = [*[F.lit(1.0)] * model.constant, *scaled[1 + len(model.regressors):], *[F.lag("_v", lag).over(by_series()) for lag in model.lags],
             *[F.get("_x", F.lit(i)) for i in range(len(model.regressors))]]
    z = F.array(*terms).cast("array<double>")
    rows = rows.withColumn("_z", z)
    complete = F.col("_v").isNotNull() & ~F.exists("_z", lambda x: x.isNull())
    return rows.withColumn("_z", F.when(complete, F.col("_z"))).drop(*[f"_raw{i}" for i in range(len(names))])


def _products(size: int) -> list[Column]:
    """Products of all pairs of the terms and, last, the target; nulls where a month takes no part."""
    parts = [*[F.get("_z", F.lit(i)) for i in range(size)], F.when(F.col("_z").isNotNull(), F.col("_v"))]
    return [a * b for a, b in combinations_with_replacement(parts, 2)]


def _places(size: int) -> dict[tuple[int, int], int]:
    pairs = combinations_with_replacement(range(size + 1), 2)
    return {both: at for at, (i, j) in enumerate(pairs) for both in ((i, j), (j, i))}


def equations(sums: Column, size: int) -> Column:
    """The normal equations (rows of an array, the right side last) from flat sums of products."""
    at = _places(size)
    return F.array(*[F.array(*[F.get(sums, F.lit(at[i, j])) for j in range(size + 1)]) for i in range(size)])


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def solved(matrix: Column, n: Column) -> Column:
    """Solution of symmetric equations by elimination; null where a pivot is too small for ``n`` months, or there are no more months than terms."""

    def step(m: Column, i: Column) -> Column:
        pivot = F.get(F.get(m, i), i)
        lead = F.transform(F.get(m, i), lambda x: x / F.when(pivot > SINGULAR * n, pivot))
        return _bound(lead, lambda row_i: F.transform(m, lambda row, r: F.when(r == i, row_i).otherwise(
            _bound(F.get(row, i), lambda factor: F.zip_with(row, row_i, lambda a, b: a - factor * b)))))

    size = F.size(matrix)
    done = F.aggregate(F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>")), matrix, step)
    values = F.transform(done, lambda row: F.get(row, F.size(row) - 1))
    return F.when((n > size) & ~F.exists(values, lambda x: x.isNull()), values)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def _coefficients(sums: Column, n: Column, size: int) -> Column:
    return solved(equations(sums, size), n) if size else F.when(n > 0, F.array().cast("array<double>"))


def _loss(sums: Column, coefficients: Column, size: int) -> Column:
    """Sum of squared residuals, not under rounding."""
    at = _places(size)
    own = F.get(sums, F.lit(at[size, size]))
    right = F.array(*[F.get(sums, F.lit(at[i, size])) for i in range(size)]).cast("array<double>")
    return F.greatest(own - _dot(coefficients, right), 1e-12 * own)


def aicc(loss: Column, n: Column, terms: Column | int) -> Column:
    """Corrected information criterion; the variance counts as a parameter."""
    k = terms + 1
    k = k if isinstance(k, Column) else F.lit(k)
    return F.when((n - k - 1 > 0) & (loss > 0), n * F.ln(loss / n) + 2 * k + F.try_divide(2.0 * k * (k + 1), n - k - 1))


def moments(df: DataFrame, model: Model) -> DataFrame:
    """One row per series: number of months ``n``, flat sums of products ``sums``, scales ``_m`` and ``_s``."""
    size = len(model.terms)
    return prepared(df, model).groupBy("series_id").agg(
        F.count("_z").alias("n"), F.array(*[F.coalesce(F.sum(p), F.lit(0.0)) for p in _products(size)]).alias("sums"),
        F.any_value("_m").alias("_m"), F.any_value("_s").alias("_s"))


def _unscaled(model: Model) -> list[Column]:
    """Coefficients in the series' own units from the scaled ones in ``_c``."""
    names = ["y", *model.regressors, *["idx"] * model.trend]
    at = {name: i for i, name in enumerate(names)}
    m, s = (lambda i: F.get("_m", F.lit(i))), (lambda i: F.get("_s", F.lit(i)))
    out, constant = {}, m(0) * 1.0
    for i, term in enumerate(model.terms):
        c = F.get("_c", F.lit(i))
        if term == "constant":
            constant = constant + s(0) * c
        else:
            of = at["idx"] if term == "trend" else at.get(term, 0)
            out[term] = c * s(0) / s(of)
            constant = constant - out[term] * m(of)
    return [constant if term == "constant" else out[term] for term in model.terms]


def fit(df: DataFrame, model: Model) -> DataFrame:
    """(series_id, n_obs, sigma2, aicc, coefficients): one row per series, coefficients in the order of ``model.terms``."""
    size = len(model.terms)
    rows = moments(df, model).withColumn("_c", _coefficients(F.col("sums"), F.col("n"), size))
    rows = rows.withColumn("_loss", F.when(F.col("_c").isNotNull(), _loss(F.col("sums"), F.col("_c"), size) * F.get("_s", F.lit(0)) ** 2))
    values = F.when(F.col("_c").isNotNull(), F.array(*_unscaled(model)).cast("array<double>"))
    return rows.select("series_id", F.col("n").alias("n_obs"), F.try_divide(F.col("_loss"), F.col("n") - size).alias("sigma2"),
                       aicc(F.col("_loss"), F.col("n"), size).alias("aicc"), values.alias("coefficients"))


def coefficients(df: DataFrame, model: Model) -> DataFrame:
    """(series_id, term, estimate, n_obs, sigma2, aicc): a row for each term."""
    names = F.array(*[F.lit(t) for t in model.terms])
    pairs = F.arrays_zip(names.alias("term"), F.coalesce("coefficients", F.array_repeat(F.lit(None).cast("double"), len(model.terms))).alias("estimate"))
    return fit(df, model).withColumn("_t", F.explode(pairs)).select(
        "series_id", F.col("_t.term").alias("term"), F.col("_t.estimate").alias("estimate"), "n_obs", "sigma2", "aicc")


def _with_surroundings(rows: DataFrame, model: Model, h: int) -> DataFrame:
    """Adds the values a forecast from each row starts from, and the regressors and values of the ``h`` months after it."""
    back = by_series().rowsBetween(-max(model.reach, 1), 0)
    on = by_series().rowsBetween(1, h)
    return rows.withColumns({
        "_past": F.collect_list(F.struct("_v", "y")).over(back),
        "_next": F.collect_list(F.struct("_x", "y")).over(on)})


def _ahead(model: Model, h: int) -> Column:
    """Forecasts of the ``h`` months after a row, from scaled coefficients ``_c`` and the row's surroundings."""
    constant, trend, lags = int(model.constant), int(model.trend), model.lags
    c = lambda i: F.get("_c", F.lit(i))
    weights = {shift: w for shift, w in difference_weights(model.d, model.ds, model.season).items() if shift}
    numbers = "array<double>"

    def one(acc: Column, k: Column) -> Column:
        value = c(0) if constant else F.lit(0.0)
        if trend:
            at = 1 + len(model.regressors)
            value = value + c(1) * (F.col("idx") + k - F.get("_m", F.lit(at))) / F.get("_s", F.lit(at))
        for i, lag in enumerate(lags):
            value = value + c(constant + trend + i) * F.try_element_at(acc["v"], F.lit(-lag))
        for i in range(len(model.regressors)):
            value = value + c(constant + trend + len(lags) + i) * F.get(F.get(F.col("_next"), k - 1)["_x"], F.lit(i))

        def whole_value(v: Column) -> Column:
            y = F.get("_m", F.lit(0)) + F.get("_s", F.lit(0)) * v
            for shift, w in weights.items():
                y = y - w * F.try_element_at(acc["y"], F.lit(-shift))
            return F.struct(F.array_append(acc["v"], v).cast(numbers).alias("v"), F.array_append(acc["y"], y).cast(numbers).alias("y"))

        return _bound(value, whole_value)

    past = F.col("_past")
    start = F.struct(F.transform(past, lambda r: r["_v"]).cast(numbers).alias("v"), F.transform(past, lambda r: r["y"].cast("double")).cast(numbers).alias("y"))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(h)), start, one, lambda acc: F.slice(acc["y"], -h, h))
    return F.when(F.col("_c").isNotNull(), path).otherwise(F.array_repeat(F.lit(None).cast("double"), h))


def _spread(model: Model, h: int) -> Column:
    """Factors by which the standard deviation grows over ``h`` months: roots of the running sums of squared psi weights."""
    first = int(model.constant) + int(model.trend)
    of = {lag: F.get("_c", F.lit(first + i)) for i, lag in enumerate(model.lags)}
    total: dict[int, Column] = {}
    for shift, w in difference_weights(model.d, model.ds, model.season).items():
        if shift:
            total[shift] = total.get(shift, F.lit(0.0)) - w
        for lag, c in of.items():
            total[shift + lag] = total.get(shift + lag, F.lit(0.0)) + w * c

    def one(acc: Column, k: Column) -> Column:
        weight = F.lit(0.0)
        for lag, c in total.items():
            weight = weight + c * F.coalesce(F.try_element_at(acc, F.lit(-lag)), F.lit(0.0))
        return F.array_append(acc, weight).cast("array<double>")

    psi = F.aggregate(F.slice(F.sequence(F.lit(1), F.lit(h)), 1, h - 1), F.array(F.lit(1.0)).cast("array<double>"), one)
    return F.transform(F.sequence(F.lit(1), F.lit(h)), lambda k: F.sqrt(_dot(F.slice(psi, F.lit(1), k), F.slice(psi, F.lit(1), k))))


def forecast(df: DataFrame, model: Model, h: int) -> DataFrame:
    """``h`` months after the last known value of each series, with 80 and 95% intervals.

    Rows of later months, with regressors and without a value, say what the regressors will be. Dates go on from the last known value.
    """
    check_settings(h)
    size = len(model.terms)
    origin = F.max(F.when(F.col("y").isNotNull(), F.col("idx"))).over(whole())
    known = df.withColumn("_origin", F.coalesce(origin, F.max("idx").over(whole())))
    rows = _with_surroundings(prepared(known, model), model, h)
    sums = F.array(*[F.coalesce(F.sum(p).over(whole()), F.lit(0.0)) for p in _products(size)])
    rows = rows.withColumns({"_sums": sums, "_n": F.count("_z").over(whole())}).filter("idx = _origin")
    rows = rows.withColumn("_c", _coefficients(F.col("_sums"), F.col("_n"), size))
    loss = _loss(F.col("_sums"), F.col("_c"), size)
    rows = rows.withColumn("_sd", F.get("_s", F.lit(0)) * F.sqrt(F.try_divide(loss, F.col("_n") - size)))
    both = F.arrays_zip(_ahead(model, h).alias("yhat"), _spread(model, h).alias("factor"))
    rows = rows.select("series_id", F.col("idx").alias("origin"), F.col("date").alias("_end"), "_sd", F.posexplode(both).alias("_k", "_f"))
    rows = rows.select("series_id", "origin", (F.col("_k") + 1).alias("k"), F.add_months("_end", F.col("_k") + 1).alias("date"),
                       F.col("_f.yhat").alias("yhat"), (F.col("_sd") * F.col("_f.factor")).alias("_sd"))
    return with_intervals(rows, F.col("_sd")).drop("_sd")


def cv(df: DataFrame, model: Model, h: int, windows: Sequence[int | None] = (None,), initial: int = 0, full_horizon_only: bool = False) -> DataFrame:
    """(series_id, window, origin, k, y, yhat, error) of every fold of every window length; ``window`` is null for expanding folds."""
    for window in windows:
        check_settings(h, window, initial)
    size, names = len(model.terms), []
    rows = with_length(_with_surroundings(prepared(df, model), model, h))
    running = [F.count("_z").over(trailing()).cast("double"), *[F.coalesce(F.sum(p).over(trailing()), F.lit(0.0)) for p in _products(size)]]
    rows = rows.withColumn("_run", F.array(*running))
    parts = []
    for i, window in enumerate(windows):
        before = None if window is None else F.lag("_run", max(window - model.reach, 0)).over(by_series())
        if before is not None:
            rows = rows.withColumn(f"_before{i}", before)
            names.append(f"_before{i}")
        own = F.col("_run") if window is None else F.zip_with(
            "_run", F.coalesce(f"_before{i}", F.array_repeat(F.lit(0.0), F.size("_run"))), lambda a, b: a - b)
        fold = F.struct(F.lit(window).cast("int").alias("window"), own.alias("sums"))
        parts.append(F.when(is_origin(window, initial, h if full_horizon_only else None), fold))
    folds = rows.withColumn("_fold", F.explode(F.array_compact(F.array(*parts)))).drop("_run", *names)
    folds = folds.withColumns({"window": F.col("_fold.window"), "_n": F.get("_fold.sums", F.lit(0)),
                               "_sums": F.slice("_fold.sums", F.lit(2), F.size("_fold.sums"))}).drop("_fold")
    folds = folds.withColumn("_c", _coefficients(F.col("_sums"), F.col("_n"), size))
    ahead = folds.select("series_id", "window", F.col("idx").alias("origin"), "_next", F.posexplode(_ahead(model, h)).alias("_k", "yhat"))
    value = F.get("_next", F.col("_k"))["y"]
    return ahead.select("series_id", "window", "origin", (F.col("_k") + 1).alias("k"), value.alias("y"), "yhat", (value - F.col("yhat")).alias("error"))
