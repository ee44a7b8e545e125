"""Autocorrelation, partial autocorrelation, portmanteau test, automatic Box-Cox lambda."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesforge.operators.series import SEASON, by_series, whole


def _correlations(df: DataFrame, lags: int, column: str) -> DataFrame:
    """``(series_id, n, r)`` with ``r`` the autocorrelations at lags 1 to ``lags`` as an array.

    All lags come from one window pass and one aggregate, both on the same partitioning by series.
    Products with a missing value are left out, and each sum is averaged over its pairs plus its lag.
    """
    centred = df.withColumn("_c", F.col(column) - F.avg(column).over(whole()))
    c, w = F.col("_c"), by_series()
    products = centred.select("series_id", "_c", *[(c * F.lag("_c", k).over(w)).alias(f"_p{k}")
                                                  for k in range(1, lags + 1)])
    sums = [F.count("_c").alias("n"), F.avg(c * c).alias("_v")]
    sums += [(F.sum(f"_p{k}") / (F.count(f"_p{k}") + k)).alias(f"_s{k}") for k in range(1, lags + 1)]
    totals = products.groupBy("series_id").agg(*sums)
    r = F.array(*[F.when(F.col("_v") > 0, F.col(f"_s{k}") / F.col("_v")) for k in range(1, lags + 1)])
    return totals.select("series_id", "n", r.alias("r"))


def acf(df: DataFrame, lags: int = 24, column: str = "y") -> DataFrame:
    rows = _correlations(df, lags, column).select("series_id", "n", F.posexplode("r").alias("lag", "acf"))
    return rows.withColumn("lag", F.col("lag") + 1)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _durbin_levinson(r: pd.Series) -> pd.Series:
    """Partial autocorrelations of each array of autocorrelations, all rows of a batch together."""
    if r.empty:
        return r
    r = np.array(r.tolist(), dtype=float)
    lags = r.shape[1]
    partial, phi = np.empty_like(r), np.zeros_like(r)
    with np.errstate(all="ignore"):
        for k in range(lags):
            past = phi[:, :k]
            top = r[:, k] - (past * r[:, :k][:, ::-1]).sum(axis=1)
            last = top / (1 - (past * r[:, :k]).sum(axis=1))
            phi[:, :k] = past - last[:, None] * past[:, ::-1]
            phi[:, k] = partial[:, k] = last
    return pd.Series([[v if math.isfinite(v) else None for v in row] for row in partial])


# Spark asks for the size of a generator's array in a filter of its own; this keeps it to one call a row.
_durbin_levinson = _durbin_levinson.asNondeterministic()


def pacf(df: DataFrame, lags: int = 24, column: str = "y") -> DataFrame:
    """Partial autocorrelations by the Durbin-Levinson recursion; a row per series goes to Python."""
    partial = _correlations(df, lags, column).withColumn("r", _durbin_levinson("r"))
    rows = partial.select("series_id", "n", F.posexplode("r").alias("lag", "pacf"))
    return rows.withColumn("lag", F.col("lag") + 1)


@F.pandas_udf(T.DoubleType())
def chi_square_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail probability of a chi-square value with whole degrees of freedom."""
    return pd.Series([_tail(a, b) for a, b in zip(x, df)], dtype=float)


def _tail(x: float, df: float) -> float:
    if not (math.isfinite(x) and math.isfinite(df)) or df < 1:
        return math.nan
    half, df = x / 2, int(df)
    if half <= 0:
        return 1.0
    # Q(a + 1, z) = Q(a, z) + z^a e^-z / Gamma(a + 1), started at a = 1 or a = 1/2.
    a, q = (1.0, math.exp(-half)) if df % 2 == 0 else (0.5, math.erfc(math.sqrt(half)))
    while a < df / 2:
        q += math.exp(a * math.log(half) - half - math.lgamma(a + 1))
        a += 1
    return min(q, 1.0)


def ljung_box(df: DataFrame, lags: int = 24, fitted: int = 0, column: str = "residual") -> DataFrame:
    """Portmanteau statistic of each residual series, its degrees of freedom and p-value.

    Every series has a row. Without more residuals than lags there is no statistic, and without degrees of freedom no p-value.
    """
    c = _correlations(df, lags, column)
    n = F.col("n")
    r = [F.get("r", F.lit(k)) for k in range(lags)]
    terms = [F.try_divide(r[k - 1] * r[k - 1], n - k) for k in range(1, lags + 1)]
    statistic = n * (n + 2) * sum(terms[1:], terms[0])
    out = c.select("series_id", "n", F.when(n > lags, statistic).alias("statistic"), F.lit(lags - fitted).alias("df"))
    tail = chi_square_tail("statistic", "df")
    return out.withColumn("p_value", F.when(F.isnan(tail), None).otherwise(tail))


# Range searched for an automatic Box-Cox lambda.
AUTO_LAMBDAS = tuple(round(-0.9 + 0.05 * i, 2) for i in range(59))


def auto_lambda(df: DataFrame, lambdas: tuple[float, ...] = AUTO_LAMBDAS, season: int = SEASON) -> DataFrame:
    """Per series the lambda that makes the spread of a season least dependent on its level.

    For each whole season, counted back from the end, spread / mean^(1 - lambda); the lambda with the
    smallest relative variation of that ratio wins (Guerrero 1993). A series that is not positive
    throughout, or has under two whole seasons, gets 1, which is no transform but a shift.
    """
    n = F.max("idx").over(whole())
    blocks = (
        df.withColumn("_block", F.floor((n - F.col("idx")) / season))
        .groupBy("series_id", "_block")
        .agg(F.avg("y").alias("_m"), F.stddev_samp("y").alias("_s"),
             (F.count("*") == season).alias("_whole"), F.min("y").alias("_low"))
    )
    level = F.when(F.col("_whole") & (F.col("_m") > 0), F.col("_m"))
    variation = []
    for lam in lambdas:
        ratio = F.col("_s") / F.pow(level, F.lit(1 - lam))
        cv = F.try_divide(F.stddev_samp(ratio), F.avg(ratio))
        variation.append(F.struct(cv.alias("cv"), F.lit(lam).alias("lambda")))
    per_series = blocks.groupBy("series_id").agg(
        F.array(*variation).alias("_v"), F.min("_low").alias("_low"), F.count_if("_whole").alias("_seasons"))
    best = F.array_min(F.filter("_v", lambda v: v["cv"].isNotNull()))["lambda"]
    usable = (F.col("_low") > 0) & (F.col("_seasons") >= 2)
    return per_series.select("series_id", F.coalesce(F.when(usable, best), F.lit(1.0)).alias("lambda"))
