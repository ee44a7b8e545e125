import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import indexed, month, rows, series_frame
from seriesforge.functions.boxcox import boxcox, inverse_boxcox
from seriesforge.operators import diagnose, series
from seriesforge.sources.sinks import explain_text
from workload.catalogs import SCHEMAS


def test_regular_fills_gaps_and_numbers_months(spark):
    df = spark.createDataFrame(
        [("a", month(0), 1.0), ("a", month(3), 4.0), ("a", month(4), 5.0), ("b", month(7), None), ("b", month(8), 2.0), ("b", None, 9.0)],
        "series_id string, date date, y double")
    assert rows(series.regular(df)) == sorted([
        ("a", 1, month(0), 1.0), ("a", 2, month(1), None), ("a", 3, month(2), None), ("a", 4, month(3), 4.0),
        ("a", 5, month(4), 5.0), ("b", 1, month(7), None), ("b", 2, month(8), 2.0)], key=repr)


def test_monthly_takes_means_and_one_shuffle_serves_all_windows(spark):
    df = spark.createDataFrame([("a", month(0), "1"), ("a", month(0), "3"), ("a", None, "9"), ("a", month(1), "x")],
                               "series_id string, date date, value string")
    assert rows(series.monthly(df)) == sorted([("a", month(0), 2.0), ("a", month(1), None)], key=repr)
    chained = series.regular(series.monthly(df).withColumnRenamed("value", "y"))
    chained = series.difference(series.rolling_mean(series.lagged(chained, "y"), "y_lag1", 13), "y", 1, 1)
    plan = explain_text(series.split_train_test(chained, 12), "simple")
    assert plan.count("Exchange") == 2  # (series, month) with partial sums, then by series


def test_lags_rolling_means_differences(spark):
    ys = [float(i * i) for i in range(20)]
    df = series.rolling_mean(series.lagged(indexed(spark, s=ys), "y"), "y_lag1", 13, "m")
    df = series.difference(df, "y", 1, 1, name="d")
    out = {r["idx"]: r for r in df.collect()}
    assert out[1]["y_lag1"] is None and out[2]["y_lag1"] == 0.0
    assert out[13]["m"] is None and out[14]["m"] == pytest.approx(sum(ys[:13]) / 13)
    assert out[13]["d"] is None and out[14]["d"] == (ys[13] - ys[12]) - (ys[1] - ys[0])
    assert series.difference_weights(2, 0) == {0: 1, 1: -2, 2: 1}
    assert series.difference_weights(1, 1) == {0: 1, 1: -1, 12: -1, 13: 1}


def test_split(spark):
    df = indexed(spark, s=range(60), t=range(13))
    plain = series.split_train_test(df, 48)
    assert rows(plain.groupBy("series_id", "part").count()) == [("s", "test", 48), ("s", "train", 12), ("t", "test", 13)]
    assert plain.filter("series_id = 's' and part = 'test'").agg(F.min("idx"), F.min("k"), F.max("k")).first()[:] == (13, 1, 48)
    overlap = series.split_train_test(df, 48, overlap=1).filter("series_id = 's'")
    assert rows(overlap.groupBy("part").count()) == [("test", 49), ("train", 12)]


def test_regressor_is_lagged_by_date(spark):
    df = indexed(spark, s=range(4))
    x = spark.createDataFrame([(month(i), 10.0 * i) for i in (0, 1, 2)], "date date, x double")
    assert rows(series.with_regressor(df, x), "idx", "x") == sorted([(1, None), (2, 0.0), (3, 10.0), (4, 20.0)], key=repr)


def _acf(y, lag):
    c = np.asarray(y) - np.mean(y)
    return float((c[lag:] * c[:-lag]).sum() / (c * c).sum())


def test_acf_pacf_and_portmanteau(spark):
    rng = random.Random(3)
    ys = [0.0]
    for _ in range(59):
        ys.append(0.6 * ys[-1] + rng.gauss(0, 1))
    df = indexed(spark, s=ys, flat=[5.0] * 40)
    acf = {(r["series_id"], r["lag"]): r["acf"] for r in diagnose.acf(df, 6).collect()}
    for lag in range(1, 7):
        assert acf["s", lag] == pytest.approx(_acf(ys, lag))
        assert acf["flat", lag] is None
    pacf = {(r["series_id"], r["lag"]): r["pacf"] for r in diagnose.pacf(df, 6).collect()}
    r1, r2 = _acf(ys, 1), _acf(ys, 2)
    assert pacf["s", 1] == pytest.approx(r1) and pacf["s", 2] == pytest.approx((r2 - r1 * r1) / (1 - r1 * r1))
    matrix = [[_acf(ys, abs(i - j)) if i != j else 1.0 for j in range(6)] for i in range(6)]
    assert pacf["s", 6] == pytest.approx(np.linalg.solve(matrix, [_acf(ys, k) for k in range(1, 7)])[-1])
    test = diagnose.ljung_box(df.filter("series_id = 's'"), 6, fitted=1, column="y").first()
    n = len(ys)
    assert test["statistic"] == pytest.approx(n * (n + 2) * sum(_acf(ys, k) ** 2 / (n - k) for k in range(1, 7)))
    assert test["df"] == 5 and 0 <= test["p_value"] < 0.05


@pytest.mark.parametrize("x, df, p", [(3.841458821, 1, 0.05), (5.991464547, 2, 0.05), (11.07049769, 5, 0.05), (36.41502850, 24, 0.05), (0.0, 3, 1.0)])
def test_chi_square_tail(x, df, p):
    assert diagnose._tail(x, df) == pytest.approx(p, abs=1e-8)


def test_boxcox(spark):
    df = spark.createDataFrame([(4.0, 0.5), (4.0, 0.0), (4.0, None), (0.0, 0.0), (-1.0, 0.5)], "y double, l double")
    z = boxcox(F.col("y"), F.col("l"))
    out = df.select(z.alias("z"), inverse_boxcox(z, F.col("l")).alias("back")).collect()
    assert [r["z"] for r in out] == [2.0, pytest.approx(math.log(4)), 4.0, None, None]
    assert [r["back"] for r in out][:3] == [pytest.approx(4.0)] * 3


def test_auto_lambda_finds_the_log_for_a_multiplicative_season(spark):
    growing = [math.exp(0.02 * i) * (2 + math.sin(2 * math.pi * i / 12)) for i in range(72)]
    additive = [100 + 0.1 * i + 10 * math.sin(2 * math.pi * i / 12) for i in range(72)]
    df = indexed(spark, growing=growing, additive=additive, short=[1.0] * 13, zero=[0.0] * 36, flat=[7.0] * 36)
    lam = dict(rows(diagnose.auto_lambda(df)))
    assert abs(lam["growing"]) <= 0.051 and lam["additive"] > 0.8
    assert lam["short"] == lam["zero"] == lam["flat"] == 1.0


def test_facts_survive_pack_and_explode(spark):
    from seriesforge.operators.facts import explode_history
    from workload.catalogs import pack_history

    df = series_frame(spark, a=[1, None, 3], b=[5])
    text = df.select("series_id", F.date_format("date", "yyyyMM").alias("period"), F.col("y").cast("string").alias("value"))
    back = explode_history(pack_history(text, "series_id")).withColumn("value", F.col("value").cast("double"))
    assert rows(back) == rows(df)


def test_series_are_dealt_over_tasks_by_the_facts(spark, tmp_path, monkeypatch):
    """What a task sorts doesn't grow with the table."""
    from workload.analysis import parts_regular

    lines = [(i, i % 9, 1, 1, 2.0, 10.0, 0.1, 0.0, "N", "O", datetime.datetime(2000, 1 + i % 5, 3)) for i in range(45)]
    spark.createDataFrame(lines, SCHEMAS["lineitem"]).write.parquet(str(tmp_path / "lineitem.parquet"))
    expected = rows(parts_regular(spark, str(tmp_path)))
    monkeypatch.setattr(series, "TASK_ROWS", 2)
    dealt = series.lagged(parts_regular(spark, str(tmp_path)), "y")
    assert dealt.rdd.getNumPartitions() == 23 and rows(dealt.drop("y_lag1")) == expected and len(expected) > 9
