import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import indexed, rows
from seriesforge.operators import evaluate
from seriesforge.operators.series import split_train_test
from seriesforge.plans import study

Y = [100 + 10 * np.sin(i * np.pi / 6) + i + (i * 37 % 11) for i in range(60)]


def measures(y, f, train, previous_only_test):
    y, f = np.asarray(y, float), np.asarray(f, float)
    e = y - f
    scale = np.mean(np.abs(np.asarray(train[12:]) - np.asarray(train[:-12])))
    c = e - e.mean()
    out = {"me": e.mean(), "rmse": np.sqrt((e * e).mean()), "mae": np.abs(e).mean(), "mpe": (100 * e / y).mean(),
           "mape": np.abs(100 * e / y).mean(), "mase": np.abs(e).mean() / scale, "acf1": (c[1:] * c[:-1]).sum() / (c * c).sum()}
    fpe, ape = f[1:] / y[:-1] - 1, y[1:] / y[:-1] - 1
    out["theils_u"] = np.sqrt(((fpe - ape) ** 2).sum() / (ape ** 2).sum()) if previous_only_test else None
    return out


def test_accuracy_against_numpy(spark):
    split = split_train_test(indexed(spark, s=Y), 12)
    table = evaluate.accuracy(study.seasonal_naive_rows(split, 12), "model", "series_id", "part")
    out = {r["model"]: r for r in table.collect()}
    train = Y[:48]
    expected = {
        "Seasonal Naive Training set": measures(train[12:], train[:-12], train, False),
        "Seasonal Naive Test set": measures(Y[48:], Y[36:48], train, True),
    }
    for model, values in expected.items():
        for name, value in values.items():
            assert out[model][name] == (pytest.approx(value) if value is not None else None), (model, name)


def test_accuracy_leaves_out_zeros_and_needs_the_series(spark):
    df = spark.createDataFrame([("m", "s", "test", 1, 0.0, 1.0, 1.0), ("m", "s", "test", 2, 2.0, 1.0, 1.0), ("m", "s", "test", 3, None, 1.0, 1.0)],
                               "model string, series_id string, part string, idx int, y double, yhat double, scale double")
    row = evaluate.accuracy(df, "model", "series_id", "part").first()
    assert (row["n"], row["mape"], row["mae"]) == (2, 50.0, 1.0)
    with pytest.raises(ValueError):
        evaluate.accuracy(df, "model")


def test_leaderboard(spark):
    df = spark.createDataFrame([("A Test set", 2.0), ("B Training set", 1.0), ("C test set", None), ("D Test set", 1.5)], "model string, rmse double")
    best = evaluate.leaderboard(df, "rmse", "model", top=2, models="test")
    assert [r["model"] for r in best.collect()] == ["D Test set", "A Test set"]
    assert evaluate.leaderboard(df, "rmse", "model").count() == 4
    stacked = evaluate.stack([df, df.withColumn("extra", F.lit(1))])
    assert stacked.count() == 8 and stacked.filter("extra is null").count() == 4


def test_compare(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (4, 4.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.05), (2, 3.0), (3, 3.0), (5, 5.0)], "k int, v double")
    row = evaluate.compare(a, b, ["k"], "v", 0.1).first()
    assert row.asDict() == {"n_rows": 5, "n_left_only": 1, "n_right_only": 1, "n_different": 2, "max_gap": 1.0}
    assert evaluate.compare(a, a, ["k"], "v", 0).first()["n_different"] == 0
    groups = spark.createDataFrame([("x", None), ("x", None), ("y", 1.0)], "g string, v double")
    assert rows(evaluate.all_missing(groups, "v", "g")) == [("x", 2)]


def test_study_ranks_every_model_on_the_held_out_months(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=72)
    good = [50 + 5 * x[i] + 10 * np.sin(i * np.pi / 6) + 0.2 * i + rng.normal() * 0.1 for i in range(72)]
    df = study.export_series(indexed(spark, x=list(x), s=good), str(tmp_path / "series"))
    models = {"Hyper": {"p": (1,), "ds": (1,), "dr": (True,)}}
    table = study.model_accuracy(df, 12, {"p": (0, 1), "ds": (1,), "dr": (False, True)}, models)
    assert table.count() == 8
    board = study.leaderboard_of_tests(table).collect()
    assert {r["model"] for r in board} == {"Hyper Test set", "Auto Test set", "Auto Simple Test set", "Seasonal Naive Test set"}
    assert board[0]["model"] in ("Hyper Test set", "Auto Test set") and board[0]["rmse"] < 1
    assert [r["rmse"] for r in board] == sorted(r["rmse"] for r in board)
    top = study.leaderboard_of_tests(table, top=1)
    assert top.count() == 1
