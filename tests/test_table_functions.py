"""Cross-validation from SQL against the function for DataFrames."""

import numpy as np
import pytest

from helpers import indexed, rows
from seriesforge.operators import arima
from seriesforge.operators.table_functions import register_cross_validation


def forecaster():
    """Made inside a function, so that tasks get it by value."""

    def last_or_fail(y, h, x, x_future, shift=0):
        """The last value moved by a parameter; fails on short parts, and adds the regressor of the forecast months."""
        if len(y) < 6:
            raise RuntimeError("too short")
        future = np.zeros(h) if x_future is None else np.concatenate([x_future, np.full(h - len(x_future), np.nan)])
        return y[-1] + shift + future

    return last_or_fail


@pytest.mark.parametrize("with_x", [False, True])
@pytest.mark.parametrize("window", [None, 8])
def test_equal_to_the_dataframe_function(spark, window, with_x):
    y = [float(i * i % 17) for i in range(20)]
    df = indexed(spark, x=[float(i % 5) for i in range(20)] if with_x else None, a=y, gap=[None if i in (9, 14) else v for i, v in enumerate(y)], short=y[:3])
    register_cross_validation(spark, "cross_validate", forecaster(), shift=2)
    df.repartition(5).createOrReplaceTempView("months")
    got = spark.sql(f"""SELECT * FROM cross_validate(TABLE(SELECT * FROM months) PARTITION BY series_id ORDER BY idx, h => 3, initial => 2,
                        window => {'NULL' if window is None else window})""")
    expected = arima.custom_cv(df, forecaster(), 3, {"shift": (2,)}, window=window, initial=2, regressors=("x",) if with_x else ())
    names = ("series_id", "origin", "k", "y", "yhat", "error")
    assert rows(got, *names) == rows(expected, *names) and got.filter("error IS NOT NULL").count() > 20
    assert got.filter("series_id = 'short'").count() == 0
