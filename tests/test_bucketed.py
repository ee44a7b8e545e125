"""Stored series: later windows and joins don't shuffle."""

import uuid

import pytest

from helpers import indexed, rows
from seriesforge.operators import backtest, linear
from seriesforge.sources import bucketed


@pytest.fixture
def stored(spark, tmp_path):
    df = indexed(spark, **{f"s{i}": [float((i + 3) * t % 11) for t in range(40)] for i in range(12)})
    name = f"series_{uuid.uuid4().hex}"
    yield df, bucketed.store(df, name, buckets=4, path=str(tmp_path / name)), name
    spark.sql(f"DROP TABLE {name}")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_no_exchange_over_stored_series(spark, stored):
    df, table, name = stored
    assert bucketed.buckets_of(spark, name) == 4
    for run in (lambda d: backtest.cv_seasonal_naive(d, 12, initial=13), lambda d: linear.cv(d, linear.Model(p=1), 3, (None, 24)),
                lambda d: backtest.with_length(d).groupBy("series_id").count()):
        assert exchanges(run(df)) == 1 and exchanges(run(table)) == 0
        assert rows(run(df)) == rows(run(table))


def test_joins_of_stored_tables(spark, stored, tmp_path):
    df, table, _ = stored
    other = f"dim_{uuid.uuid4().hex}"
    dim = bucketed.store(df.select("series_id").distinct(), other, order=(), buckets=4, path=str(tmp_path / other))
    joined = table.hint("merge").join(dim, "series_id")
    assert exchanges(joined) == 0 and joined.count() == df.count()
    spark.sql(f"DROP TABLE {other}")


def test_bucket_count():
    assert [bucketed.bucket_count(n, 10) for n in (0, 10, 11, 40, 41)] == [1, 1, 2, 4, 8]
