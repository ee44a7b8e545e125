"""Every registered query against its SQL in DuckDB, on the smallest driver tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value.isoformat() if isinstance(value, datetime.date) else value


def table(columns, data):
    """Columns by name; rows ordered by what is not a float, then by the floats."""
    order = sorted(range(len(columns)), key=columns.__getitem__)
    lines = [tuple(plain(r[i]) for i in order) for r in data]
    key = lambda r: (repr([v for v in r if not isinstance(v, float)]), repr(r))
    return sorted(columns), sorted(lines, key=key)


def same(a, b):
    """Equal; floats to 1e-7 of their size, as a rounded half may fall either way."""
    if isinstance(a, float) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-7, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF_DIR)
    got = table(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got[1], f"{name} gave no row"
        return
    cursor = db.execute(sql)
    expected = table([c[0] for c in cursor.description], cursor.fetchall())
    assert got[0] == expected[0]
    assert len(got[1]) == len(expected[1])
    for a, b in zip(got[1], expected[1]):
        assert all(map(same, a, b)), (a, b)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"series_id", "date", "value"} <= set(df.columns)
