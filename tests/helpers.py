import datetime
import math


def rows(df, *columns):
    """Rows as sorted tuples, NaN as None."""
    df = df.select(*columns) if columns else df
    clean = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in df.collect()]
    return sorted(clean, key=repr)


def month(i, first_year=2000):
    """First day of month ``i`` (from 0) after January of ``first_year``."""
    return datetime.date(first_year + i // 12, i % 12 + 1, 1)


def series_frame(spark, **named):
    """Long frame (series_id, date, y) from lists of monthly values; None stays a NULL value."""
    data = [(name, month(i), None if v is None else float(v)) for name, ys in named.items() for i, v in enumerate(ys)]
    return spark.createDataFrame(data, "series_id string, date date, y double")


def indexed(spark, x=None, **named):
    """Regular frame (series_id, idx, date, y[, x])."""
    data = []
    for name, ys in named.items():
        for i, v in enumerate(ys):
            row = (name, i + 1, month(i), None if v is None else float(v))
            data.append(row + ((None if x[i] is None else float(x[i]),) if x is not None else ()))
    extra = ", x double" if x is not None else ""
    return spark.createDataFrame(data, f"series_id string, idx int, date date, y double{extra}")
