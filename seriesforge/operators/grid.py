"""Parameter grids as rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parameter ranges of the full grid, in nesting order. ``w`` is the training window (None:
# expanding), ``l`` the Box-Cox lambda (None: no transform, auto: per series), ``dr`` the drift term.
ARIMA_RANGES: dict[str, Sequence] = {
    "w": (None, 60),
    "l": (None, "auto", "0"),
    "dr": (False, True),
    "ps": (0, 1, 2),
    "ds": (0, 1, 2),
    "qs": (0, 1, 2),
    "p": (0, 1, 2),
    "d": (0, 1, 2),
    "q": (0, 1, 2),
}
ARIMA_TYPES = {"w": "int", "l": "string", "dr": "boolean"}


def add_grid(df: DataFrame, ranges: Mapping[str, Sequence], types: Mapping[str, str] | None = None) -> DataFrame:
    """Each row once per combination of the ranges.

    The ranges are literals of the caller, so the combinations come from generators on each row: no
    join, and the input is not moved.
    """
    for name, values in ranges.items():
        kind = (types or {}).get(name, "int")
        options = F.array(*[F.lit(v).cast(kind) for v in values])
        df = df.withColumn(name, F.explode(options))
    return df


def grid_size(ranges: Mapping[str, Sequence]) -> int:
    return math.prod(len(values) for values in ranges.values())


def grid_slice(df: DataFrame, ranges: Mapping[str, Sequence], start: Column, step: int,
               types: Mapping[str, str] | None = None) -> DataFrame:
    """Each row with the combinations number ``start``, ``start + step``, ... of the ranges; in all slices the rows of ``add_grid``."""
    size = grid_size(ranges)
    df = df.withColumn("_at", F.explode(F.sequence(start, F.lit(size - 1), F.lit(step))))
    for name, values in ranges.items():
        size //= len(values)
        options = F.array(*[F.lit(v).cast((types or {}).get(name, "int")) for v in values])
        df = df.withColumn(name, F.get(options, F.pmod(F.floor(F.col("_at") / size), F.lit(len(values))).cast("int")))
    return df.drop("_at")


def arima_allowed() -> Column:
    """Drift is not combined with a second difference."""
    return ~((F.col("d") > 1) & F.col("dr"))


def arima_name() -> Column:
    """Readable name of a configuration, also its id. Its parts and their order."""
    parts: list[Column] = [F.lit("arima")]
    for name in ("dr", "w", "l", "ps", "ds", "qs", "p", "d", "q"):
        text = F.upper(F.col(name).cast("string")) if name == "dr" else F.col(name).cast("string")
        parts += [F.lit(name), F.coalesce(text, F.lit("NULL"))]
    return F.concat_ws("_", *parts)


def arima_grid(df: DataFrame, ranges: Mapping[str, Sequence] = ARIMA_RANGES) -> DataFrame:
    """The allowed ARIMA configurations for each row of ``df``, named by ``config_id``."""
    full = {**{name: values[:1] for name, values in ARIMA_RANGES.items()}, **ranges}
    return add_grid(df, full, ARIMA_TYPES).filter(arima_allowed()).withColumn("config_id", arima_name())
