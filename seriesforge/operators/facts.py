"""Histories to observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.functions.clean import null_sentinels, period_to_date


def explode_history(raw: DataFrame, keep_empty: bool = False) -> DataFrame:
    """One row ``(series_id, date, value)`` per ``[period, value]`` pair; ``value`` stays text.

    A series with no history gives no row, or one row of NULLs with ``keep_empty``. The step is
    map-only: a record never leaves its task.
    """
    explode = F.explode_outer if keep_empty else F.explode
    pairs = raw.select("series_id", explode("data").alias("pair"))
    return null_sentinels(pairs.select(
        "series_id",
        period_to_date(F.get("pair", F.lit(0))).alias("date"),
        F.get("pair", F.lit(1)).alias("value"),
    ))
