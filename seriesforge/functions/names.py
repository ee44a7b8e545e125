"""Reading attributes out of series names and series ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separator of the parts of a name, and the patterns for ids and labels.
NAME_SEPARATOR = ":"
PLANT_ID_PATTERN = r".*\.(\d+)-.*"
LABEL_PATTERN = r"^[^,]+"


def name_part(name: Column | str, position: int) -> Column:
    """Trimmed part ``position`` (from 0) of a separated name, NULL when the name is too short."""
    return F.trim(F.get(F.split(name, NAME_SEPARATOR), F.lit(position)))


def plant_number(series_id: Column | str) -> Column:
    """Digits between the last matching dot and dash of an id, ``""`` when the id has none."""
    return F.regexp_extract(series_id, PLANT_ID_PATTERN, 1)


def label_before_comma(name: Column | str) -> Column:
    return F.regexp_extract(name, LABEL_PATTERN, 0)


def column_name(name: Column | str, pattern: str, replacement: str) -> Column:
    """Series name to column name: keep what ``replacement`` keeps, lower case, blanks to ``_``."""
    return F.regexp_replace(F.lower(F.regexp_replace(name, pattern, replacement)), " ", "_")


def matches_any(col: Column | str, patterns: list[str], ignore_case: bool = False) -> Column:
    joined = "|".join(f"(?:{p})" for p in patterns)
    return (F.col(col) if isinstance(col, str) else col).rlike(("(?i)" if ignore_case else "") + joined)


def starts_with_any(col: Column | str, prefixes: list[str]) -> Column:
    """OR of ``startswith``: unlike a regex, file sources take it as a pushed filter."""
    col = F.col(col) if isinstance(col, str) else col
    test = col.startswith(prefixes[0])
    for prefix in prefixes[1:]:
        test = test | col.startswith(prefix)
    return test
