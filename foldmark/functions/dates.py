"""Calendar features; timestamps are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def date_parts(col: Column, prefix: str) -> dict[str, Column]:
    """Year, month, day, hour and weekday with Monday = 0."""
    return {
        f"{prefix}_year": F.year(col),
        f"{prefix}_month": F.month(col),
        f"{prefix}_day": F.dayofmonth(col),
        f"{prefix}_hour": F.hour(col),
        f"{prefix}_weekday": F.weekday(col),
    }


def unix_parts(seconds: Column, prefix: str) -> dict[str, Column]:
    """Parts of a unix time, with a fixed default per part where it is missing."""
    # fixed values: defaults of the missing parts
    missing = {"year": 2010, "month": 6, "weekday": 0, "hour": 12}
    parts = date_parts(F.timestamp_seconds(seconds), prefix)
    return {f"{prefix}_{p}": F.coalesce(parts[f"{prefix}_{p}"], F.lit(d)) for p, d in missing.items()}


def delay_days(start: Column, end: Column) -> Column:
    """Whole days from start to end, rounded down also when negative."""
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / F.lit(DAY_MICROS))


def year_prefix(col: Column) -> Column:
    """Leading four digits of a text such as '2008-09'."""
    return F.substring(col, 1, 4).try_cast("int")
