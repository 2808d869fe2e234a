"""Null rules, coercion and numeric feature expressions on columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_RADIUS_KM = 6371


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN becomes NULL, so that every later aggregate skips it."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def columns_of_type(df: DataFrame, kind: str) -> list[str]:
    """Names of the ``number``, ``text`` or ``time`` columns, in schema order."""
    kinds = {
        "number": T.NumericType,
        "text": T.StringType,
        "time": (T.TimestampType, T.TimestampNTZType, T.DateType),
    }
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds[kind])]


def drop_present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop the named columns that exist; ignore the others."""
    return df.drop(*[n for n in names if n in df.columns])


def clean_header(df: DataFrame, renames: Mapping[str, str] | None = None) -> DataFrame:
    """Trim column names, then rename."""
    renames = renames or {}
    trimmed = [c.strip() for c in df.columns]
    return df.toDF(*[renames.get(c, c) for c in trimmed])


def derive_by_prefix(df: DataFrame, prefix: str, fn, label: str, skip: Sequence[str] = ()) -> DataFrame:
    """One new column ``label + name`` per column whose name starts with ``prefix``."""
    hits = [c for c in df.columns if c.startswith(prefix) and c not in skip]
    return df.withColumns({f"{label}{c}": fn(F.col(c)) for c in hits})


def as_number(col: Column, decimal: str = ".") -> Column:
    """Text to double, NULL where it is not a number."""
    text = F.trim(col.cast("string"))
    if decimal != ".":
        text = F.replace(text, F.lit(decimal), F.lit("."))
    number = text.try_cast("double")
    typed = text.rlike(r"[0-9.][dDfF]$")  # "1d" is a number to a cast, not in data
    return F.when(~F.isnan(number) & ~typed, number)


def as_timestamp(col: Column, pattern: str | None = None) -> Column:
    """Text to timestamp, NULL where it does not parse."""
    return F.try_to_timestamp(col, F.lit(pattern)) if pattern else F.try_to_timestamp(col)


def recode(col: Column, mapping: Mapping, default: Column | None = None) -> Column:
    """Value map for a fixed, short dictionary; unmapped values give ``default`` or NULL."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), col)
    return found if default is None else F.coalesce(found, default)


def ratio(a: Column, b: Column, epsilon: float) -> Column:
    """a / (b + epsilon)."""
    return a / (b + F.lit(epsilon))


def guarded_ratio(a: Column, b: Column) -> Column:
    """a / b where b is positive, else 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def half_even(col: Column, digits: int = 0) -> Column:
    """Rounding with halves to the even neighbour."""
    return F.rint(col) if digits == 0 else F.bround(col, digits)


def unlog_count(col: Column) -> Column:
    """Inverse of log1p for counts: exp(x) - 1, not below zero, halves to even."""
    return half_even(F.greatest(F.expm1(col), F.lit(0.0)))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def flag_sum(*conditions: Column) -> Column:
    return reduce(lambda a, b: a + b, [flag(c) for c in conditions])


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(dlon / 2), 2
    )
    return 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)) * EARTH_RADIUS_KM * 1000
