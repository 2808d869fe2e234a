"""Row filters and fills that need a fitted value or a second table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmark.operators.ordering import exact_quantiles
from foldmark.session import small_side


def open_range(df: DataFrame, col: str, low: float, high: float) -> DataFrame:
    """Rows strictly between the bounds."""
    return df.filter((F.col(col) > low) & (F.col(col) < high))


def null_partition(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """Rows with and rows without a value."""
    return df.filter(F.col(col).isNotNull()), df.filter(F.col(col).isNull())


def fit_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Exact median per column; one number each."""
    return {c: v[0] for c, v in exact_quantiles(df, cols, [0.5]).items()}


def fit_modes(df: DataFrame, cols: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column, the smallest on ties.

    Values are counted before they are compared; columns of one type share a pass.
    """
    alike: dict[str, list[str]] = {}
    for c in cols:
        alike.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    out: dict[str, object] = dict.fromkeys(cols)
    for names in alike.values():
        entries = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in names])
        counts = df.select(F.explode(entries).alias("e")).filter("e.v IS NOT NULL").groupBy("e").count()
        best = F.min_by("e.v", F.struct(-F.col("count"), F.col("e.v"))).alias("mode")
        out.update({r["c"]: r["mode"] for r in counts.groupBy(F.col("e.c").alias("c")).agg(best).collect()})
    return out


def fill(df: DataFrame, fitted: Mapping[str, object]) -> DataFrame:
    """Replace nulls by fitted values, which may come from another table than ``df``.

    An integer column that is filled with a fraction becomes double.
    """
    known = {c: v for c, v in fitted.items() if v is not None}
    fractions = [c for c, v in known.items() if isinstance(v, float) and not v.is_integer()]
    whole = ("tinyint", "smallint", "int", "bigint")
    widened = {c: F.col(c).cast("double") for c in fractions if df.schema[c].dataType.simpleString() in whole}
    return df.withColumns(widened).fillna(known)


def missing_counts(df: DataFrame) -> DataFrame:
    """Nulls per column, long form, one scan."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "missing")


def map_with_fallback(df: DataFrame, col: str, mapping: DataFrame) -> DataFrame:
    """Replace ``col`` by ``mapping.target`` where ``mapping.source`` matches, else keep it."""
    pairs = mapping.select(F.col("source").alias("_source"), F.col("target").alias("_target"))
    joined = df.join(pairs, F.col(col) == F.col("_source"), "left")
    return joined.withColumn(col, F.coalesce("_target", col)).drop("_source", "_target")


def age(df: DataFrame, year: str, out: str, reference: int | None = None) -> DataFrame:
    """Reference year minus ``year``; without a reference, the latest year in the data plus one."""
    if reference is not None:
        return df.withColumn(out, F.lit(reference) - F.col(year))
    latest = df.agg((F.max(year) + 1).alias("_latest"))
    return df.crossJoin(F.broadcast(latest)).withColumn(out, F.col("_latest") - F.col(year)).drop("_latest")


def keep_valid_ids(df: DataFrame, key: str, ids: str, valid: DataFrame) -> DataFrame:
    """Restrict the id array of every row to ids found in the one column of ``valid``."""
    name = valid.columns[0]
    known = small_side(valid.select(F.col(name).alias("_id")).distinct())
    exploded = df.select(key, F.posexplode(ids).alias("_pos", "_id"))
    kept = exploded.join(known, "_id", "left_semi").groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_id"))), lambda s: s["_id"]).alias("_kept")
    )  # an array is never longer than the one it came from
    empty = F.array().cast(df.schema[ids].dataType)
    return df.join(kept, key, "left").withColumn(ids, F.coalesce("_kept", empty)).drop("_kept")
