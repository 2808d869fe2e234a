"""Encoders. What is learnt is a table or a few numbers, fitted on the rows given and applied to any others."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmark.operators.ordering import positions
from foldmark.session import materialize, small_side

MAX_LABELS = 10_000


def fit_dictionary(df: DataFrame, col: str) -> DataFrame:
    """``value``, ``code``: the distinct values as text, in byte order, numbered from 0."""
    values = df.select(F.col(col).cast("string").alias("value")).filter(F.col("value").isNotNull()).distinct()
    values = materialize(values, "dictionary-values")
    return positions(values, ["value"], name="_p").select("value", (F.col("_p") - 1).alias("code"))


def encode(df: DataFrame, dictionary: DataFrame, col: str, out: str, unknown: str = "reserve") -> DataFrame:
    """Code of each value; unseen ones get the next free code, or NULL with ``unknown='null'``."""
    codes = small_side(dictionary.select(F.col("value").alias("_value"), F.col("code").alias("_code")))
    joined = df.join(codes, F.col(col).cast("string") == F.col("_value"), "left")
    if unknown == "null":
        return joined.withColumn(out, F.col("_code")).drop("_value", "_code")
    spare = codes.agg(F.coalesce(F.max("_code") + 1, F.lit(0).cast("bigint")).alias("_spare"))
    joined = joined.crossJoin(F.broadcast(spare))
    return joined.withColumn(out, F.coalesce("_code", "_spare")).drop("_value", "_code", "_spare")


def save_dictionary(dictionary: DataFrame, path: str) -> None:
    dictionary.write.mode("overwrite").parquet(path)


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("value STRING, code BIGINT").parquet(path)


def fit_vocabulary(df: DataFrame, labels: str, max_labels: int = MAX_LABELS) -> list:
    """Sorted distinct labels of an array column. More than ``max_labels`` is an error, not a cut."""
    found = df.select(F.explode(labels).alias("l")).distinct().limit(max_labels + 1).collect()
    if len(found) > max_labels:
        raise ValueError(f"more than {max_labels} labels; use binarise_long instead of indicator arrays")
    return sorted(r["l"] for r in found)


def label_dictionary(df: DataFrame, labels: str) -> DataFrame:
    """``value``, ``code`` of the distinct labels of an array column, as a table of any length."""
    return fit_dictionary(df.select(F.explode(labels).alias("value")), "value")


def binarise_long(df: DataFrame, key: Sequence[str], labels: str, dictionary: DataFrame | None = None) -> DataFrame:
    """``key`` + ``code`` of every label that a row has: the ones of the indicator matrix, for any number of labels.

    Null and repeated labels of a row do not count; labels that the dictionary does not have are left out, rows without
    labels have no result.
    """
    codes = label_dictionary(df, labels) if dictionary is None else dictionary
    each = df.select(*key, F.explode(F.array_distinct(labels)).alias("_label"))
    found = small_side(codes.select(F.col("value").alias("_value"), "code"))
    return each.join(found, F.col("_label").cast("string") == F.col("_value")).select(*key, "code")


def binarise(labels: Column, vocabulary: Sequence) -> Column:
    """0/1 array with one entry per vocabulary label."""
    return F.transform(F.array(*[F.lit(v) for v in vocabulary]), lambda v: F.array_contains(labels, v).cast("int"))


def labels_of(indicators: Column, vocabulary: Sequence) -> Column:
    """Inverse of ``binarise``."""
    marked = F.zip_with(
        F.array(*[F.lit(v) for v in vocabulary]), indicators, lambda v, i: F.when(i == 1, v)
    )
    return F.filter(marked, lambda v: v.isNotNull())


def one_hot(code: Column, size: int) -> Column:
    """0/1 array with a one at the code; all zero outside [0, size)."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == code).cast("int"))


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column; a constant column gets deviation 1."""
    row = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)],
    ).first()
    return {c: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(cols)}


def scale(df: DataFrame, scaler: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scaler.items()})


def regression_f(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """F statistic of each column against the target, r^2 / (1 - r^2) * (n - 2), one scan."""
    y = F.col(target).cast("double")
    stats = df.agg(
        *[
            F.struct(
                F.corr(F.col(c).cast("double"), y).alias("r"),
                F.count_if(F.col(c).isNotNull() & y.isNotNull()).alias("n"),
            ).alias(c)
            for c in cols
        ]
    ).unpivot([], list(cols), "feature", "s")
    r2 = F.col("s.r") * F.col("s.r")
    return stats.select("feature", (F.try_divide(r2, 1 - r2) * (F.col("s.n") - 2)).alias("f"))


def select_best(df: DataFrame, target: str, cols: Sequence[str], k: int = 20) -> list[str]:
    """Names of the k columns with the largest F statistic."""
    top = regression_f(df, target, cols).orderBy(F.col("f").desc_nulls_last(), "feature").limit(k)
    return [r["feature"] for r in top.collect()]


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight per class: n / (classes * rows of the class)."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    weight = F.col("_all") / (F.col("_k") * F.col("_n"))
    return counts.crossJoin(F.broadcast(total)).select(label, weight.alias("weight"))
