"""Multilabel scores on array columns; labels the truth never uses are ignored in predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmark.session import small_side


def _known_counts(df: DataFrame, key: Sequence[str], truth: str, pred: str, by: Sequence[str]) -> DataFrame:
    """Per row: hits, number of true labels, number of predicted labels of the truth's vocabulary."""
    by, key = list(by), list(key)
    vocabulary = df.select(*by, F.explode(truth).alias("_label")).distinct()
    guesses = df.select(*by, *key, F.explode(F.array_distinct(pred)).alias("_label"))
    known = (
        guesses.join(small_side(vocabulary), [*by, "_label"], "left_semi")
        .groupBy(*by, *key)
        .agg(F.count(F.lit(1)).alias("_b"))
    )
    sizes = df.select(
        *by, *key,
        F.size(F.array_distinct(truth)).alias("_a"),
        F.size(F.array_intersect(truth, pred)).alias("_ab"),
    )
    return sizes.join(known, [*by, *key], "left").fillna(0, ["_b"])


def f1_samples(
    df: DataFrame, key: Sequence[str], truth: str, pred: str, by: Sequence[str] = ()
) -> DataFrame:
    """Mean over rows of 2 |a & b| / (|a| + |b|), 0 for a row with no labels at all."""
    counts = _known_counts(df, key, truth, pred, by)
    total = F.col("_a") + F.col("_b")
    f1 = F.when(total > 0, 2 * F.col("_ab") / total).otherwise(F.lit(0.0))
    return counts.groupBy(*by).agg(F.avg(f1).alias("score"))


def fbeta_micro(
    df: DataFrame, truth: str, pred: str, by: Sequence[str] = (), beta: float = 1.0
) -> DataFrame:
    """F-beta of the pooled label decisions; 0 if there are none. Needs no row key."""
    by = list(by)
    vocabulary = df.select(*by, F.explode(truth).alias("_label")).distinct()
    guessed = (
        df.select(*by, F.explode(F.array_distinct(pred)).alias("_label"))
        .join(small_side(vocabulary), [*by, "_label"], "left_semi")
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("_b"))
    )
    totals = df.groupBy(*by).agg(
        F.sum(F.size(F.array_distinct(truth))).alias("_a"),
        F.sum(F.size(F.array_intersect(truth, pred))).alias("_ab"),
    )
    joined = totals.join(guessed, by, "left") if by else totals.crossJoin(F.broadcast(guessed))
    b2 = beta * beta
    tp = F.col("_ab")
    low = b2 * F.col("_a") + F.coalesce(F.col("_b"), F.lit(0))
    return joined.select(*by, F.when(low > 0, (1 + b2) * tp / low).otherwise(F.lit(0.0)).alias("score"))
