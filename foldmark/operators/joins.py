"""Joins of the scoring and feature jobs. Catalyst broadcasts a side by its size on file or, with AQE, at run time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmark.operators.ordering import positions


def enrich(df: DataFrame, dimension: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join of a dimension."""
    return df.join(dimension, list(on), "left")


def match(pred: DataFrame, truth: DataFrame, on: Sequence[str]) -> DataFrame:
    """Predictions with their truth; both sides may be large."""
    return pred.join(truth, list(on), "inner")


def seen_in(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other.select(*on), list(on), "left_semi")


def missing_from(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other.select(*on), list(on), "left_anti")


def pair_by_key(truth: DataFrame, pred: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer pairing with a ``pairing`` column: both, truth_only or pred_only."""
    left = truth.withColumn("_in_truth", F.lit(True))
    right = pred.withColumn("_in_pred", F.lit(True))
    state = (
        F.when(F.col("_in_truth") & F.col("_in_pred"), "both")
        .when(F.col("_in_truth"), "truth_only")
        .otherwise("pred_only")
    )
    joined = left.join(right, list(on), "full")
    return joined.withColumn("pairing", state).drop("_in_truth", "_in_pred")


def pair_by_position(
    truth: DataFrame, pred: DataFrame, truth_order: Sequence[str], pred_order: Sequence[str]
) -> DataFrame:
    """Pair the n-th truth with the n-th prediction of two ordered files, up to the shorter one."""
    left = positions(truth, truth_order, name="position")
    right = positions(pred, pred_order, name="position")
    return left.join(right, "position", "inner")


def side_by_side(long: DataFrame, key: str, label: str, value: str, labels: Sequence[str]) -> DataFrame:
    """One column per label, '' where a key lacks it: a pivot in place of N full outer joins."""
    wide = long.groupBy(key).pivot(label, list(labels)).agg(F.first(value))
    return wide.fillna("", subset=list(labels))
