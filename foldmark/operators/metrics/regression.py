"""Regression scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pairs(df: DataFrame, truth: str, pred: str) -> tuple[Column, Column]:
    """Both as numbers; a text that is no number is null, which ``grade`` counts."""
    return F.col(truth).try_cast("double"), F.col(pred).try_cast("double")


def mse(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    y, p = _pairs(df, truth, pred)
    return df.groupBy(*by).agg(F.avg((y - p) * (y - p)).alias("score"))


def rmse(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    y, p = _pairs(df, truth, pred)
    return df.groupBy(*by).agg(F.sqrt(F.avg((y - p) * (y - p))).alias("score"))


def mae(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    y, p = _pairs(df, truth, pred)
    return df.groupBy(*by).agg(F.avg(F.abs(y - p)).alias("score"))


def r2(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """1 - SSE/SST; a constant truth scores 1 if met exactly, else 0; fewer than two rows give NULL."""
    y, p = _pairs(df, truth, pred)
    totals = df.filter(y.isNotNull() & p.isNotNull()).groupBy(*by).agg(
        F.sum((y - p) * (y - p)).alias("_e"), (F.var_pop(y) * F.count(y)).alias("_t"), F.count(y).alias("_n"),
        (F.min(y) == F.max(y)).alias("_flat"),
    )
    flat = F.when(F.col("_e") == 0, 1.0).otherwise(0.0)
    score = F.when(F.col("_flat"), flat).otherwise(1 - F.try_divide("_e", "_t"))
    return totals.select(*by, F.when(F.col("_n") >= 2, score).alias("score"))


def wmae(df: DataFrame, truth: str, pred: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean of weight times absolute error, not divided by the weights."""
    y, p = _pairs(df, truth, pred)
    return df.groupBy(*by).agg(F.avg(F.col(weight) * F.abs(y - p)).alias("score"))


def _mean_over_targets(df: DataFrame, parts: list[Column], by: Sequence[str]) -> DataFrame:
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return df.groupBy(*by).agg((total / len(parts)).alias("score"))


def rmse_multitarget(
    df: DataFrame, truth: Sequence[str], pred: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Mean of the RMSE of each target."""
    parts = []
    for t, q in zip(truth, pred, strict=True):
        y, p = _pairs(df, t, q)
        parts.append(F.sqrt(F.avg((y - p) * (y - p))))
    return _mean_over_targets(df, parts, by)


def rmsle_multitarget(
    df: DataFrame, truth: Sequence[str], pred: Sequence[str], by: Sequence[str] = (), bound: float = -1.0
) -> DataFrame:
    """Mean of the RMSLE of each target; NULL for a group with a value at or below ``bound``."""
    parts = []
    for t, q in zip(truth, pred, strict=True):
        y, p = _pairs(df, t, q)
        inside = (y > bound) & (p > bound)
        gap = F.when(inside, F.log1p(y) - F.log1p(p))
        parts.append(F.when(F.bool_and(F.coalesce(inside, F.lit(False))), F.sqrt(F.avg(gap * gap))))
    return _mean_over_targets(df, parts, by)
