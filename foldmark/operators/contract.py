"""User code: submissions, splitters and row functions, all on Spark DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldmark.operators import split
from foldmark.operators.metrics.registry import metric_named
from foldmark.session import materialize

# fixed values: names of the user functions
STAGED = ("train", "prepare_val", "predict")
SINGLE = "train_and_predict"


def run_submission(
    code: Mapping[str, Callable], train: DataFrame, features: DataFrame
) -> DataFrame:
    """Predictions, ``key`` columns + ``prediction``, of a staged or a single-function submission."""
    if callable(code.get(SINGLE)):
        return code[SINGLE](train, features)
    missing = [name for name in STAGED if not callable(code.get(name))]
    if missing:
        raise ValueError(f"not callable: {', '.join(missing)}")
    state = code["train"](train)
    return code["predict"](state, code["prepare_val"](state, features))


def evaluate_submission(
    code: Mapping[str, Callable],
    folds: DataFrame,
    key: Sequence[str],
    target: str,
    metric: str,
    n_folds: int,
) -> DataFrame:
    """Score per fold: ``fold``, ``score``, ``success``, ``error``, ``unmatched`` validation rows.

    ``folds`` has ``fold`` and ``role``. A fold whose user code fails is recorded and the others go on;
    predictions meet the labels by key.
    """
    key = list(key)
    spark = folds.sparkSession
    folds = materialize(folds, "folds", partition_by=("fold",))  # made once, read by fold
    out = None
    for i in range(n_folds):
        parts = split.project_role(folds.filter(F.col("fold") == i).drop("fold"), target, ids=key)
        lost = None
        try:
            pred = run_submission(code, parts["train"], parts["x_val"]).select(*key, "prediction")
            pred = materialize(pred, "predictions")  # user code that fails in a task fails here
            paired = parts["y_val"].join(pred, key, "left")
            lost = paired.agg(F.count_if(F.col("prediction").isNull())).first()[0]
            twice = pred.groupBy(*key).count().filter("count > 1").count()
            if lost or twice:
                raise ValueError(f"{lost} rows without a prediction, {twice} keys with several")
            scored = metric_named(metric)(paired, target, "prediction")
            line = scored.select(
                F.lit(i).alias("fold"), F.col("score").cast("double").alias("score"),
                F.col("score").isNotNull().alias("success"), F.lit(None).cast("string").alias("error"),
                F.lit(0).cast("bigint").alias("unmatched"),
            )
        except Exception as e:  # noqa: BLE001 - user code may raise anything
            line = spark.createDataFrame(
                [(i, None, False, f"{type(e).__name__}: {e}".split("\n")[0], lost)],
                "fold INT, score DOUBLE, success BOOLEAN, error STRING, unmatched BIGINT",
            )
        out = line if out is None else out.unionByName(line)
    return out


def custom_split(df: DataFrame, split_fn: Callable[[DataFrame], DataFrame], key: Sequence[str]) -> DataFrame:
    """Rows with ``fold`` and ``role`` from user code; a key on both sides of a fold is an error."""
    out = split_fn(df)
    absent = {"fold", "role"} - set(out.columns)
    if absent:
        raise ValueError(f"the split lacks {sorted(absent)}")
    if split.overlap(out, key).limit(1).count():
        raise ValueError("the split puts a key on both sides of a fold")
    return out


def map_rows(df: DataFrame, fn: Callable, cols: Sequence[str], out: str, dtype: str | T.DataType) -> DataFrame:
    """Column ``out`` = ``fn(*cols)`` per row, for user functions without a built-in form.

    The function runs on Arrow batches; prefer column expressions where they exist.
    """

    @F.pandas_udf(dtype)
    def apply(batch: pd.DataFrame) -> pd.Series:
        return pd.Series([fn(*row) for row in batch.itertuples(index=False, name=None)], dtype=object)

    return df.withColumn(out, apply(F.struct(*cols)))
