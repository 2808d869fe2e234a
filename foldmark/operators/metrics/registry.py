"""Metrics by catalog name, with bad-row counts, custom metrics and direction."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldmark.operators.metrics import classification as c
from foldmark.operators.metrics import ranking
from foldmark.operators.metrics import regression as r

Metric = Callable[..., DataFrame]

# fixed values: metric names of dataset catalogs
METRICS: dict[str, Metric] = {
    "roc_auc_score": c.roc_auc,
    "f1_score": c.f1_binary,
    "accuracy_score": c.accuracy,
    "f1_score_avg_macro": c.f1_macro,
    "f1_score_avg_weighted": c.f1_weighted,
    "precision_score_macro": c.precision_macro,
    "recall_score_macro": c.recall_macro,
    "root_mean_squared_error": r.rmse,
    "log_loss": c.log_loss,
    "mean_squared_error": r.mse,
    "mean_absolute_error": r.mae,
    "matthews_corrcoef": c.matthews,
    "balanced_accuracy": c.balanced_accuracy,
    "mean_average_precision": ranking.mean_reciprocal_rank,
    "r2_score": r.r2,
}
# fixed values: direction names of dataset catalogs
DIRECTION_SIGN = {"maximize": 1, "minimize": -1}

_custom: dict[str, Metric] = {}


def register_metric(name: str, score: Callable[[Column, Column], Column]) -> None:
    """Add a user metric given as an aggregate of the truth and prediction columns."""

    def metric(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
        return df.groupBy(*by).agg(score(F.col(truth), F.col(pred)).alias("score"))

    _custom[name] = metric


def metric_named(name: str) -> Metric:
    found = _custom.get(name) or METRICS.get(name)
    if found is None:
        raise ValueError(f"unknown metric: {name}")
    return found


def score(
    df: DataFrame, metric: str, truth: str, pred: str, by: Sequence[str] = (), **options
) -> DataFrame:
    """``by`` + ``score`` + ``bad_rows``: rows without truth or prediction, left out of the score."""
    by = list(by)
    usable = F.col(truth).isNotNull() & F.col(pred).isNotNull()
    scored = metric_named(metric)(df.filter(usable), truth, pred, by, **options)
    scored = scored.select(*by, "score")
    bad = df.groupBy(*by).agg(F.count_if(~usable).alias("bad_rows"))
    if not by:
        return bad.crossJoin(F.broadcast(scored)).select("score", "bad_rows")
    return bad.join(scored, by, "left").select(*by, "score", "bad_rows")


def improvement(score_col: Column, baseline: Column, direction: Column) -> Column:
    """Positive where the score beats the baseline in the wanted direction."""
    pairs = [F.lit(x) for kv in DIRECTION_SIGN.items() for x in kv]
    return (score_col - baseline) * F.try_element_at(F.create_map(*pairs), direction)
