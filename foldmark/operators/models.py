"""Spark ML fits, out-of-fold predictions, ensembles and model comparison.

Predictions are long tables, key + prediction, so that scoring and ensembling are joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmark.operators.encode import class_weights
from foldmark.operators.forests import CountedBoost, CountedForest
from foldmark.operators.metrics.classification import CLASS_SCORES, class_scores
from foldmark.operators.metrics.registry import metric_named
from foldmark.session import materialize, small_side


def _pipeline(features: Sequence[str], estimator: Estimator) -> Pipeline:
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="error")
    return Pipeline(stages=[assembler, estimator.setFeaturesCol("_features")])


def linear(features: Sequence[str], target: str, strength: float = 0.0, lasso_share: float = 0.0) -> Pipeline:
    """Least squares; ``strength`` adds a ridge penalty, ``lasso_share`` = 1 turns it into a lasso."""
    return _pipeline(
        features, LinearRegression(labelCol=target, regParam=strength, elasticNetParam=lasso_share)
    )


def logistic(features: Sequence[str], target: str, weight: str | None = None, max_iter: int = 100) -> Pipeline:
    model = LogisticRegression(labelCol=target, maxIter=max_iter, regParam=1e-4)
    return _pipeline(features, model.setWeightCol(weight) if weight else model)


def one_vs_rest(features: Sequence[str], target: str, base: Estimator | None = None) -> Pipeline:
    """One binary fit per class."""
    inner = base or LogisticRegression(maxIter=50, regParam=1e-4)
    return _pipeline(features, OneVsRest(classifier=inner, labelCol=target, parallelism=2))


def forest(features: Sequence[str], target: str, classify: bool = False, trees: int = 50, depth: int = 8, seed: int = 42) -> Estimator:
    """Random forest; a regression over many rows is fitted by counts, see ``forests``."""
    kind = RandomForestClassifier if classify else RandomForestRegressor
    plain = _pipeline(features, kind(labelCol=target, numTrees=trees, maxDepth=depth, seed=seed))
    return plain if classify else CountedForest(plain, features, target, trees, depth, seed)


def boosted(
    features: Sequence[str], target: str, classify: bool = False, rounds: int = 50, depth: int = 5,
    validation: str | None = None, seed: int = 42, classes: int = 2,
) -> Estimator:
    """Gradient-boosted trees; a boolean ``validation`` column marks the rows that stop the fit early.

    A regression over many rows is fitted by counts, see ``forests``. With more than two ``classes`` one fit per class against the rest; these take no validation rows.
    """
    kind = GBTClassifier if classify else GBTRegressor
    model = kind(labelCol=target, maxIter=rounds, maxDepth=depth, seed=seed)
    if classify and classes > 2:
        if validation:
            raise ValueError("fits of several classes take no validation rows")
        return _pipeline(features, OneVsRest(classifier=model, labelCol=target, parallelism=2))
    plain = _pipeline(features, model.setValidationIndicatorCol(validation) if validation else model)
    return plain if classify else CountedBoost(plain, features, target, rounds, depth, validation, seed)


def balanced(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Add the balanced class weight of each row."""
    weights = class_weights(df, label).withColumnRenamed("weight", out)
    return df.join(small_side(weights), label, "left")


def predict(model: PipelineModel, df: DataFrame, key: Sequence[str]) -> DataFrame:
    """``key`` + ``prediction``, with ``probability`` of class 1 if the model has one."""
    out = model.transform(df)
    cols = [*key, "prediction"]
    if "probability" in out.columns:
        return out.select(*cols, F.get(vector_to_array("probability"), F.lit(1)).alias("probability"))
    return out.select(*cols)


def fit_per_label(df: DataFrame, features: Sequence[str], labels: str, vocabulary: Sequence) -> dict[object, PipelineModel]:
    """One balanced logistic fit per label of an array column."""
    models = {}
    for label in vocabulary:
        marked = df.withColumn("_y", F.array_contains(labels, label).cast("double"))
        models[label] = logistic(features, "_y", "_w").fit(balanced(marked, "_y", "_w"))
    return models


def predict_labels(models: Mapping[object, PipelineModel], df: DataFrame, key: Sequence[str]) -> DataFrame:
    """``key`` + ``labels``: the labels whose model says yes."""
    votes = None
    for label, model in models.items():
        part = predict(model, df, key).select(*key, F.lit(label).alias("_l"), "prediction")
        votes = part if votes is None else votes.unionByName(part)
    said = F.collect_list(F.when(F.col("prediction") == 1, F.col("_l")))  # one entry per model
    return votes.groupBy(*key).agg(F.sort_array(said).alias("labels"))


def out_of_fold(
    df: DataFrame, estimator: Estimator, key: Sequence[str], fold: str, k: int, keep: Sequence[str] = ()
) -> DataFrame:
    """``key`` + ``fold`` + ``keep`` + ``prediction`` of the model that did not see the row.

    The folded table is kept once, so that k fits read it and do not make it again. Linear fits have a form without refits: ``linear.ridge_out_of_fold``.
    """
    df = materialize(df, "folded")
    out = None
    for i in range(k):
        model = estimator.fit(df.filter(~F.col(fold).eqNullSafe(i)))
        part = predict(model, df.filter(F.col(fold) == i), [*key, fold, *keep])
        out = part if out is None else out.unionByName(part)
    return out


def with_oof_feature(df: DataFrame, estimator: Estimator, key: Sequence[str], fold: str, k: int, name: str) -> DataFrame:
    """Out-of-fold prediction as a new column; null for rows of no fold."""
    rest = [c for c in df.columns if c not in (*key, fold)]
    scores = out_of_fold(df, estimator, key, fold, k, keep=rest).withColumnRenamed("prediction", name)
    others = df.filter(F.col(fold).isNull() | ~F.col(fold).between(0, k - 1)).withColumn(name, F.lit(None).cast("double"))
    return scores.select(*df.columns, name).unionByName(others)


def cross_validate(
    df: DataFrame, estimator: Estimator, key: Sequence[str], target: str, fold: str, k: int, metric: str
) -> DataFrame:
    """Score per fold with the mean and population deviation over the folds."""
    scores = out_of_fold(df, estimator, key, fold, k, keep=[target])
    per_fold = metric_named(metric)(scores, target, "prediction", [fold])
    spread = per_fold.agg(F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"))
    return per_fold.select(fold, "score").crossJoin(F.broadcast(spread))


def oof_target_mean(df: DataFrame, group: str, target: str, fold: str, out: str) -> DataFrame:
    """Mean target of the group over the other folds; the other folds' overall mean for a group not seen there.

    Group sums minus the own fold's, so the rows are aggregated once and joined once.
    """
    cells = df.groupBy(group, fold).agg(F.coalesce(F.sum(target), F.lit(0)).alias("_s"), F.count(target).alias("_n"))
    groups = cells.groupBy(group).agg(F.sum("_s").alias("_gs"), F.sum("_n").alias("_gn"))
    per_fold = cells.groupBy(fold).agg(F.sum("_s").alias("_fs"), F.sum("_n").alias("_fn"))
    whole = per_fold.agg(F.sum("_fs").alias("_as"), F.sum("_fn").alias("_an"))
    rest = per_fold.crossJoin(F.broadcast(whole)).select(
        fold, F.try_divide(F.col("_as") - F.col("_fs"), F.col("_an") - F.col("_fn")).alias("_prior")
    )
    groups = groups.withColumnRenamed(group, "_g")
    means = cells.join(groups, F.col(group).eqNullSafe(F.col("_g"))).join(F.broadcast(rest), fold).select(
        F.col(group).alias("_g"), F.col(fold).alias("_f"),
        F.coalesce(F.try_divide(F.col("_gs") - F.col("_s"), F.col("_gn") - F.col("_n")), "_prior").alias(out),
    )
    same = F.col(group).eqNullSafe(F.col("_g")) & (F.col(fold) == F.col("_f"))
    return df.join(small_side(means), same, "left").drop("_g", "_f")


def mean_ensemble(predictions: DataFrame, key: Sequence[str], models: Sequence | None = None) -> DataFrame:
    """Mean prediction per key over all, or the named, models."""
    kept = predictions if models is None else predictions.filter(F.col("model").isin(list(models)))
    return kept.groupBy(*key).agg(F.avg("prediction").alias("prediction"))


def majority_vote(predictions: DataFrame, key: Sequence[str]) -> DataFrame:
    """Most frequent prediction per key, the smallest on ties."""
    votes = predictions.groupBy(*key, "prediction").agg(F.count(F.lit(1)).alias("_n"))
    best = F.min_by("prediction", F.struct(-F.col("_n"), F.col("prediction")))
    return votes.groupBy(*key).agg(best.alias("prediction"))


def best_models(scores: DataFrame, n: int = 3, lowest: bool = True) -> list:
    """Names of the n models with the best score, ties by name."""
    order = F.col("score") if lowest else F.col("score").desc()
    return [r["model"] for r in scores.orderBy(order, "model").limit(n).collect()]


def decide(probability: Column, threshold: float = 0.5, inclusive: bool = True) -> Column:
    """0/1 decision: p >= t, or p > t."""
    return ((probability >= threshold) if inclusive else (probability > threshold)).cast("int")


def compare_models(
    predictions: DataFrame, truth: str, pred: str, metrics: Sequence[str], by: str = "model"
) -> DataFrame:
    """One row per model, one column per metric; metrics from class counts share one pass.

    Accuracy is the registry's, which counts a missing prediction as wrong.
    """
    shared = [m for m in metrics if m in CLASS_SCORES and not m.startswith("accuracy")]
    out = class_scores(predictions, truth, pred, [by], shared) if shared else None
    for name in metrics:
        if name not in shared:
            part = metric_named(name)(predictions, truth, pred, [by]).select(by, F.col("score").alias(name))
            out = part if out is None else out.join(part, by)
    return out.select(by, *metrics)


def importances(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """``feature``, ``importance`` of the last stage, largest first."""
    fitted = model.stages[-1]
    values = fitted.featureImportances.toArray().tolist()
    rows = list(zip(features, values, strict=True))
    return SparkSession.active().createDataFrame(rows, "feature STRING, importance DOUBLE").orderBy(F.col("importance").desc(), "feature")
