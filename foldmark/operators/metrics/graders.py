"""Graders by catalog name: from a truth table and a prediction table to scores.

Predictions may hold many submissions; ``by`` names the columns that tell them apart (model, language).
Truth and prediction meet by key. A grader that cannot work on its input gives a NULL score with the error.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldmark.functions.text import parse_ints, parse_list_literal
from foldmark.operators.metrics import multilabel, ranking, regression
from foldmark.operators.metrics.registry import metric_named
from foldmark.session import small_side

log = logging.getLogger(__name__)

# fixed values: metric names that take several columns, arrays or weights
SPECIAL = {
    "root_mean_squared_error_multitarget",
    "root_mean_squared_logarithmic_error_multitarget",
    "wmae",
    "f1_score_multilabel",
}


def _targets(entry: Mapping) -> list[str]:
    target = entry.get("target_col") or "target"
    return [target] if isinstance(target, str) else list(target)


def _paired(truth: DataFrame, pred: DataFrame, key: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Predictions with the truth columns renamed to ``true_<name>``."""
    right = truth.select(*key, *[F.col(c).alias(f"true_{c}") for c in dict.fromkeys(keep)])
    return pred.join(right, list(key), "inner")


NUMBERS = ("squared", "absolute", "wmae", "r2", "roc_auc", "log_loss")  # parts of the names of metrics of numbers


def _faults(
    truth: DataFrame, pred: DataFrame, entry: Mapping, key: Sequence[str], by: Sequence[str], submissions: DataFrame | None = None
) -> DataFrame:
    """``by`` + ``fault``: what keeps a submission from being complete, NULL if nothing does.

    Missing, doubled and extra keys, and texts where the metric needs numbers. ``submissions`` lists those that are expected, so that one without any row is seen.
    A truth that has the ``by`` columns itself asks each submission for its own keys only.
    """
    own = list(by) if by and set(by) <= set(truth.columns) else []
    expected = truth.select(*own, *key).distinct().withColumn("_known", F.lit(True))
    total = F.col("_asked")
    metric = entry.get("metric", "accuracy_score")
    odd = F.lit(False)
    for name in ["prediction"] if "prediction" in pred.columns else [t for t in _targets(entry) if t in pred.columns]:
        if isinstance(pred.schema[name].dataType, T.StringType) and any(part in metric for part in NUMBERS):
            odd |= F.col(name).isNotNull() & F.col(name).try_cast("double").isNull()
    dealt = pred if own else pred.repartition(*key)  # keys are counted where they meet the truth's: rows move once
    keys = dealt.groupBy(*by, *key).agg(F.count(F.lit(1)).alias("_n"), F.count_if(odd).alias("_odd"))
    counts = keys.join(expected, [*own, *key], "left").groupBy(*by).agg(
        F.count("_known").alias("known"), F.count_if(F.col("_n") > 1).alias("doubled"),
        F.count_if(F.col("_known").isNull()).alias("extra"), F.sum("_odd").alias("not_numeric"),
    )
    counts = counts.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], "known", "doubled", "extra", "not_numeric")
    if own:
        submissions = expected.groupBy(*own).agg(F.count(F.lit(1)).alias("_total"))
        total = F.coalesce("_total", F.lit(0))
    if by and submissions is not None:
        wanted = submissions.select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(by)], *(["_total"] if own else [])).distinct()
        wanted = wanted.join(counts, [F.col(f"_w{i}").eqNullSafe(F.col(f"_b{i}")) for i in range(len(by))], "full")
        counts = wanted.withColumns({f"_b{i}": F.coalesce(f"_b{i}", f"_w{i}") for i in range(len(by))})
    if not own:
        counts = counts.crossJoin(F.broadcast(expected.agg(F.count(F.lit(1)).alias("_asked"))))  # one row
    counts = counts.withColumn("missing", total - F.coalesce("known", F.lit(0)))
    parts = [F.when(F.col(c) > 0, F.concat(F.col(c), F.lit(f" {c}"))) for c in ("missing", "doubled", "extra", "not_numeric")]
    said = F.concat_ws(", ", *parts)
    return counts.select(*[f"_b{i}" for i in range(len(by))], F.when(said != "", said).alias("fault"))


def grade_default(truth, pred, entry, key, by, **_) -> DataFrame:
    """The catalog's metric on ``prediction``, or on one prediction column per target."""
    metric, targets = entry.get("metric", "accuracy_score"), _targets(entry)
    weight = entry.get("weight_col")
    paired = _paired(truth, pred, key, targets + ([weight] if weight else []))
    true = [f"true_{t}" for t in targets]
    if metric == "root_mean_squared_error_multitarget":
        return regression.rmse_multitarget(paired, true, targets, by)
    if metric == "root_mean_squared_logarithmic_error_multitarget":
        return regression.rmsle_multitarget(paired, true, targets, by)
    if metric == "wmae":
        if not weight:
            raise ValueError("wmae needs weight_col")
        return regression.wmae(paired, true[0], "prediction", f"true_{weight}", by)
    if metric == "f1_score_multilabel":
        return multilabel.f1_samples(paired, key, true[0], "prediction", by)
    return metric_named(metric)(paired, true[0], "prediction", by).select(*by, "score")


def _is_text(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.StringType)


def grade_multilabel(truth, pred, entry, key, by, **_) -> DataFrame:
    """``default`` after parsing list literals on either side."""
    target = _targets(entry)[0]
    if _is_text(truth, target):
        truth = truth.withColumn(target, parse_list_literal(F.col(target)))
    if _is_text(pred, "prediction"):
        pred = pred.withColumn("prediction", parse_list_literal(F.col("prediction")))
    return grade_default(truth, pred, {"metric": "f1_score_multilabel", **entry}, key, by)


def grade_photo(truth, pred, entry, key, by, **_) -> DataFrame:
    """Micro F-beta of white-space separated label numbers."""
    target = _targets(entry)[0]
    paired = _paired(truth, pred, key, [target])
    for col in (f"true_{target}", "prediction"):
        if _is_text(paired, col):
            paired = paired.withColumn(col, parse_ints(F.col(col)))
    return multilabel.fbeta_micro(paired, f"true_{target}", "prediction", by, entry.get("beta") or 1.0)


def grade_labels(truth, pred, entry, key, by, **_) -> DataFrame:
    """``default`` on labels compared as text."""
    target = _targets(entry)[0]
    truth = truth.withColumn(target, F.col(target).cast("string"))
    return grade_default(truth, pred.withColumn("prediction", F.col("prediction").cast("string")), entry, key, by)


def grade_animals(truth, pred, entry, key, by, **_) -> DataFrame:
    """Text labels; an F1 metric means the macro average."""
    metric = entry.get("metric", "f1_score")
    return grade_labels(truth, pred, {**entry, "metric": "f1_score_avg_macro" if metric == "f1_score" else metric}, key, by)


def _liked(truth: DataFrame, entry: Mapping) -> str:
    target = _targets(entry)[0] if entry.get("target_col") else "like"
    if target not in truth.columns:
        raise ValueError(f"the truth has no column {target}")
    return target


def grade_ranking(truth, pred, entry, key, by, user, item) -> DataFrame:
    """MAP@k of ranked or scored items against the liked ones."""
    liked = truth.filter(F.col(_liked(truth, entry)) == 1).select(*by, user, item)
    order = ranking.rank_order(pred, user, item, infer=True)
    return ranking.map_at_k(liked, pred, user, item, order, entry.get("map_k") or 10, by)


def grade_full_ranking(truth, pred, entry, key, by, user, item) -> DataFrame:
    """MAP with k = number of liked items of the user."""
    liked = truth.filter(F.col(_liked(truth, entry)) == 1).select(*by, user, item)
    order = ranking.rank_order(pred, user, item, infer=True)
    return ranking.map_full_list(liked, pred, user, item, order, by)


def grade_ranking_as_binary(truth, pred, entry, key, by, user, item) -> DataFrame:
    """Top items as positive predictions, scored on the matched pairs."""
    liked = _liked(truth, entry)
    column = {"rank": "rank"} if "rank" in pred.columns else {"score": "score"}
    return ranking.ranking_as_binary(
        truth, pred, user, item, liked, entry.get("metric", "accuracy_score"),
        threshold=entry.get("binary_threshold") or 5, by=by, **column,
    )


# fixed values: grader names of dataset catalogs
GRADERS: dict[str, Callable[..., DataFrame]] = {
    "default": grade_default,
    "prml_nov2020": grade_ranking,
    "map_at_k": grade_ranking,
    "recommendation": grade_ranking,
    "binary_from_ranking": grade_ranking_as_binary,
    "multilabel": grade_multilabel,
    "multitarget": grade_default,
    "biker_recommender": grade_full_ranking,
    "classify_leaves": grade_labels,
    "photo_classification": grade_photo,
    "sheep_classification": grade_animals,
}


#: Graders that pair predictions with the truth by key: an incomplete submission has no score there.
KEYED = ("default", "multitarget", "multilabel", "classify_leaves", "photo_classification", "sheep_classification")


def grade(
    truth: DataFrame,
    pred: DataFrame,
    entry: Mapping,
    key: Sequence[str] = ("id",),
    by: Sequence[str] = (),
    user: str = "user_id",
    item: str = "item_id",
    submissions: DataFrame | None = None,
) -> DataFrame:
    """``by`` + ``score`` + ``error`` by the entry's grader and metric.

    Ranking graders need the ``by`` columns in the truth as well, so that users a submission left out are seen.
    An unknown grader or metric is an error; input it cannot work on gives a NULL score, and so does an incomplete
    submission under any grader that pairs by key, with the counts of what is missing, doubled, extra or no number as its
    error. ``submissions`` lists the ``by`` columns of all that are expected; one that sent nothing is reported as well. A truth with the
    ``by`` columns lists them itself, and what each has to send.
    """
    name = entry.get("grader") or "default"
    if name not in GRADERS:
        raise ValueError(f"unknown grader: {name}")
    if name in ("default", "classify_leaves") and entry.get("metric", "accuracy_score") not in SPECIAL:
        metric_named(entry.get("metric", "accuracy_score"))
    by = list(by)
    try:
        scored = GRADERS[name](truth, pred, entry, list(key), by, user=user, item=item)
        if name in KEYED:
            faults = small_side(_faults(truth, pred, entry, list(key), by, submissions))
            same = [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(by)]
            both = faults.join(scored, same, "left") if by else faults.crossJoin(scored)
            given = [F.col(f"_b{i}").alias(c) for i, c in enumerate(by)]
            score = F.when(F.col("fault").isNull(), F.col("score").cast("double"))
            return both.select(*given, score.alias("score"), F.col("fault").alias("error"))
        return scored.select(*by, F.col("score").cast("double").alias("score"), F.lit(None).cast("string").alias("error"))
    except (AnalysisException, ValueError) as e:
        log.error("grading failed: %s", e)
        empty = [F.lit(None).cast(pred.schema[c].dataType).alias(c) for c in by]
        one = truth.sparkSession.range(1)
        return one.select(*empty, F.lit(None).cast("double").alias("score"), F.lit(str(e).split("\n")[0]).alias("error"))
