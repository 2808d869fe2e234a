"""Classification scores. A score that is undefined for a group is NULL."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldmark.operators.aggregate import class_counts, share
from foldmark.operators.ordering import running
from foldmark.session import materialize

# fixed values: threshold grid 0.10, 0.11 .. 0.89 and the answer if no threshold scores
GRID_START, GRID_STEP, GRID_SIZE, NO_THRESHOLD = 0.1, 0.01, 80, 0.5


def accuracy(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose prediction equals the truth; a missing prediction is wrong."""
    hit = F.coalesce((F.col(truth) == F.col(pred)).cast("double"), F.lit(0.0))
    return df.groupBy(*by).agg(F.avg(hit).alias("score"))


def roc_auc(df: DataFrame, truth: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve with average ranks for ties.

    Rows are counted per distinct score; the running number of negatives is a sliced scan, so one
    group with most of the rows is no special case. One class only, a truth besides 0 and 1, or a missing
    score: NULL.
    """
    by = list(by)
    value = F.col(score).try_cast("double").alias("_s")
    rows = df.filter(F.col(truth).isNotNull()).select(*by, F.col(truth).try_cast("double").alias("_y"), value)
    counts = rows.groupBy(*by, "_s").agg(
        F.count_if(F.col("_y") == 1).alias("_pos"),
        F.count_if(F.col("_y") == 0).alias("_neg"),
        F.count_if((~F.col("_y").isin(0.0, 1.0)) | F.col("_s").isNull() | F.isnan("_s")).alias("_odd"),
    )
    counts = materialize(counts, "score-counts")  # the scan below reads it more than once
    below = running(counts, ["_s"], by, {"_below": F.col("_neg")}, before=True)
    wins = F.col("_pos").cast("double") * (F.col("_below") + F.col("_neg") / 2)
    totals = below.groupBy(*by).agg(
        F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"), F.sum("_odd").alias("_o"), F.sum(wins).alias("_w")
    )
    pairs = F.col("_p").cast("double") * F.col("_n").cast("double")
    valid = (F.col("_o") == 0) & (pairs > 0)
    return totals.select(*by, F.when(valid, F.col("_w") / pairs).alias("score"))


def f1_binary(df: DataFrame, truth: str, pred: str, by: Sequence[str] = (), positive=1) -> DataFrame:
    """F1 of the positive class; NULL with more than two classes or without it among two."""
    mine = F.col("class") == F.lit(positive)
    totals = class_counts(df, truth, pred, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("_k"),
        F.count_if(mine).alias("_present"),
        F.sum(F.when(mine, F.col("hits")).otherwise(0)).alias("_h"),
        F.sum(F.when(mine, F.col("support") + F.col("predicted")).otherwise(0)).alias("_tp"),
    )
    usable = (F.col("_k") < 2) | ((F.col("_k") == 2) & (F.col("_present") == 1))
    return totals.select(*by, F.when(usable, share(2 * F.col("_h"), F.col("_tp"))).alias("score"))


def _f1() -> Column:
    return share(2 * F.col("hits"), F.col("support") + F.col("predicted"))


def _matthews() -> Column:
    t, p, h = (F.col(c).cast("double") for c in ("support", "predicted", "hits"))
    s2 = F.sum(t) * F.sum(t)
    low = F.sqrt((s2 - F.sum(p * p)) * (s2 - F.sum(t * t)))
    return share(F.sum(h) * F.sum(t) - F.sum(p * t), low)


def _class_scores() -> dict[str, Column]:
    """Scores that follow from the class counts alone, as aggregates over the classes."""
    hits, support, predicted = F.col("hits"), F.col("support"), F.col("predicted")
    # fixed values: metric names of dataset catalogs
    return {
        "accuracy_score": share(F.sum(hits), F.sum(support)),
        "f1_score_avg_macro": F.avg(_f1()),
        "f1_score_avg_weighted": share(F.sum(_f1() * support), F.sum(support)),
        "precision_score_macro": F.avg(share(hits, predicted)),
        "recall_score_macro": F.avg(share(hits, support)),
        "balanced_accuracy": F.avg(F.when(support > 0, hits / support)),
        "matthews_corrcoef": _matthews(),
    }


CLASS_SCORES = (
    "accuracy_score", "f1_score_avg_macro", "f1_score_avg_weighted", "precision_score_macro",
    "recall_score_macro", "balanced_accuracy", "matthews_corrcoef",
)


def class_scores(
    df: DataFrame, truth: str, pred: str, by: Sequence[str] = (), names: Sequence[str] = CLASS_SCORES
) -> DataFrame:
    """Any of the class-count scores, one column each, from one pass over the rows."""
    scores = _class_scores()
    return class_counts(df, truth, pred, by).groupBy(*by).agg(*[scores[n].alias(n) for n in names])


def _score(df: DataFrame, truth: str, pred: str, by: Sequence[str], name: str) -> DataFrame:
    return class_scores(df, truth, pred, by, [name]).withColumnRenamed(name, "score")


def f1_macro(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean F1 over the classes of truth or prediction."""
    return _score(df, truth, pred, by, "f1_score_avg_macro")


def f1_weighted(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """F1 weighted by the number of true rows per class."""
    return _score(df, truth, pred, by, "f1_score_avg_weighted")


def precision_macro(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return _score(df, truth, pred, by, "precision_score_macro")


def recall_macro(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return _score(df, truth, pred, by, "recall_score_macro")


def balanced_accuracy(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean recall over the classes present in the truth."""
    return _score(df, truth, pred, by, "balanced_accuracy")


def matthews(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Multiclass Matthews correlation; 0 where its denominator is 0."""
    return _score(df, truth, pred, by, "matthews_corrcoef")


def log_loss(
    df: DataFrame, truth: str, prob: str, by: Sequence[str] = (), classes: Sequence | None = None
) -> DataFrame:
    """Mean negative log of the probability given to the true class, clipped to the float epsilon.

    ``prob`` is the probability of class 1, or an array with one entry per class in sorted order; the
    truth is then a 0-based index unless ``classes`` lists the sorted labels. Arrays that do not sum
    to one, or lack the class, are counted in ``bad_rows`` and void the score of their group.
    """
    eps = sys.float_info.epsilon
    if df.schema[prob].dataType.typeName() == "array":
        if classes is None:
            place = F.col(truth).cast("int") + 1
        else:
            place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(truth)).cast("int")
        chance = F.when(place > 0, F.get(F.col(prob), place - 1)).cast("double")
        total = F.aggregate(prob, F.lit(0.0), lambda a, x: a + x.cast("double"))
        bad = chance.isNull() | (F.abs(total - 1) > 1e-6)
    else:
        p = F.col(prob).try_cast("double")
        chance = F.when(F.col(truth) == 1, p).when(F.col(truth) == 0, 1 - p)
        bad = chance.isNull() | (p < 0) | (p > 1)
    clipped = F.least(F.greatest(chance, F.lit(eps)), F.lit(1 - eps))
    bad = F.coalesce(bad, F.lit(True))
    return df.groupBy(*by).agg(
        F.when(F.count_if(bad) == 0, F.avg(-F.ln(clipped))).alias("score"), F.count_if(bad).alias("bad_rows")
    )


def best_f1_threshold(df: DataFrame, truth: str, prob: str, by: Sequence[str] = ()) -> DataFrame:
    """Threshold of the grid with the best F1, the lowest one on ties, in one pass over the rows.

    Rows are counted per grid cell; running totals over at most 81 cells give all thresholds at once.
    """
    by = list(by)

    def mark(i: Column) -> Column:
        return F.lit(GRID_START) + i * F.lit(GRID_STEP)

    value = F.col(prob).cast("double")
    near = F.floor((value - GRID_START) / GRID_STEP)
    cell = F.when(value >= mark(near + 1), near + 1).when(value >= mark(near), near).otherwise(near - 1)
    cell = F.least(F.greatest(cell, F.lit(-1)), F.lit(GRID_SIZE - 1)).cast("int")
    counts = (
        df.filter(F.col(truth).isNotNull() & value.isNotNull())
        .groupBy(*by, cell.alias("_cell"))
        .agg(F.sum(F.col(truth).cast("bigint")).alias("_p"), F.count(F.lit(1)).alias("_n"))
    )
    zero = F.lit(0).cast("bigint")
    empty = F.transform(
        F.sequence(F.lit(0), F.lit(GRID_SIZE - 1)), lambda i: F.struct(i.alias("c"), zero.alias("p"), zero.alias("n"))
    )
    filled = counts.groupBy(*by).agg(
        F.collect_list(F.struct(F.col("_cell").alias("c"), F.col("_p").alias("p"), F.col("_n").alias("n"))).alias("_have")
    )  # at most 81 entries
    grid = filled.select(*by, F.explode(F.concat("_have", empty)).alias("r")).groupBy(*by, F.col("r.c").alias("_cell")).agg(
        F.sum("r.p").alias("_p"), F.sum("r.n").alias("_n")
    )
    group = Window.partitionBy(*by)
    above = group.orderBy(F.col("_cell").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rated = grid.withColumns(
        {"_tp": F.sum("_p").over(above), "_pp": F.sum("_n").over(above), "_all": F.sum("_p").over(group)}
    ).filter(F.col("_cell") >= 0)
    f1 = share(2 * F.col("_tp"), F.col("_pp") + F.col("_all"))
    best = rated.groupBy(*by).agg(F.max(F.struct(f1.alias("f"), (-F.col("_cell")).alias("c"))).alias("_b"))
    scored = F.col("_b.f") > 0
    return best.select(
        *by,
        F.when(scored, F.round(mark(-F.col("_b.c")), 2)).otherwise(F.lit(NO_THRESHOLD)).alias("threshold"),
        F.col("_b.f").alias("score"),
    )
