"""Ranking scores. A user's list is cut to k before it moves; full lists are ranked in slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldmark.functions.vectors import top_indices
from foldmark.operators.metrics.classification import accuracy, f1_binary, roc_auc
from foldmark.operators.ordering import Key, positions
from foldmark.operators.windows import top_k
from foldmark.session import materialize


def reciprocal_rank(ranked: Column, truth: Column, k: int | None = None) -> Column:
    """1 / position of the truth in the array, 0 if it is not there; ``k`` cuts the array first."""
    items = ranked if k is None else F.slice(ranked, 1, k)
    place = F.nullif(F.array_position(items, truth), F.lit(0).cast("bigint"))
    return F.coalesce(F.try_divide(F.lit(1.0), place), F.lit(0.0))


def mean_reciprocal_rank(
    df: DataFrame, truth: str, ranked: str, by: Sequence[str] = (), k: int = 5, honor_k: bool = False
) -> DataFrame:
    """Mean reciprocal rank of a single truth; ``k`` counts only with ``honor_k``."""
    score = reciprocal_rank(F.col(ranked), F.col(truth), k if honor_k else None)
    return df.groupBy(*by).agg(F.avg(score).alias("score"))


def map3_from_probabilities(df: DataFrame, truth: str, prob: str, by: Sequence[str] = ()) -> DataFrame:
    """1, 1/2 or 1/3 for the true 0-based class among the three most probable."""
    score = reciprocal_rank(top_indices(F.col(prob), 3), F.col(truth).cast("int"))
    return df.groupBy(*by).agg(F.avg(score).alias("score"))


def _hit_sum(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of hit number / position per user over a list of bounded length."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_at"))
    return hits.withColumn("_p", nth / F.col("_at")).groupBy(*keys).agg(F.sum("_p").alias("_sum"))


def map_at_k(
    truth: DataFrame, pred: DataFrame, user: str, item: str, order: Sequence[str | Key], k: int = 10,
    by: Sequence[str] = (),
) -> DataFrame:
    """Mean over users with truths of (sum of precision at each hit) / (number of truths).

    Repeated recommendations count again; a user without predictions scores 0.
    """
    keys = [*by, user]
    top = top_k(pred.select(*keys, item, *_extra(order, keys, item)), keys, order, k, "_at")
    hits = top.select(*keys, item, "_at").join(truth.select(*keys, item).distinct(), [*keys, item], "left_semi")
    users = truth.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    scored = users.join(_hit_sum(hits, keys), keys, "left")
    ap = F.coalesce(F.col("_sum"), F.lit(0.0)) / F.col("_n")
    return scored.groupBy(*by).agg(F.avg(ap).alias("score"))


def _extra(order: Sequence[str | Key], keys: Sequence[str], item: str) -> list[str]:
    names = [k.name if isinstance(k, Key) else k.lstrip("-") for k in order]
    return [n for n in dict.fromkeys(names) if n not in keys and n != item]


def map_full_list(
    truth: DataFrame, pred: DataFrame, user: str, item: str, order: Sequence[str | Key], by: Sequence[str] = ()
) -> DataFrame:
    """Mean average precision with k = number of truths of the user.

    The list counts until k hits are found, wherever they are; users without predictions are left out
    and no user at all scores 0.
    """
    keys = [*by, user]
    placed = positions(pred.select(*keys, item, *_extra(order, keys, item)), order, keys, "_at")
    users = truth.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hits = placed.select(*keys, item, "_at").join(
        truth.select(*keys, item).distinct(), [*keys, item], "left_semi"
    )
    hits = materialize(hits.select(*keys, "_at"), "hits")  # read twice below, and small beside the lists
    numbered = positions(hits, ["_at"], keys, "_nth").join(users, keys)
    sums = numbered.filter(F.col("_nth") <= F.col("_n")).groupBy(*keys).agg(
        F.sum(F.col("_nth") / F.col("_at")).alias("_sum")
    )
    served = users.join(pred.select(*keys).distinct(), keys, "left_semi").join(sums, keys, "left")
    ap = F.coalesce(F.col("_sum"), F.lit(0.0)) / F.col("_n")
    if not by:
        return served.agg(F.coalesce(F.avg(ap), F.lit(0.0)).alias("score"))
    groups = truth.select(*by).distinct()
    means = served.groupBy(*by).agg(F.avg(ap).alias("score"))
    return groups.join(means, list(by), "left").fillna(0.0, ["score"])


def map_distinct(
    truth: DataFrame, pred: DataFrame, user: str, item: str, order: Sequence[str | Key], k: int = 100,
    by: Sequence[str] = (),
) -> DataFrame:
    """Mean over users with predictions; only the first of repeated items can hit.

    Divides by min(number of truths, k); a user without truths scores 0.
    """
    keys = [*by, user]
    top = top_k(pred.select(*keys, item, *_extra(order, keys, item)), keys, order, k, "_at")
    first = top.groupBy(*keys, item).agg(F.min("_at").alias("_at"))
    hits = first.join(truth.select(*keys, item).distinct(), [*keys, item], "left_semi")
    users = truth.groupBy(*keys).agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("_n"))
    scored = pred.select(*keys).distinct().join(users, keys, "left").join(_hit_sum(hits, keys), keys, "left")
    ap = F.coalesce(F.col("_sum") / F.col("_n"), F.lit(0.0))
    return scored.groupBy(*by).agg(F.avg(ap).alias("score"))


def ranking_as_binary(
    truth: DataFrame, pred: DataFrame, user: str, item: str, liked: str, metric: str = "accuracy_score",
    rank: str | None = None, score: str | None = None, threshold: int = 5, tie: str | None = None, by: Sequence[str] = (),
) -> DataFrame:
    """Predict 'liked' for the first ``threshold`` items of each user, then score the matched pairs.

    With ``score`` the items are ranked by it, ties in the order of ``tie`` (the item by default).
    """
    if rank is not None:
        ranked = pred.withColumn("_rank", F.col(rank))
    elif score is not None:
        ranked = positions(pred, [Key(score, False), Key(tie or item)], [*by, user], "_rank")
    else:
        raise ValueError("predictions need a rank or a score column")
    called = ranked.select(*by, user, item, (F.col("_rank") <= threshold).cast("int").alias("_call"))
    merged = called.join(truth.select(user, item, liked), [user, item], "inner")
    # fixed values: metric names; any other name means accuracy
    scorers = {"roc_auc_score": roc_auc, "f1_score": f1_binary}
    return scorers.get(metric, accuracy)(merged, liked, "_call", list(by))


def rank_order(pred: DataFrame, user: str, item: str, infer: bool = False) -> list[Key]:
    """Sort keys of a prediction table: ``rank`` ascending or ``score`` descending.

    Another third column is a guess and needs ``infer``: values all in [0, n] read as ranks.
    """
    if "rank" in pred.columns:
        return [Key("rank"), Key(item)]
    if "score" in pred.columns:
        return [Key("score", False), Key(item)]
    if not infer or len(pred.columns) != 3:
        raise ValueError(f"no rank or score column among {pred.columns}")
    other = pred.columns[2]
    low, high, n = pred.agg(F.min(other), F.max(other), F.count(F.lit(1))).first()
    is_rank = low is not None and low >= 0 and high <= n
    return [Key(other, is_rank), Key(item)]
