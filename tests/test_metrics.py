"""Hand-computed scores for the cases that make the definitions differ."""

import math

import pytest
from pyspark.sql import functions as F

from foldmark.operators.metrics import classification as c
from foldmark.operators.metrics import multilabel, ranking, registry
from foldmark.operators.metrics import regression as reg


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def value(df, col="score"):
    return df.first()[col]


def test_auc_ties_single_class_and_monotone_map(spark):
    rows = [("a", 0, 1.0), ("a", 1, 1.0), ("a", 0, 0.5), ("a", 1, 3.0), ("b", 1, 1.0), ("b", 1, 2.0), ("c", 2, 1.0), ("c", 0, 0.0)]
    df = frame(spark, rows, "g string, y int, s double")
    got = {r["g"]: r["score"] for r in c.roc_auc(df, "y", "s", ["g"]).collect()}
    assert got == {"a": 0.875, "b": None, "c": None}
    mapped = c.roc_auc(df.filter("g = 'a'").withColumn("s", F.exp("s") * 7), "y", "s")
    assert value(mapped) == 0.875


def test_auc_equals_pairwise_under_a_hot_score(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.randint(0, 1), 5.0 if rng.random() < 0.5 else float(rng.randint(0, 40))) for _ in range(600)]
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert math.isclose(value(c.roc_auc(frame(spark, rows, "y int, s double"), "y", "s")), want)


def test_f1_binary_rules(spark):
    two = frame(spark, [(1, 1), (1, 0), (0, 1), (0, 0)], "y int, p int")
    assert value(c.f1_binary(two, "y", "p")) == 0.5
    three = frame(spark, [(1, 1), (2, 0), (0, 1)], "y int, p int")
    assert value(c.f1_binary(three, "y", "p")) is None
    none = frame(spark, [(0, 0), (0, 0)], "y int, p int")
    assert value(c.f1_binary(none, "y", "p")) == 0.0


def test_macro_scores_with_an_unseen_class(spark):
    df = frame(spark, [("a", "a"), ("a", "b"), ("b", "b"), ("b", "c")], "y string, p string")
    assert math.isclose(value(c.f1_macro(df, "y", "p")), (2 / 3 + 0.5 + 0) / 3)
    assert math.isclose(value(c.recall_macro(df, "y", "p")), (0.5 + 0.5 + 0) / 3)
    assert math.isclose(value(c.balanced_accuracy(df, "y", "p")), 0.5)
    assert math.isclose(value(c.precision_macro(df, "y", "p")), (1 + 0.5 + 0) / 3)


def test_matthews_constant_prediction_is_zero(spark):
    df = frame(spark, [("a", "a"), ("b", "a")], "y string, p string")
    assert value(c.matthews(df, "y", "p")) == 0.0


def test_log_loss_clip_and_bad_rows(spark):
    df = frame(spark, [(1, 1.0), (0, 1.0)], "y int, p double")
    assert math.isclose(value(c.log_loss(df, "y", "p")), -math.log(2.220446049250313e-16) / 2, rel_tol=1e-9)
    arrays = frame(spark, [(0, [0.5, 0.5]), (1, [0.9, 0.3])], "y int, p array<double>")
    row = c.log_loss(arrays, "y", "p").first()
    assert row["score"] is None and row["bad_rows"] == 1


def test_threshold_first_best_and_fallback(spark):
    df = frame(spark, [(1, 0.305), (1, 0.7), (0, 0.2)], "y int, p double")
    row = c.best_f1_threshold(df, "y", "p").first()
    assert row["score"] == 1.0 and row["threshold"] == 0.21
    zero = c.best_f1_threshold(frame(spark, [(0, 0.9)], "y int, p double"), "y", "p").first()
    assert row and zero["threshold"] == 0.5 and zero["score"] == 0.0


def test_r2_constant_truth(spark):
    exact = frame(spark, [(2.0, 2.0), (2.0, 2.0)], "y double, p double")
    off = frame(spark, [(2.0, 2.0), (2.0, 3.0)], "y double, p double")
    assert value(reg.r2(exact, "y", "p")) == 1.0 and value(reg.r2(off, "y", "p")) == 0.0
    assert value(reg.r2(exact.limit(1), "y", "p")) is None


def test_wmae_is_not_divided_by_weights(spark):
    df = frame(spark, [(1.0, 2.0, 10.0), (1.0, 1.5, 2.0)], "y double, p double, w double")
    assert value(reg.wmae(df, "y", "p", "w")) == 5.5


def test_rmsle_domain(spark):
    df = frame(spark, [(1.0, -1.0)], "y double, p double")
    assert value(reg.rmsle_multitarget(df, ["y"], ["p"])) is None


def test_reciprocal_rank_ignores_k_unless_asked(spark):
    df = frame(spark, [("c", ["a", "b", "c"]), ("x", ["a"])], "y string, r array<string>")
    assert math.isclose(value(ranking.mean_reciprocal_rank(df, "y", "r", k=2)), 1 / 6)
    assert value(ranking.mean_reciprocal_rank(df, "y", "r", k=2, honor_k=True)) == 0.0


RANKED = [(1, 10, 1), (1, 11, 2), (1, 10, 3), (1, 12, 4), (3, 99, 1)]
TRUTH = [(1, 10), (1, 12), (2, 50)]


def test_ranking_variants(spark):
    pred = frame(spark, RANKED, "u int, i int, rank int")
    truth = frame(spark, TRUTH, "u int, i int")
    # user 1 hits at 1, 3 (again) and 4; user 2 has no predictions
    full = (1 + 2 / 3 + 3 / 4) / 2
    assert math.isclose(value(ranking.map_at_k(truth, pred, "u", "i", ["rank"])), full / 2)
    assert math.isclose(value(ranking.map_at_k(truth, pred, "u", "i", ["rank"], k=2)), (1 / 2) / 2)
    # stops at two hits, and user 2 is left out
    assert math.isclose(value(ranking.map_full_list(truth, pred, "u", "i", ["rank"])), (1 + 2 / 3) / 2)
    # the repeated item hits once; user 3 has predictions but no truth
    assert math.isclose(value(ranking.map_distinct(truth, pred, "u", "i", ["rank"])), ((1 + 2 / 4) / 2 + 0) / 2)


def test_map_full_list_without_common_users(spark):
    pred = frame(spark, [(9, 1, 1)], "u int, i int, rank int")
    truth = frame(spark, TRUTH, "u int, i int")
    assert value(ranking.map_full_list(truth, pred, "u", "i", ["rank"])) == 0.0


def test_ranking_as_binary_by_rank_and_score(spark):
    truth = frame(spark, [(1, 10, 1), (1, 11, 0), (1, 12, 1)], "u int, i int, like int")
    pred = frame(spark, [(1, 10, 1, 0.9), (1, 11, 2, 0.8), (1, 12, 3, 0.1)], "u int, i int, rank int, score double")
    by_rank = ranking.ranking_as_binary(truth, pred, "u", "i", "like", rank="rank", threshold=1)
    by_score = ranking.ranking_as_binary(truth, pred, "u", "i", "like", "f1_score", score="score", threshold=1)
    assert math.isclose(value(by_rank), 2 / 3) and math.isclose(value(by_score), 2 / 3)
    nothing = ranking.ranking_as_binary(truth, pred.withColumn("u", F.lit(7)), "u", "i", "like", rank="rank")
    assert value(nothing) is None


def test_rank_order_detection(spark):
    ranks = frame(spark, [(1, 1, 1.0), (1, 2, 2.0)], "u int, i int, x double")
    scores = frame(spark, [(1, 1, 9.5), (1, 2, -2.0)], "u int, i int, x double")
    assert ranking.rank_order(ranks, "u", "i", infer=True)[0].ascending
    assert not ranking.rank_order(scores, "u", "i", infer=True)[0].ascending
    with pytest.raises(ValueError):
        ranking.rank_order(ranks, "u", "i")


def test_multilabel_vocabulary_and_empty_rows(spark):
    rows = [(1, ["a", "b"], ["a", "zzz"]), (2, [], ["zzz"]), (3, ["c"], [])]
    df = frame(spark, rows, "id int, t array<string>, p array<string>")
    assert math.isclose(value(multilabel.f1_samples(df, ["id"], "t", "p")), (2 / 3 + 0 + 0) / 3)
    assert math.isclose(value(multilabel.fbeta_micro(df, "t", "p")), 2 * 1 / (3 + 1))
    none = frame(spark, [(1, [], [])], "id int, t array<string>, p array<string>")
    assert value(multilabel.fbeta_micro(none, "t", "p")) == 0.0


def test_registry(spark):
    df = frame(spark, [(1.0, 2.0), (None, 1.0)], "y double, p double")
    row = registry.score(df, "mean_absolute_error", "y", "p").first()
    assert (row["score"], row["bad_rows"]) == (1.0, 1)
    with pytest.raises(ValueError):
        registry.metric_named("no such metric")
