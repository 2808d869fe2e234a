"""Nulls, incomplete submissions and broken input, on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from foldmark.functions.text import parse_ints
from foldmark.operators import clean, contract, models, split
from foldmark.operators.metrics import graders
from foldmark.sources import folds, results


@pytest.fixture(scope="module")
def gaps(spark):
    rows = [(i, None if i % 2 else "a", None if i % 3 == 0 else i) for i in range(60)]
    return spark.createDataFrame(rows, "id int, c string, t int")


def test_null_strata_are_validated_once(spark, gaps):
    dealt = split.stratified_kfold(gaps, ["id"], ["c"], 5).groupBy("c", "fold").count().collect()
    assert sorted((str(r["c"]), r["fold"], r["count"]) for r in dealt) == sorted((c, f, 6) for c in ("a", "None") for f in range(5))
    sides = split.stratified_holdout(gaps, ["id"], ["c"], 0.2).filter("role = 'val'").groupBy("c").count().collect()
    assert {r["c"]: r["count"] for r in sides} == {None: 6, "a": 6}
    assert split.quantile_bins(gaps, "t", 4).filter("bin IS NULL").count() == 0


def test_null_times_sort_last(spark, gaps):
    sides = split.ordered_holdout(gaps, ["t", "id"], 0.5)
    want = set(sorted(range(60), key=lambda i: (i % 3 == 0, 0 if i % 3 == 0 else i, i))[30:])
    assert {r["id"] for r in sides.filter("role = 'val'").collect()} == want
    for made in (split.time_expanding(gaps, "t", ["id"], 2), split.time_series_split(gaps, "t", ["id"], 2)):
        counts = {(r["fold"], r["role"]): r["count"] for r in made.groupBy("fold", "role").count().collect()}
        assert counts == {(0, "train"): 20, (0, "val"): 20, (1, "train"): 40, (1, "val"): 20}


def test_null_group_gets_the_others_mean(spark):
    rows = spark.createDataFrame([(1, None, 0, 1.0), (2, None, 1, 3.0), (3, "g", 0, 5.0)], "id int, g string, fold int, y double")
    got = {r["id"]: r["m"] for r in models.oof_target_mean(rows, "g", "y", "fold", "m").collect()}
    assert got == {1: 3.0, 2: 1.0, 3: 3.0}


def test_median_fill_keeps_fractions(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "v int")
    assert sorted(r["v"] for r in clean.fill(rows, {"v": 2.5}).collect()) == [1, 2, 2.5, 3, 4]


def test_incomplete_submissions_have_no_score(spark):
    truth = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 100.0)], "id int, target double")
    sent = {
        "good": [(1, "1"), (2, "2"), (3, "97")], "missing": [(1, "1"), (2, "2")], "doubled": [(1, "1"), (2, "2"), (3, "97"), (3, "97")],
        "extra": [(1, "1"), (2, "2"), (3, "97"), (4, "0")], "text": [(1, "1"), (2, "abc"), (3, "97")],
    }
    pred = spark.createDataFrame([(s, *r) for s, rows in sent.items() for r in rows], "sub string, id int, prediction string")
    got = {r["sub"]: (r["score"], r["error"]) for r in graders.grade(truth, pred, {"metric": "root_mean_squared_error"}, ["id"], ["sub"]).collect()}
    assert got["good"][0] == pytest.approx(3**0.5) and got["good"][1] is None
    assert {s: e for s, (score, e) in got.items() if score is None} == {"missing": "1 missing", "doubled": "1 doubled", "extra": "1 extra", "text": "1 not_numeric"}


def test_user_code_that_fails_in_a_task(spark):
    data = spark.createDataFrame([(i, float(i), i % 2, "val" if i % 4 == 0 else "train") for i in range(20)], "id int, y double, fold int, role string")

    def broken(train, features):
        return features.withColumn("prediction", F.raise_error(F.lit("no")).cast("double"))

    got = contract.evaluate_submission({"train_and_predict": broken}, data, ["id"], "y", "root_mean_squared_error", 1).collect()
    assert got[0]["score"] is None and not got[0]["success"] and got[0]["error"]


def test_long_numbers(spark):
    rows = spark.createDataFrame([("1 99999999999999999999 x 3",)], "t string")
    assert rows.select(parse_ints(F.col("t")).alias("n")).first()["n"] == [1, 3]


def test_a_repeated_fold_write_leaves_one_copy(spark, tmp_path):
    df = spark.range(100).withColumns({"fold": (F.col("id") % 2).cast("int"), "role": F.lit("train")})
    for _ in range(2):
        folds.write_split(df, str(tmp_path), "c")
        folds.write_folds({"train": df.drop("fold")}, str(tmp_path), "c", 3)
    assert folds.read_fold(spark, str(tmp_path), "c", 1).count() == 50
    assert folds.read_fold(spark, str(tmp_path), "c", 3, "train").count() == 100


def test_indented_result_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n  "submission_id": "s1",\n  "score": 0.5\n}')
    (tmp_path / "b.json").write_text('{"submission_id": ')
    rows = results.read_results(spark, str(tmp_path), indented=True, corrupt="bad").select("submission_id", "score", "bad").collect()
    assert sorted((r["submission_id"] or "", r["score"], r["bad"] is None) for r in rows) == [("", None, False), ("s1", 0.5, True)]


def test_keys_of_submissions_move_once(spark):
    """Keys of predictions are counted in the partitions where they meet the truth's, and the truth's are counted there as well."""
    truth = spark.createDataFrame([(i, 1.0) for i in range(9)], "id int, target double")
    sent = spark.createDataFrame([("a", i, 1.0) for i in range(9)] + [("b", i, 1.0) for i in (0, 0, 4, 11)], "model string, id int, prediction double")
    found = graders._faults(truth, sent, {}, ["id"], ["model"])
    assert {r["_b0"]: r["fault"] for r in found.collect()} == {"a": None, "b": "7 missing, 1 doubled, 1 extra"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]  # of the adaptive plan, what ran
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(model" in line and "id#" in line]
    assert not moved
