"""User code and the running leaderboard."""

import json
import os

import pytest
from pyspark.sql import functions as F

from foldmark.operators import contract, split
from foldmark.plans.streaming import result_rows
from foldmark.streaming import leaderboard


def mean_model(df):
    return df.agg(F.avg("y").alias("m")).first()["m"]


def test_submission_forms_and_failures(spark):
    df = spark.range(40).select("id", (F.col("id") % 4).cast("double").alias("y"))
    folds = split.expand_folds(split.kfold(df, ["id"], 2), 2)
    staged = {
        "train": mean_model,
        "prepare_val": lambda state, x: x,
        "predict": lambda state, x: x.select("id", F.lit(state).alias("prediction")),
    }
    single = {"train_and_predict": lambda train, x: x.select("id", F.lit(mean_model(train)).alias("prediction"))}
    a = contract.evaluate_submission(staged, folds, ["id"], "y", "mean_absolute_error", 2).collect()
    b = contract.evaluate_submission(single, folds, ["id"], "y", "mean_absolute_error", 2).collect()
    assert a == b and all(r["success"] and r["unmatched"] == 0 for r in a)

    def broken(train, x):
        if train.filter("id = 0").count():
            raise RuntimeError("no")
        return x.filter("id > 5").select("id", F.lit(0.0).alias("prediction"))

    c = contract.evaluate_submission({"train_and_predict": broken}, folds, ["id"], "y", "mean_absolute_error", 2).collect()
    errors = sorted(r["error"] for r in c)  # one fold raises, the other leaves rows out: neither has a score
    assert errors[0] == "RuntimeError: no" and errors[1].startswith("ValueError") and "without a prediction" in errors[1]
    assert not any(r["success"] for r in c) and all(r["score"] is None for r in c)
    with pytest.raises(ValueError):
        contract.run_submission({"train": mean_model}, df, df)


def test_stream_equals_batch_with_replays(spark, tiny, tmp_path):
    rows = result_rows(spark, tiny)
    path = str(tmp_path / "in")
    rows.repartition(4).write.json(path)
    rows.filter("submission_id LIKE '%3'").write.mode("append").json(path)
    want = {tuple(r[:3]): r for r in leaderboard.totals(rows).collect()}
    for late in (None, "60 days"):
        got = leaderboard.run_available(spark, path, files_per_trigger=2, late=late)
        lines = got.collect()
        assert len(lines) == len(want)
        for r in lines:
            w = want[tuple(r[:3])]
            assert (r["runs"], r["passed"]) == (w["runs"], w["passed"]) and abs(r["rp"] - w["rp"]) < 1e-9


@pytest.mark.parametrize("late", [None, "30 days", "1 day"])
def test_corrections_without_a_call_per_submission(spark, tmp_path, monkeypatch, late):
    """The newest result of a submission counts; with a short ``late``, one that the stream has passed is let go, and late rows do not count."""
    from pyspark.sql import GroupedData

    monkeypatch.setattr(GroupedData, "applyInPandasWithState", None)
    path = tmp_path / "in"
    path.mkdir()

    def add(n, *rows):
        lines = [json.dumps({"submission_id": i, "comp": "c", "model": m, "lang": "l", "metric": "accuracy", "baseline": 2.0, "score": x, "received": t}) for i, m, x, t in rows]
        (path / f"{n}.json").write_text("\n".join(lines))
        os.utime(path / f"{n}.json", (1e9 + n, 1e9 + n))

    add(0, ("a", "m", 1.0, "2024-01-01T00:00:00Z"), ("b", "m", 2.0, "2024-01-01T00:00:00Z"), (None, "m", 9.0, "2024-01-01T00:00:00Z"))
    add(1, ("a", "n", 3.0, "2024-01-01T01:00:00Z"), ("a", "m", 1.0, "2024-01-01T00:00:00Z"), ("d", "m", None, "2024-01-01T02:00:00Z"))
    add(2, ("e", "o", 4.0, "2024-01-09T00:00:00Z"), ("b", "m", 2.0, "2024-01-01T00:00:00Z"))
    add(3, ("f", "o", 4.0, "2024-01-09T01:00:00Z"), ("b", "m", 7.0, "2024-01-01T03:00:00Z"))
    add(4, ("a", "n", 5.0, "2024-01-09T02:00:00Z"))
    add(5, ("a", "n", 6.0, "2024-01-09T03:00:00Z"))
    add(6, ("g", "p", 6.0, None))
    add(7, ("g", "z", 6.0, None))  # no newer: the first written stays, in one batch or in two
    for files in (1, 2) if late != "1 day" else (1,):
        got = {r["model"]: (r["runs"], r["passed"], r["mean_score"], round(r["rp"], 9)) for r in leaderboard.run_corrected(spark, str(path), files, late).collect()}
        assert got.pop("p") == (1, 1, 6.0, 1.0)
    if late == "1 day":  # b's correction comes too late; a was let go
        want = {"m": (2, 1, 2.0, round(1 / 3, 9)), "n": (2, 2, 4.5, 1.5), "o": (2, 2, 4.0, round(4 / 3, 9))}
    else:
        want = {"m": (2, 1, 7.0, round(3.5 / 3, 9)), "n": (1, 1, 6.0, 1.0), "o": (2, 2, 4.0, round(4 / 3, 9))}
    assert got == want
    empty = tmp_path / "none"
    empty.mkdir()
    assert leaderboard.run_corrected(spark, str(empty), late=late).count() == 0


def test_graders(spark):
    from foldmark.operators.metrics.graders import grade

    truth = spark.createDataFrame([(1, "a", 2.0), (2, "b", 1.0), (3, "b", 5.0)], "id int, y string, w double")
    pred = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, prediction string")
    row = grade(truth, pred, {"metric": "accuracy_score", "target_col": "y"}, ["id"]).first()
    assert abs(row["score"] - 2 / 3) < 1e-12 and row["error"] is None
    row = grade(truth, pred, {"grader": "sheep_classification", "metric": "f1_score", "target_col": "y"}, ["id"]).first()
    assert abs(row["score"] - 2 / 3) < 1e-12
    numbers = pred.withColumn("prediction", F.lit(3.0))
    weighted = {"metric": "wmae", "target_col": "w", "weight_col": "w"}
    assert abs(grade(truth, numbers, weighted, ["id"]).first()["score"] - (2 + 2 + 10) / 3) < 1e-12
    broken = grade(truth, pred.drop("prediction"), {"metric": "accuracy_score", "target_col": "y"}, ["id"]).first()
    assert broken["score"] is None and broken["error"]
    for entry in ({"grader": "nobody"}, {"metric": "nothing"}):
        with pytest.raises(ValueError):
            grade(truth, pred, entry, ["id"])


def test_every_load_strategy_gives_the_parts(spark, tmp_path):
    from foldmark.sources import loaders

    df = spark.range(30).select(
        "id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("image"), F.lit("['a', 'b']").alias("target"),
        F.array(F.array(F.array(F.lit(1.0)))).alias("pixels"),
    )
    for name in loaders.LOADERS:
        column = "pixels" if name == "emnist" else "image"
        entry = {"target_col": "target", "image_col": column, "load_strategy": name, "split_strategy": "csv"}
        root = str(tmp_path / name)
        loaders.prepare_folds(df, entry, root, "c", ["id"])
        parts = loaders.load_fold(spark, entry, root, "c", 0)
        assert parts["train"].count() + parts["x_val"].count() == 30 and parts["y_val"].columns == ["target"]
    with pytest.raises(ValueError):
        loaders.load_fold(spark, {"load_strategy": "none"}, root, "c", 0)
