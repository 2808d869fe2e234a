"""Split properties: disjoint, complete, pure by group, ordered in time, stable under copies of a key."""

import pytest
from pyspark.sql import functions as F

from foldmark.operators import split
from foldmark.operators.contract import custom_split


@pytest.fixture(scope="module")
def rows(spark):
    ids = spark.range(1000).select(
        "id",
        F.when(F.col("id") < 400, "hot").otherwise((F.col("id") % 5).cast("string")).alias("cls"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).cast("int").alias("user"),
        (F.col("id") % 97).cast("int").alias("t"),
    )
    return ids.cache()


def sides(df):
    return {r["role"]: r["n"] for r in df.groupBy("role").agg(F.count("*").alias("n")).collect()}


def test_exact_sizes(rows):
    assert sides(split.holdout(rows, ["id"], mode="exact")) == {"val": 200, "train": 800}
    per_class = split.stratified_holdout(rows, ["id"], ["cls"]).groupBy("cls").agg(
        F.count_if(F.col("role") == "val").alias("v"), F.count("*").alias("n")
    )
    assert all(r["v"] == -(-r["n"] // 5) for r in per_class.collect())


def test_hash_holdout_is_close_and_stable(rows):
    first = split.holdout(rows, ["id"])
    assert 150 < sides(first)["val"] < 250
    again = split.holdout(rows.repartition(7), ["id"])
    assert first.exceptAll(again.select(first.columns)).count() == 0


def test_copies_of_a_key_stay_together(rows):
    copies = rows.withColumn("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")))
    for out in (
        split.holdout(copies, ["id"], mode="exact"),
        split.stratified_holdout(copies.withColumn("cls", F.lit("x")), ["id"], ["cls"]),
    ):
        assert split.overlap(out, ["id"]).count() == 0
    folds = split.stratified_kfold(copies.withColumn("cls", F.lit("x")), ["id"], ["cls"], 4)
    assert folds.groupBy("id").agg(F.count_distinct("fold").alias("f")).filter("f > 1").count() == 0
    assert folds.count() == 1000


def test_group_folds(rows):
    for balanced in (False, True):
        out = split.group_kfold(rows, "user", 4, balanced=balanced)
        assert out.count() == 1000
        assert split.overlap(split.expand_folds(out, 4), ["user"]).count() == 0
    assert split.overlap(split.group_holdout(rows, "user"), ["user"]).count() == 0


def test_time_folds_respect_order(rows):
    for out in (split.time_expanding(rows, "t", ["id"], 4), split.time_series_split(rows, "t", ["id"], 4)):
        edges = out.groupBy("fold").agg(
            F.max(F.when(F.col("role") == "train", F.struct("t", "id"))).alias("last"),
            F.min(F.when(F.col("role") == "val", F.struct("t", "id"))).alias("first"),
        )
        lines = edges.collect()
        assert len(lines) == 4 and all(r["last"] < r["first"] for r in lines)


def test_time_folds_stop_when_empty(rows):
    few = rows.limit(2)
    assert split.time_expanding(few, "t", ["id"], 4).filter("role = 'val'").count() <= 2
    assert split.time_expanding(rows, "absent", ["id"], 4).filter("role = 'val'").count() == 1000


def test_ordered_and_last_period(rows):
    assert sides(split.ordered_holdout(rows, ["t", "id"]))["val"] == 200
    assert sides(split.last_period_holdout(rows, "t"))["val"] == rows.filter("t = 96").count()
    assert sides(split.last_period_holdout(rows, "absent", ["t", "id"]))["val"] == 200


def test_projection(rows):
    drawn = split.holdout(rows, ["id"])
    parts = split.project_role(drawn, "cls", exclude=["user"])
    assert parts["x_val"].columns == ["id", "user", "t"] and parts["y_val"].columns == ["cls"]
    assert parts["excluded_val"].columns == ["user"] and "user" in parts["train"].columns
    lean = split.project_role(drawn, "cls", exclude=["user"], drop_excluded=True)
    assert "user" not in lean["train"].columns
    liked = drawn.withColumns({"like": F.lit(1), "dislike": F.lit(0)})
    roles = split.recommendation_roles(liked, ["id", "user"], "like", "dislike")
    assert roles["y_val"].columns == ["id", "user", "like", "dislike"]
    assert roles["x_val"].columns == ["id", "cls", "user", "t"]


def test_strategies(rows):
    with pytest.raises(ValueError):
        split.split(rows, ["id"], "nothing")
    out = split.split(rows, ["id"], "image_folder", n_splits=3, strata=["cls"])
    assert out.filter("role = 'val'").count() == 1000 and out.count() == 3000
    with pytest.raises(ValueError):
        custom_split(rows, lambda df: df.withColumns({"fold": F.lit(0), "role": F.when(F.col("id") < 9, "val").otherwise("train")}), ["user"])
