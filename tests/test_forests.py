"""Forests fitted by cells against Spark ML's own, on hand-made rows."""

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from foldmark.operators import forests, models


def made(spark, rows=4000):
    """Two features of few values and one that does not matter; the target depends on the first two, unevenly, so that no two splits are equally good."""
    k = F.col("id")
    a, b, c = (k % 7).cast("double"), (F.floor(k / 7) % 5).cast("double"), (F.floor(k / 35) % 3).cast("double")
    return spark.range(rows).select("id", a.alias("a"), b.alias("b"), c.alias("c"), (3 * a * a + 2 * b * b + (k % 11) / 10).alias("y"))


def counted(**kwargs):
    estimator = models.forest(["a", "b", "c"], "y", **kwargs)
    estimator.large = 1
    return estimator


def test_rows_are_counted_where_cells_are_few(spark):
    df = made(spark)
    model = counted(trees=6, depth=5).fit(df)
    assert type(model.stages[-1]) is forests.CountedForestModel and len(model.stages[-1].trees) == 6
    got = models.predict(model, df, ["id", "y"]).collect()
    assert len(got) == 4000
    error = np.sqrt(np.mean([(r["y"] - r["prediction"]) ** 2 for r in got]))
    assert error < np.std([r["y"] for r in got]) / 2
    found = {r["feature"]: r["importance"] for r in models.importances(model, ["a", "b", "c"]).collect()}
    assert abs(sum(found.values()) - 1) < 1e-9 and found["a"] > found["b"] > found["c"] >= 0


def test_a_tree_on_cells_is_the_tree_on_the_rows(spark, monkeypatch):
    """With a draw of one for every row and all features at every node, both see the same sums."""
    monkeypatch.setattr(forests, "BY_BITS", np.ones(1 << 16))
    df = made(spark)
    model = counted(trees=1, depth=4).fit(df)
    plain = RandomForestRegressor(labelCol="y", numTrees=1, bootstrap=False, maxDepth=4)
    want = models._pipeline(["a", "b", "c"], plain).fit(df)
    rows = models.predict(model, df, ["id"]).join(models.predict(want, df, ["id"]).withColumnRenamed("prediction", "other"), "id").collect()
    assert len(rows) == 4000 and all(r["prediction"] == pytest.approx(r["other"], abs=1e-9) for r in rows)
    assert model.stages[-1].featureImportances.toArray() == pytest.approx(want.stages[-1].featureImportances.toArray(), abs=1e-9)


def test_draws_are_poisson():
    draws = forests.poisson(np.random.default_rng(5), 20_000, 50)
    share = np.bincount(draws.ravel().astype(int), minlength=4) / draws.size
    assert share[:4] == pytest.approx([0.36788, 0.36788, 0.18394, 0.06131], abs=2e-3)
    assert draws.mean() == pytest.approx(1, abs=5e-3) and draws.var() == pytest.approx(1, abs=1e-2) and draws.max() >= 7


def test_other_rows_are_fitted_as_they_are(spark):
    df = made(spark, 300)
    assert forests.cuts_of(df, ["a", "b", "c"], "y", 1, 42) is None  # 105 cells
    assert forests.cuts_of(made(spark), ["a", "b", "c"], "y", 1, 42) == [[1, 2, 3, 4, 5, 6], [1, 2, 3, 4], [1, 2]]
    assert type(models.forest(["a", "b", "c"], "y", trees=2, depth=2).fit(df).stages[-1]) is not forests.CountedForestModel
    with pytest.raises(Exception, match="null"):
        counted(trees=2, depth=2).fit(made(spark).withColumn("b", F.when(F.col("id") != 9, F.col("b"))))
    model = counted(trees=2, depth=2).fit(made(spark))
    with pytest.raises(Exception, match="a feature is null or NaN"):
        models.predict(model, df.withColumn("b", F.when(F.col("id") != 9, F.col("b"))), ["id"]).collect()


@pytest.mark.parametrize("validation", [None, "held"])
def test_boosted_trees_on_cells_are_those_on_the_rows(spark, validation):
    """Sums of splits and validation errors are the same, so are rounds and predictions; rows without a mark are in neither part."""
    k = F.col("id")
    df = made(spark).withColumn("y", F.col("y") + (k * 7919 % 101) / 5).withColumn("held", F.when(k % 97 != 0, k % 5 == 1))
    train = df if validation else df.drop("held")
    estimator = models.boosted(["a", "b", "c"], "y", rounds=12, depth=2, validation=validation)
    estimator.large = 1
    model = estimator.fit(train)
    assert type(model.stages[-1]) is forests.CountedBoostModel
    plain = GBTRegressor(labelCol="y", maxIter=12, maxDepth=2, seed=42)
    want = models._pipeline(["a", "b", "c"], plain.setValidationIndicatorCol("held") if validation else plain).fit(train)
    assert len(model.stages[-1].trees) == len(want.stages[-1].trees) == model.stages[-1].getNumTrees
    rows = models.predict(model, df, ["id"]).join(models.predict(want, df, ["id"]).withColumnRenamed("prediction", "other"), "id").collect()
    assert len(rows) == 4000 and all(r["prediction"] == pytest.approx(r["other"], abs=1e-6) for r in rows)
    assert model.stages[-1].featureImportances.toArray() == pytest.approx(want.stages[-1].featureImportances.toArray(), abs=1e-6)


def test_boosted_trees_refuse_odd_rows(spark):
    estimator = models.boosted(["a", "b", "c"], "y", rounds=2, depth=2, validation="held")
    estimator.large = 1
    df = made(spark).withColumn("held", F.col("id") % 5 == 1)
    for row in (9, 11):  # one to fit and one to validate
        with pytest.raises(Exception, match="(?i)null"):
            estimator.fit(df.withColumn("b", F.when(F.col("id") != row, F.col("b"))))
    assert type(models.boosted(["a"], "y", rounds=1, depth=1).fit(df).stages[-1]) is not forests.CountedBoostModel
