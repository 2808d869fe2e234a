"""Ordered operators against pandas, with a hot group, a hot order value and text keys."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from foldmark.operators import ordering
from foldmark.operators.ordering import (
    BRACKET,
    SLICE,
    Key,
    exact_quantiles,
    keys_at,
    lagged,
    not_after,
    positions,
    running,
    with_slices,
)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    n = 3000
    user = np.where(rng.random(n) < 0.5, 1, rng.integers(2, 60, n))
    ts = np.where(rng.random(n) < 0.4, 500, rng.integers(0, 1000, n))
    return pd.DataFrame(
        {
            "id": rng.permutation(n),
            "user": user,
            "ts": ts,
            "name": [f"item-{v:05d}" for v in rng.integers(0, 400, n)],
            "x": rng.integers(0, 50, n).astype(float),
        }
    )


@pytest.mark.parametrize("slices", [1, 8, 40])
def test_positions_per_group(spark, rows, slices):
    df = spark.createDataFrame(rows)
    got = positions(df, ["ts", "id"], ["user"], slices=slices).toPandas().set_index("id")["position"]
    want = rows.sort_values(["ts", "id"]).assign(p=lambda d: d.groupby("user").cumcount() + 1)
    assert (got.sort_index() == want.set_index("id")["p"].sort_index()).all()


def test_missing_keys(spark):
    rows = [(1, "a", 5), (2, "a", None), (3, None, 1), (4, "a", 2), (5, None, None), (6, "b", None)]
    df = spark.createDataFrame(rows, "id int, g string, t int")
    for hot in (1, 5):
        got = {r["id"]: r["position"] for r in positions(df, ["t", "id"], ["g"], slices=hot).collect()}
        assert got == {1: 2, 2: 3, 3: None, 4: 1, 5: None, 6: 1}
        lag = {r["id"]: r["x1"] for r in lagged(df, ["t", "id"], ["g"], "id", 1, "x", slices=hot).collect()}
        assert lag == {1: 4, 2: 1, 3: None, 4: None, 5: None, 6: None}
    for hot in (1, 5):
        whole = {r["id"]: r["position"] for r in positions(df, ["t", "id"], slices=hot).collect()}
        assert whole == {3: 1, 4: 2, 1: 3, 2: 4, 5: 5, 6: 6}
    assert keys_at(df, ["t", "id"], [3, 4, 6])[1] == {3: (5, 1), 4: (None, 2), 6: (None, 6)}


def test_positions_of_the_whole_table(spark, rows):
    df = spark.createDataFrame(rows)
    got = positions(df, [Key("ts", False), Key("id")], slices=16).toPandas().set_index("id")["position"]
    want = rows.sort_values(["ts", "id"], ascending=[False, True]).reset_index(drop=True)
    assert (got.sort_index() == pd.Series(range(1, len(want) + 1), want["id"]).sort_index()).all()


def test_positions_by_text(spark, rows):
    df = spark.createDataFrame(rows)
    got = positions(df, ["name", "id"], slices=16).toPandas().set_index("id")["position"]
    want = rows.sort_values(["name", "id"]).reset_index(drop=True)
    assert (got.sort_index() == pd.Series(range(1, len(want) + 1), want["id"]).sort_index()).all()


def test_running_sum_inclusive_and_before(spark, rows):
    df = spark.createDataFrame(rows)
    ordered = rows.sort_values(["ts", "id"])
    want = ordered.assign(s=ordered.groupby("user")["x"].cumsum()).set_index("id")["s"].sort_index()
    got = running(df, ["ts", "id"], ["user"], sums={"s": df["x"]}, slices=16).toPandas()
    assert np.allclose(got.set_index("id")["s"].sort_index(), want)
    got = running(df, ["ts", "id"], ["user"], sums={"s": df["x"]}, before=True, slices=16).toPandas().set_index("id")
    assert np.allclose((got["s"] + got["x"]).sort_index(), want)


@pytest.mark.parametrize("slices", [1, 8, 40])
def test_lagged_across_slices(spark, rows, slices):
    df = spark.createDataFrame(rows)
    got = lagged(df, ["ts", "id"], ["user"], "x", 3, "lag", slices=slices).toPandas().set_index("id").sort_index()
    ordered = rows.sort_values(["ts", "id"])
    for k in (1, 2, 3):
        want = ordered.assign(w=ordered.groupby("user")["x"].shift(k)).set_index("id")["w"].sort_index()
        assert np.allclose(got[f"lag{k}"].fillna(-1), want.fillna(-1))


def test_keys_at_and_cut(spark, rows):
    df = spark.createDataFrame(rows)
    ordered = rows.sort_values(["ts", "id"]).reset_index(drop=True)
    total, found = keys_at(df, ["ts", "id"], [1, 777, 3000])
    assert total == 3000
    for p in (1, 777, 3000):
        assert found[p] == (ordered.loc[p - 1, "ts"], ordered.loc[p - 1, "id"])
    assert df.filter(not_after(["ts", "id"], found[777])).count() == 777


def test_exact_quantiles(spark, rows):
    df = spark.createDataFrame(rows)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, ["ts", "x"], probs)
    for c in ("ts", "x"):
        assert np.allclose(got[c], rows[c].quantile(probs))


def test_slices_stay_small_under_skew(spark, rows):
    df = spark.createDataFrame(rows)
    biggest = with_slices(df, ["ts", "id"], 32).groupBy(SLICE).count().agg({"count": "max"}).first()[0]
    assert biggest <= 3 * len(rows) / 32


def test_slices_grow_with_the_rows(spark, rows, monkeypatch):
    monkeypatch.setattr(ordering, "SLICE_ROWS", 100)
    sliced = with_slices(spark.createDataFrame(rows), ["ts", "id"])
    sizes = [r["count"] for r in sliced.groupBy(SLICE).count().collect()]
    assert len(sizes) > 20 and max(sizes) < 400 and sum(sizes) == len(rows)
    assert sliced.columns[-1] == SLICE and "_slice" not in sliced.columns[:-1]


@pytest.mark.parametrize("down", [False, True])
def test_nan_and_null_keys(spark, down):
    """Slices follow the window's own order of NaN and NULL, in both directions."""
    rng = np.random.default_rng(3)
    rows = [(i, None if i % 11 == 0 else float("nan") if i % 7 == 0 else float(rng.integers(0, 90))) for i in range(1200)]
    df = spark.createDataFrame(rows, "id int, v double")
    key = Key("v", not down)
    got = {r["id"]: r["position"] for r in positions(df, [key, "id"], slices=8).collect()}
    plain = df.withColumn("p", F.row_number().over(Window.orderBy(key.column(), "id"))).collect()
    assert got == {r["id"]: r["p"] for r in plain}
    total, found = keys_at(df, [key, "id"], [300, 1150], 8)
    for p, bound in found.items():
        assert df.filter(not_after([key, "id"], bound)).count() == p


def test_long_shared_prefixes_are_cut(spark):
    rows = [(i, f"https://www.example.com/a/long/way/{i:06d}" if i else "ftp://x") for i in range(4000)]
    df = spark.createDataFrame(rows, "id int, url string")
    sizes = with_slices(df, ["url", "id"], 16).groupBy(SLICE).count()
    assert sizes.agg({"count": "max"}).first()[0] <= 3 * 4000 / 16
    got = {r["id"]: r["position"] for r in positions(df, ["url", "id"], slices=16).collect()}
    assert got == {i: i + 1 for i in range(4000)}


@pytest.mark.parametrize("width", [BRACKET, 0.05, 0.4])
def test_exact_quantiles_with_ties_nan_and_gaps(spark, width):
    rng = np.random.default_rng(8)
    n = 20_000
    frame = pd.DataFrame(
        {
            "ties": rng.integers(0, 4, n).astype(float), "one": np.full(n, 7.0), "wide": rng.normal(size=n) * 10.0 ** rng.integers(-3, 9, n),
            "few": np.where(rng.random(n) < 0.999, np.nan, rng.random(n)),
        }
    )
    df = spark.createDataFrame(frame).withColumns({"few": F.nullif("few", F.lit(float("nan"))), "none": F.lit(None).cast("double")})
    probs = [0.0, 0.001, 1 / 3, 0.5, 0.75, 1.0]
    got = exact_quantiles(df, ["ties", "one", "wide", "few", "none"], probs, width)
    for c in frame:
        assert np.allclose(got[c], frame[c].quantile(probs)), c
    assert got["none"] == [None] * len(probs)
    odd = df.select(F.when(F.col("one") > 0, F.when(F.rand(1) < 0.5, float("nan")).otherwise(F.col("wide"))).alias("x"))
    low, high = exact_quantiles(odd, ["x"], [0.25, 0.99], width)["x"]
    assert np.isfinite(low) and np.isnan(high)


def test_quantiles_take_two_scans(spark, rows, monkeypatch):
    seen = []
    monkeypatch.setattr(ordering, "materialize", lambda df, label: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or df.cache())
    exact_quantiles(spark.createDataFrame(rows), ["ts", "x"], [0.25, 0.5, 0.75])
    assert len(seen) == 1 and seen[0].count("Aggregate [") == 1 and seen[0].count("LogicalRDD") == 1
