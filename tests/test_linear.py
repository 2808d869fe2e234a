"""Fits from sums against refits, groups dealt one by one, and corrections of streamed results against their batch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldmark.operators import encode, linear, models, split
from foldmark.operators import leakage as lk
from foldmark.operators import text as terms
from foldmark.plans import QUERIES, encoders, load_all
from foldmark.session import forget, materialize, scratch, shared_root
from foldmark.streaming import leaderboard


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3)) * [1.0, 50.0, 0.01] + [0.0, 1e4, 3.0]
    y = x @ [2.0, -0.3, 40.0] + rng.normal(size=600)
    rows = [(i, *map(float, x[i]), float(y[i]), int(i % 4)) for i in range(600)]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y double, fold int")


@pytest.mark.parametrize("strength", [0.0, 3.0])
def test_out_of_fold_ridge_equals_the_refits(points, strength):
    got = {r["id"]: r["prediction"] for r in linear.ridge_out_of_fold(points, ["a", "b", "c"], "y", ["id"], "fold", strength).collect()}
    want = models.out_of_fold(points, models.linear(["a", "b", "c"], "y", strength), ["id"], "fold", 4)
    for r in want.collect():
        assert got[r["id"]] == pytest.approx(r["prediction"], rel=1e-6, abs=1e-6)


def test_out_of_fold_ridge_with_gaps(spark, points):
    gaps = points.withColumns({"a": F.when(F.col("id") != 7, F.col("a")), "y": F.when(F.col("id") != 9, F.col("y")), "fold": F.when(F.col("id") != 11, F.col("fold")), "same": F.lit(1.0)})
    out = {r["id"]: r for r in linear.ridge_out_of_fold(gaps, ["a", "b", "same"], "y", ["id"], "fold", keep=["y"]).collect()}
    assert {i for i, r in out.items() if r["prediction"] is None} == {7, 11} and len(out) == 600 and out[9]["prediction"] is not None
    alone = linear.ridge_out_of_fold(points.filter("fold = 1"), ["a"], "y", ["id"], "fold")
    assert alone.filter("prediction is not null").count() == 0
    assert linear.ridge_out_of_fold(points.limit(0), ["a"], "y", ["id"], "fold").count() == 0


def test_out_of_fold_feature_keeps_every_row(points):
    gaps = points.withColumn("fold", F.when(F.col("id") % 50 != 3, F.col("fold")))
    out = models.with_oof_feature(gaps, models.linear(["a", "b"], "y"), ["id"], "fold", 4, "p")
    assert out.columns == [*points.columns, "p"] and out.count() == 600
    assert {r["id"] for r in out.filter("p is null").collect()} == {i for i in range(600) if i % 50 == 3}


def test_moments_are_one_aggregate(spark, points):
    seen = []
    plain = points.groupBy

    class Counted:
        def __getattr__(self, name):
            return getattr(points, name)

        def filter(self, *a):
            seen.append("scan")
            return points.filter(*a)

    linear.fold_moments(Counted(), ["a", "b", "c", "y"], "fold")
    assert seen == ["scan"] and plain is not None


def test_all_labels_take_as_many_scans_as_one(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 2))
    rows = []
    for i in range(800):
        labels = [f"l{k}" for k in range(40) if x[i] @ [np.cos(k), np.sin(k)] + rng.normal() > 0.5]
        rows.append((i, float(x[i, 0]), float(x[i, 1]) * 100, labels if i % 9 else None))
    df = spark.createDataFrame(rows, "id int, a double, b double, labels array<string>")
    names = [f"l{k}" for k in range(40)] + ["never"]
    fits, scans = linear.fit_labels(df, ["a", "b"], "labels", names)
    each = [linear.fit_labels(df, ["a", "b"], "labels", [n])[1] for n in names[:3]]
    assert scans <= max(each) + 3
    for name in ("l0", "l7"):
        one = models.fit_per_label(df.withColumn("labels", F.coalesce("labels", F.array().cast("array<string>"))), ["a", "b"], "labels", [name])[name].stages[-1]
        assert fits[name][1:] == pytest.approx(one.coefficients.toArray(), rel=2e-2, abs=2e-3) and fits[name][0] == pytest.approx(one.intercept, rel=2e-2, abs=2e-2)
    said = {r["id"]: r["labels"] for r in linear.predicted_labels(df, fits, ["a", "b"], ["id"]).collect()}
    assert all("never" not in v for v in said.values()) and said[1] == sorted(said[1])
    assert encode is not None


def one_by_one(sizes, k):
    loads = [0] * k
    for size in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += size
    return loads


def test_groups_dealt_at_once_as_one_by_one(spark):
    rng = np.random.default_rng(3)
    for sizes in ([5], [3, 3, 3, 3], [100, 1, 1, 1, 1, 1], rng.integers(1, 30, 60).tolist(), [1] * 40 + [7] * 9):
        loads = [0] * 4
        for size in sorted(set(sizes), reverse=True):
            loads = [a + n * size for a, n in zip(loads, split._dealt(loads, size, sizes.count(size)))]
        assert loads == one_by_one(sizes, 4)
    sizes = rng.integers(1, 12, 40).tolist()
    rows = [(f"g{i}" if i else None,) for i, n in enumerate(sizes) for _ in range(n)]
    out = split.group_kfold_lightest(spark.createDataFrame(rows, "g string"), "g", 3)
    counts = {r["fold"]: r["count"] for r in out.groupBy("fold").count().collect()}
    assert counts.pop(None) == sizes[0]
    assert sorted(counts.values()) == sorted(one_by_one(sizes[1:], 3))
    assert out.filter("g is not null").groupBy("g").agg(F.count_distinct("fold").alias("n")).filter("n <> 1").count() == 0


def test_spans_are_few_blocks(spark):
    spans = spark.createDataFrame([(1, 10**12), (-5, 70), (64, 127), (9, 9)], "a long, b long")
    rows = spans.select("a", "b", lk.dyadic_blocks(F.col("a"), F.col("b")).alias("blocks")).collect()
    assert max(len(r["blocks"]) for r in rows) <= 80
    for r in rows[1:]:
        lines = [x for _, n in [] for x in ()] + [x for b in r["blocks"] for x in range(b["_number"] << b["_level"], (b["_number"] + 1) << b["_level"])]
        assert sorted(lines) == list(range(r["a"], r["b"] + 1))


@pytest.mark.parametrize("buckets", [4, 1 << 16])
def test_sketched_vocabulary_is_the_exact_one(spark, buckets):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{int(k)}" for k in rng.zipf(1.3, 30) % 900)) for i in range(200)]
    df = spark.createDataFrame(rows, "d int, s string")
    words = terms.tokens(F.col("s"))
    for limit, most in ((20, 0.5), (5_000, 1.0)):
        exact = terms.fit_vocabulary(terms.term_counts(df, "d", words), 200, 2, most, limit)
        found, counts = terms.frequent_terms(df, "d", words, limit, 2, most, buckets)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, exact.collect()))
        assert counts.join(found, "term", "left_semi").count() == terms.term_counts(df, "d", words).join(exact, "term", "left_semi").count()


def test_tfidf_deals_its_texts_in_slices_of_bounded_rows(spark, monkeypatch, tmp_path):
    spark.createDataFrame([(i, f"word{i % 7} other{i % 5}") for i in range(900)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    monkeypatch.setattr(encoders, "TEXTS_PER_TASK", 50, raising=False)
    monkeypatch.setattr(encoders, "materialize", lambda df, label: kept.append(materialize(df, label)) or kept[-1])
    assert QUERIES["TXT4_tfidf"](spark, str(tmp_path)).select("doc_id").distinct().count() == 900
    assert len(kept[0].inputFiles()) >= 900 // 50


def test_corrections_replace_results_in_any_order(spark, tmp_path):
    day = "2024-01-0{} 00:00:00"
    rows = [("s1", "c", "m", "l", "accuracy", 0.5, 0.25, day.format(1)), ("s2", "c", "m", "l", "accuracy", 0.5, 1.0, day.format(1)), ("s3", "c", "x", "l", "rmse", 2.0, None, day.format(1))]
    later = [("s1", "c", "m", "l", "accuracy", 0.5, 0.75, day.format(2)), ("s3", "d", "x", "l", "rmse", 2.0, 4.0, day.format(3)), (None, "c", "m", "l", "rmse", 1.0, 1.0, day.format(3))]
    shape = leaderboard.RUN.replace("received TIMESTAMP", "received STRING")
    for batch in (later, rows, rows):
        spark.createDataFrame(batch, shape).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    for late in (None, "30 days"):
        got = leaderboard.run_corrected(spark, str(tmp_path / "in"), 1, late).collect()
        assert sorted((r["comp"], r["model"], r["runs"], r["passed"], r["mean_score"], round(r["rp"], 6)) for r in got) == [
            ("c", "m", 2, 2, 0.875, round((1.5 + 2.0) / 3, 6)), ("d", "x", 1, 1, 4.0, round(0.5 / 3, 6)),
        ]
    (tmp_path / "none").mkdir()
    assert leaderboard.run_corrected(spark, str(tmp_path / "none")).count() == 0


def test_forgotten_tables_are_gone(spark):
    kept = materialize(spark.range(5), "gone")
    path = kept.inputFiles()[0]
    assert kept.count() == 5
    forget(kept)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def test_a_scope_leaves_nothing_behind(spark, tiny):
    load_all()
    root = shared_root(spark)
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = lambda: {str(f.getPath()) for f in store.listStatus(where)}
    before, cached = names(), spark._jsc.getPersistentRDDs().size()
    for name in ("WIN1_running_sum", "SPL2_stratified_holdout", "TXT4_tfidf", "SRC1_read_csv_smart", "AGG4_describe"):
        with scratch():
            assert QUERIES[name](spark, tiny).count() > 0
    assert names() <= before and spark._jsc.getPersistentRDDs().size() <= cached


def test_grams_are_counted_in_tasks_of_bounded_size(spark):
    names = ["Green  tea", "green tea", None, "", "ab", "aaaaaa", "ж" * 40]
    rows = [(k, n) for k in (1, 2, None) for n in names for _ in range(k or 1)]
    df = spark.createDataFrame(rows, "k LONG, name STRING")
    plain = df.select("k", F.explode(terms.char_ngrams(F.col("name"), 3, 5)).alias("gram")).groupBy("k", "gram").count()
    counted = terms.gram_counts(df, "k", "name", 3, 5, per_task=10)
    assert sorted(map(tuple, counted.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    assert counted.rdd.getNumPartitions() >= 3 * sum(len(n or "") for _, n in rows) // 10  # more grams, more tasks
