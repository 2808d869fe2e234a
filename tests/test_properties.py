"""Invariants over random inputs; each property checks many random tables in one Spark job."""

import math
import random

from pyspark.sql import functions as F

from foldmark.operators import leaderboard as lb
from foldmark.operators import split
from foldmark.operators.metrics import classification as c
from foldmark.operators.metrics import ranking


def tables(seed, n=25):
    """(table, row, truth, score, class, prediction) rows of random tables of random shapes."""
    rng = random.Random(seed)
    rows = []
    for t in range(n):
        levels = rng.choice([1, 2, 5, 1000])
        classes = rng.choice(["ab", "abc", "abcdefg"])
        for i in range(rng.randint(2, 60)):
            rows.append((t, i, rng.randint(0, 1), rng.randint(0, levels) / 3.0, rng.choice(classes), rng.choice(classes)))
    return rows


SCHEMA = "t int, i int, y int, s double, k string, p string"


def by_table(df):
    return {r["t"]: r["score"] for r in df.collect()}


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_auc_is_the_pairwise_share_and_ignores_monotone_maps(spark):
    rows = tables(1)
    df = spark.createDataFrame(rows, SCHEMA)
    got = by_table(c.roc_auc(df, "y", "s", ["t"]))
    mapped = by_table(c.roc_auc(df.withColumn("s", F.col("s") * F.col("s") * 3 + 1), "y", "s", ["t"]))
    for t, part in grouped(rows).items():
        pos, neg = [r[3] for r in part if r[2]], [r[3] for r in part if not r[2]]
        if not pos or not neg:
            assert got[t] is None
            continue
        want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
        assert math.isclose(got[t], want, abs_tol=1e-12) and math.isclose(mapped[t], want, abs_tol=1e-12)


def test_class_scores_against_their_definitions(spark):
    rows = tables(2)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["t"]: r for r in c.class_scores(df, "k", "p", ["t"]).collect()}
    for t, part in grouped(rows).items():
        truth, pred = [r[4] for r in part], [r[5] for r in part]
        labels = sorted(set(truth) | set(pred))
        hit = {k: sum(a == b == k for a, b in zip(truth, pred)) for k in labels}
        f1 = {k: 2 * hit[k] / (truth.count(k) + pred.count(k)) for k in labels}
        assert math.isclose(got[t]["accuracy_score"], sum(hit.values()) / len(part))
        assert math.isclose(got[t]["f1_score_avg_macro"], sum(f1.values()) / len(labels), abs_tol=1e-12)
        assert math.isclose(got[t]["f1_score_avg_weighted"], sum(f1[k] * truth.count(k) for k in labels) / len(part), abs_tol=1e-12)
        assert -1 - 1e-9 <= got[t]["matthews_corrcoef"] <= 1 + 1e-9
        assert 0 <= got[t]["balanced_accuracy"] <= 1


def test_best_threshold_beats_every_other(spark):
    rows = [(t, i, y, (s * 0.37) % 1.0, k, p) for t, i, y, s, k, p in tables(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["t"]: r for r in c.best_f1_threshold(df, "y", "s", ["t"]).collect()}
    for t, part in grouped(rows).items():
        best, at = 0.0, 0.5
        for i in range(80):
            cut = 0.1 + i * 0.01
            tp = sum(r[2] for r in part if r[3] >= cut)
            size = sum(r[3] >= cut for r in part) + sum(r[2] for r in part)
            f1 = 2 * tp / size if size else 0.0
            if f1 > best:
                best, at = f1, cut
        assert math.isclose(got[t]["score"], best, abs_tol=1e-12) and math.isclose(got[t]["threshold"], at, abs_tol=1e-9)


def test_ranking_scores_against_a_loop(spark):
    rng = random.Random(4)
    pred, truth = [], []
    for u in range(60):
        items = [rng.randint(0, 12) for _ in range(rng.randint(0, 25))]
        pred += [(u, item, at) for at, item in enumerate(items)]
        truth += [(u, item) for item in rng.sample(range(13), rng.randint(0, 6))]
    p = spark.createDataFrame(pred, "u int, i int, rank int")
    y = spark.createDataFrame(truth, "u int, i int")
    lists, likes = {}, {}
    for u, item, _ in pred:
        lists.setdefault(u, []).append(item)
    for u, item in truth:
        likes.setdefault(u, []).append(item)

    def at_k(items, liked, k):
        hits = total = 0
        for at, item in enumerate(items[:k], 1):
            if item in liked:
                hits += 1
                total += hits / at
        return total / len(liked)

    def full(items, liked):
        hits = total = 0
        for at, item in enumerate(items, 1):
            if item in liked:
                hits += 1
                total += hits / at
            if hits >= len(liked):
                break
        return total / len(liked)

    def first_only(items, liked, k):
        hits = total = 0
        for at, item in enumerate(items[:k]):
            if item in liked and item not in items[:at]:
                hits += 1
                total += hits / (at + 1)
        return total / min(len(liked), k) if liked else 0.0

    want = sum(at_k(lists.get(u, []), v, 10) for u, v in likes.items()) / len(likes)
    assert math.isclose(ranking.map_at_k(y, p, "u", "i", ["rank"]).first()["score"], want)
    both = [u for u in likes if u in lists]
    want = sum(full(lists[u], likes[u]) for u in both) / len(both)
    assert math.isclose(ranking.map_full_list(y, p, "u", "i", ["rank"]).first()["score"], want)
    want = sum(first_only(v, likes.get(u, []), 100) for u, v in lists.items()) / len(lists)
    assert math.isclose(ranking.map_distinct(y, p, "u", "i", ["rank"]).first()["score"], want)


def test_areas_fall_as_cells_improve(spark):
    rs = [i / 40 for i in range(-4, 60)]
    df = spark.createDataFrame([(r,) for r in rs], "r double")
    rows = df.select("r", *[a.alias(n) for n, a in lb.area_terms(F.col("r")).items()]).orderBy("r").collect()
    for name in ("AUP_std", "AUP_std_grid", "AUP_ln", "AUP_invln"):
        values = [r[name] for r in rows]
        assert all(a >= b - 1e-12 for a, b in zip(values, values[1:])) and 0 <= values[-1] <= values[0] <= 1 + 1e-9


def test_split_does_not_depend_on_order_or_partitions(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"))
    for fn in (
        lambda d: split.stratified_holdout(d, ["id"], ["g"]),
        lambda d: split.stratified_kfold(d, ["id"], ["g"], 4),
        lambda d: split.group_kfold(d, "g", 2, balanced=True),
    ):
        a, b = fn(df), fn(df.orderBy(F.desc("id")).repartition(5))
        assert a.exceptAll(b.select(a.columns)).count() == 0
