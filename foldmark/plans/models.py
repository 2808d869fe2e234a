"""Model queries.

Linear and ridge fits have a closed form, which is the oracle. Other fits are checked by what holds for any good one:
their optimality conditions, or rows, errors and importances beside facts that SQL finds in the data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from foldmark.operators import encode, linear, models, split
from foldmark.operators.aggregate import best_row
from foldmark.operators.metrics import registry
from foldmark.plans import query
from foldmark.plans.aggregates import RELABELLED, TYPES, relabelled
from foldmark.plans.splits import draw
from foldmark.tables import table

DIMENSIONS = 64  # of the embeddings
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def lines(spark, sf):
    return table(spark, sf, "lineitem").select(*LINE, "l_quantity", "l_discount", "l_tax", "l_extendedprice")


def labelled_docs(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", "lang", F.log1p("n_chars").alias("size"), F.regexp_count("text", F.lit(r"\d")).cast("double").alias("digits")
    )
    return docs.join(table(spark, sf, "labels"), "doc_id").withColumn("y", F.col("quality").cast("double"))


@query(
    "MDL1_linear_regression",
    "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem",
)
def mdl1(spark, sf):
    fitted = models.linear(["l_quantity"], "l_extendedprice").fit(lines(spark, sf)).stages[-1]
    return spark.createDataFrame(
        [(round(float(fitted.coefficients[0]), 4), round(float(fitted.intercept), 3))], "slope DOUBLE, intercept DOUBLE"
    )


@query("MDL1_ridge_lasso")
def mdl1_penalised(spark, sf):
    df = lines(spark, sf)
    features = ["l_quantity", "l_discount", "l_tax"]
    rows = []
    for name, share in (("ridge", 0.0), ("lasso", 1.0)):
        fitted = models.linear(features, "l_extendedprice", 10.0, share).fit(df).stages[-1]
        rows += [(name, f, float(c)) for f, c in zip(features, fitted.coefficients)]
    return spark.createDataFrame(rows, "model STRING, feature STRING, coefficient DOUBLE")


def _determinant(columns) -> str:
    (a, b, c), (d, e, f), (g, h, i) = columns
    return f"({a} * ({e} * {i} - {f} * {h}) - {d} * ({b} * {i} - {c} * {h}) + {g} * ({b} * {f} - {c} * {e}))"


def _normal_sql(strength: float) -> tuple[str, list[str]]:
    """Sums of the normal equations over three centred features, and the coefficients from them.

    The penalty counts in standard deviations of features and target.
    """
    features, y = ("l_quantity", "l_discount", "l_tax"), "CAST(l_extendedprice AS DOUBLE)"
    sums = [f"covar_pop({a}, {b}) AS c{i}{j}" for i, a in enumerate(features) for j, b in enumerate(features)]
    sums += [f"covar_pop({a}, {y}) AS y{i}" for i, a in enumerate(features)]
    whole = [[f"c{i}{j} * (1 + w)" if i == j else f"c{i}{j}" for i in range(3)] for j in range(3)]
    right = [f"y{i}" for i in range(3)]
    solved = [f"{_determinant([right if k == j else whole[k] for k in range(3)])} / {_determinant(whole)}" for j in range(3)]
    return f"{strength} / stddev_pop({y}) AS w, {', '.join(sums)}", solved


def _ridge_sql(strength: float) -> str:
    sums, solved = _normal_sql(strength)
    rows = [f"SELECT '{feature}' AS feature, round({c}, 2) AS coefficient FROM m" for feature, c in zip(("l_quantity", "l_discount", "l_tax"), solved)]
    return f"WITH m AS (SELECT {sums} FROM lineitem) " + " UNION ALL ".join(rows)


def _ridge_folds_sql(strength: float) -> str:
    sums, solved = _normal_sql(strength)
    means = ", ".join(f"avg({c}) AS a{i}" for i, c in enumerate(("l_quantity", "l_discount", "l_tax", "CAST(l_extendedprice AS DOUBLE)")))
    lines = ", ".join(f"{c} AS b{i}" for i, c in enumerate(solved))
    return f"""WITH l AS (SELECT *, {draw('l_orderkey')} % 4 AS fold FROM lineitem), f AS (SELECT unnest(range(4)) AS out_fold),
       m AS (SELECT out_fold, {means}, {sums} FROM l JOIN f ON l.fold <> f.out_fold GROUP BY 1),
       b AS (SELECT *, {lines} FROM m)
       SELECT l_orderkey, l_linenumber, CAST(fold AS INTEGER) AS fold, l_extendedprice, round(a3 + b0 * (l_quantity - a0) + b1 * (l_discount - a1) + b2 * (l_tax - a2), 3) AS prediction
       FROM l JOIN b ON fold = out_fold"""


@query("MDL1_ridge", _ridge_sql(10.0))
def mdl1_ridge(spark, sf):
    features = ["l_quantity", "l_discount", "l_tax"]
    fitted = models.linear(features, "l_extendedprice", 10.0).fit(lines(spark, sf)).stages[-1]
    rows = [(f, round(float(c), 2)) for f, c in zip(features, fitted.coefficients)]
    return spark.createDataFrame(rows, "feature STRING, coefficient DOUBLE")


@query(
    "MDL2_class_weights",
    "SELECT doc_id, quality, round((SELECT count(*) FROM labels) / (2.0 * count(*) OVER (PARTITION BY quality)), 9) AS weight FROM labels",
)
def mdl2_weights(spark, sf):
    out = models.balanced(table(spark, sf, "labels").select("doc_id", "quality"), "quality")
    return out.select("doc_id", "quality", F.round("weight", 9).alias("weight"))


@query("MDL2_logistic_balanced")
def mdl2(spark, sf):
    df = models.balanced(labelled_docs(spark, sf), "y", "w")
    model = models.logistic(["size", "digits"], "y", "w").fit(df)
    return models.predict(model, df, ["doc_id"])


@query(
    "MDL2_logistic_optimum",
    """WITH d AS (SELECT quality AS y, (SELECT count(*) FROM documents JOIN labels USING (doc_id)) / (2.0 * count(*) OVER (PARTITION BY quality)) AS w
         FROM documents JOIN labels USING (doc_id))
       SELECT count(*) AS n, round(sum(w * y) / sum(w), 3) AS mean_label FROM d""",
)
def mdl2_optimum(spark, sf):
    """At the optimum the free intercept makes the weighted mean probability that of the labels."""
    df = models.balanced(labelled_docs(spark, sf), "y", "w")
    out = models.predict(models.logistic(["size", "digits"], "y", "w").fit(df), df, ["doc_id", "w"])
    mean = F.sum(F.col("w") * F.col("probability")) / F.sum("w")
    return out.agg(F.count(F.lit(1)).alias("n"), F.round(mean, 3).alias("mean_label"))


@query("MDL2_one_vs_rest")
def mdl2_ovr(spark, sf):
    df = table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").cast("double").alias("y"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(DIMENSIONS)]
    )
    model = models.one_vs_rest([f"e{i}" for i in range(DIMENSIONS)], "y").fit(df)
    return model.transform(df).select("vec_id", "prediction")


@query(
    "MDL2_one_vs_rest_facts",
    "SELECT count(*) AS n, count(DISTINCT label) AS classes, true AS known, true AS beats_majority FROM embeddings",
)
def mdl2_ovr_facts(spark, sf):
    """Predictions are classes of the data, and more of them are right than those of the largest class alone."""
    labels = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("double").alias("y"))
    scored = labels.join(mdl2_ovr(spark, sf), "vec_id")
    sizes = labels.groupBy("y").agg(F.count(F.lit(1)).alias("rows"))
    right = scored.groupBy("prediction").agg(F.count(F.lit(1)).alias("given"), F.count_if(F.col("y") == F.col("prediction")).alias("hits"))
    both = sizes.join(right, F.col("y") == F.col("prediction"), "full")
    return both.agg(
        F.sum("rows").alias("n"),
        F.count("y").alias("classes"),
        (F.count_if(F.col("y").isNull()) == 0).alias("known"),
        (F.sum("hits") > F.max("rows")).alias("beats_majority"),
    )


@query("MDL2_per_label_fits")
def mdl2_labels(spark, sf):
    flags = F.array_compact(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic")))
    df = labelled_docs(spark, sf).withColumn("labels", flags)
    vocabulary = encode.fit_vocabulary(df, "labels")
    fitted = models.fit_per_label(df, ["size", "digits"], "labels", vocabulary)
    return models.predict_labels(fitted, df, ["doc_id"]).withColumn("labels", F.array_join("labels", "|"))


def flagged_docs(spark, sf):
    """Documents with flags: good and toxic by label, one per language, and some by number."""
    flags = [F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"), F.concat(F.lit("lang-"), F.col("lang"))]
    flags += [F.when(F.col("doc_id") % k == 0, f"by-{k}") for k in range(2, 9)]
    return labelled_docs(spark, sf).withColumn("labels", F.array_compact(F.array(*flags)))


@query(
    "MDL2_labels_at_once",
    """WITH d AS (SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)),
       f AS (SELECT unnest(list_filter([CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END, 'lang-' || lang]
         || list_transform(range(2, 9), lambda k: CASE WHEN doc_id % k = 0 THEN 'by-' || k END), lambda x: x IS NOT NULL)) AS label FROM d)
       SELECT label, count(*) AS n, 0.5::DOUBLE AS mean_probability, 0.0::DOUBLE AS size_slope, 0.0::DOUBLE AS digits_slope FROM f GROUP BY 1""",
)
def mdl2_at_once(spark, sf):
    """What must hold of every label's fit: the weighted mean probability is that of the balanced labels, and no feature pulls any more."""
    df = flagged_docs(spark, sf)
    features = ["size", "digits"]
    fits, _ = linear.fit_labels(df, features, "labels", encode.fit_vocabulary(df, "labels"))
    rows = linear.label_probabilities(df, fits, features, ["doc_id", "labels", *features]).withColumn("y", F.array_contains("labels", F.col("label")).cast("double"))
    counts = rows.groupBy("label").agg(F.sum("y").alias("has"), F.count(F.lit(1)).alias("rows"))
    rows = rows.join(F.broadcast(counts), "label")  # one row per label
    w = F.when(F.col("y") == 1, F.col("rows") / (2 * F.col("has"))).otherwise(F.col("rows") / (2 * (F.col("rows") - F.col("has"))))
    line = F.create_map(*[x for label, b in fits.items() for x in (F.lit(label), F.array(*[F.lit(float(v)) for v in b]))])
    pull = [F.round(F.sum(w * (F.col("probability") - F.col("y")) * F.col(c)) / F.sum(w) + 1e-4 * F.var_pop(c) * F.first(line[F.col("label")][i]), 5) + 0.0 for i, c in enumerate(features, 1)]
    return rows.groupBy("label").agg(
        F.sum("y").cast("long").alias("n"), F.round(F.sum(w * F.col("probability")) / F.sum(w), 6).alias("mean_probability"), pull[0].alias("size_slope"), pull[1].alias("digits_slope")
    )


@query("MDL3_random_forest")
def mdl3(spark, sf):
    df = split.kfold(lines(spark, sf), LINE, 5)
    model = models.forest(["l_quantity", "l_discount", "l_tax"], "l_extendedprice").fit(df.filter("fold <> 0"))
    scored = models.predict(model, df.filter("fold = 0"), [*LINE, "l_extendedprice"])
    return registry.score(scored, "root_mean_squared_error", "l_extendedprice", "prediction")


@query("MDL4_boosted_trees")
def mdl4(spark, sf):
    df = split.kfold(lines(spark, sf), LINE, 5).withColumn("held", F.col("fold") == 1)
    train = df.filter("fold <> 0")
    model = models.boosted(["l_quantity", "l_discount"], "l_extendedprice", validation="held").fit(train)
    scored = models.predict(model, df.filter("fold = 0"), [*LINE, "l_extendedprice"])
    return registry.score(scored, "root_mean_squared_error", "l_extendedprice", "prediction")


NET = ["l_extendedprice", "l_discount", "l_tax"]  # features of the net price, a target that depends on them
_HELD = draw("concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)")


def net_prices(spark, sf):
    return lines(spark, sf).withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))


@query("MDL3_random_forest_facts", f"SELECT count(*) AS n, true AS close FROM lineitem WHERE {_HELD} % 5 = 0")
def mdl3_facts(spark, sf):
    """Every held-out row has a prediction, and their errors are less than half of those of the held-out mean."""
    df = split.kfold(net_prices(spark, sf), LINE, 5)
    model = models.forest(NET, "net").fit(df.filter("fold <> 0"))
    scored = models.predict(model, df.filter("fold = 0"), ["net"])
    error = F.sqrt(F.avg(F.pow(F.col("net") - F.col("prediction"), 2)))
    return scored.agg(F.count("prediction").alias("n"), (error < F.stddev_pop("net") / 2).alias("close"))


@query("MDL4_boosted_facts", f"SELECT count(*) AS n, true AS close, true AS stopped_early FROM lineitem WHERE {_HELD} % 5 = 0")
def mdl4_facts(spark, sf):
    """Every held-out row has a prediction, their errors are less than half of those of the mean, and the validation rows ended the fit."""
    df = split.kfold(net_prices(spark, sf), LINE, 5).withColumn("held", F.col("fold") == 1)
    model = models.boosted(NET, "net", rounds=30, depth=3, validation="held").fit(df.filter("fold <> 0"))
    scored = models.predict(model, df.filter("fold = 0"), ["net"])
    error = F.sqrt(F.avg(F.pow(F.col("net") - F.col("prediction"), 2)))
    rounds = len(model.stages[-1].trees)
    return scored.agg(F.count("prediction").alias("n"), (error < F.stddev_pop("net") / 2).alias("close"), F.lit(1 <= rounds <= 30).alias("stopped_early"))


@query(
    "MDL4_boosted_classes",
    "SELECT count(*) AS n, count(DISTINCT label) AS classes, true AS known, true AS beats_majority FROM embeddings",
)
def mdl4_classes(spark, sf):
    """Boosted trees of several classes: predictions are classes of the data, and more are right than the largest class alone would give."""
    first = [F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(8)]
    df = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("double").alias("y"), *first)
    model = models.boosted([f"e{i}" for i in range(8)], "y", classify=True, rounds=5, depth=3, classes=3).fit(df)
    scored = models.predict(model, df, ["vec_id", "y"])
    sizes = df.groupBy("y").agg(F.count(F.lit(1)).alias("rows"))
    right = scored.groupBy("prediction").agg(F.count_if(F.col("y") == F.col("prediction")).alias("hits"))
    return sizes.join(right, F.col("y") == F.col("prediction"), "full").agg(
        F.sum("rows").alias("n"), F.count("y").alias("classes"), (F.count_if(F.col("y").isNull()) == 0).alias("known"), (F.sum("hits") > F.max("rows")).alias("beats_majority")
    )


@query(
    "MDL1_lasso_closed_form",
    """WITH m AS (SELECT corr(l_quantity, l_extendedprice) AS r, stddev_pop(CAST(l_extendedprice AS DOUBLE)) AS sy, stddev_pop(CAST(l_quantity AS DOUBLE)) AS sx FROM lineitem),
       s AS (SELECT unnest([10.0, 2000.0, 100000000.0]) AS strength)
       SELECT CAST(strength AS DOUBLE) AS strength, round(CASE WHEN abs(r) > strength / sy THEN sign(r) * (abs(r) - strength / sy) * sy / sx ELSE 0 END, 2) + 0.0 AS coefficient FROM m, s""",
)
def mdl1_lasso(spark, sf):
    """With one feature the lasso is its correlation with the target, shrunk by the penalty in standard deviations of the target."""
    df = lines(spark, sf)
    rows = [(k, round(float(models.linear(["l_quantity"], "l_extendedprice", k, 1.0).fit(df).stages[-1].coefficients[0]), 2) + 0.0) for k in (10.0, 2000.0, 1e8)]
    return spark.createDataFrame(rows, "strength DOUBLE, coefficient DOUBLE")


_FITS = f"""WITH t AS (SELECT o_orderkey, o_totalprice AS y, CAST(o_custkey AS DOUBLE) AS x, {draw('o_orderkey')} % 3 AS fold FROM orders),
  f AS (SELECT i AS fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM t, (SELECT unnest(range(3)) AS i) WHERE fold <> i GROUP BY i),
  p AS (SELECT t.*, a + b * x AS prediction FROM t JOIN f ON t.fold = f.fold) """


def folded_orders(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("y"), F.col("o_custkey").cast("double").alias("x")
    )
    return split.kfold(df, ["o_orderkey"], 3)


@query(
    "MDL5_cross_validation",
    _FITS
    + """, s AS (SELECT fold, sqrt(avg((y - prediction) ** 2)) AS score FROM p GROUP BY 1)
       SELECT fold, round(score, 3) AS score, round(avg(score) OVER (), 3) AS mean_score, round(stddev_pop(score) OVER (), 3) AS std_score FROM s""",
)
def mdl5(spark, sf):
    out = models.cross_validate(
        folded_orders(spark, sf), models.linear(["x"], "y"), ["o_orderkey"], "y", "fold", 3, "root_mean_squared_error"
    )
    return out.withColumns({c: F.round(c, 3) for c in ("score", "mean_score", "std_score")})


@query("MDL6_out_of_fold", _FITS + "SELECT o_orderkey, fold, round(prediction, 2) AS prediction FROM p")
def mdl6(spark, sf):
    out = models.out_of_fold(folded_orders(spark, sf), models.linear(["x"], "y"), ["o_orderkey"], "fold", 3)
    return out.withColumn("prediction", F.round("prediction", 2))


@query("MDL6_ridge_out_of_fold", _ridge_folds_sql(10.0))
def mdl6_ridge(spark, sf):
    df = split.kfold(lines(spark, sf), ["l_orderkey"], 4)
    out = linear.ridge_out_of_fold(
        df, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", ["l_orderkey", "l_linenumber"], "fold", 10.0, keep=["l_extendedprice"]
    )
    return out.withColumn("prediction", F.round("prediction", 3))


@query(
    "MDL6_oof_target_mean",
    f"""WITH t AS (SELECT o_orderkey, o_custkey, o_totalprice, {draw('o_orderkey')} % 5 AS fold FROM orders),
       m AS (SELECT a.o_custkey, a.fold, avg(b.o_totalprice) AS m FROM (SELECT DISTINCT o_custkey, fold FROM t) a JOIN t b ON a.o_custkey = b.o_custkey AND a.fold <> b.fold GROUP BY 1, 2),
       g AS (SELECT a.fold, avg(b.o_totalprice) AS g FROM (SELECT DISTINCT fold FROM t) a JOIN t b ON a.fold <> b.fold GROUP BY 1)
       SELECT o_orderkey, round(coalesce(m, g), 6) AS cust_mean FROM t LEFT JOIN m ON t.o_custkey = m.o_custkey AND t.fold = m.fold JOIN g ON t.fold = g.fold""",
)
def mdl6_mean(spark, sf):
    df = split.kfold(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"], 5)
    out = models.oof_target_mean(df, "o_custkey", "o_totalprice", "fold", "cust_mean")
    return out.select("o_orderkey", F.round("cust_mean", 6).alias("cust_mean"))


@query(
    "MDL6_null_groups",
    f"""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey END AS g, CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END AS y, {draw('o_orderkey')} % 5 AS fold FROM orders),
       c AS (SELECT g, fold, coalesce(sum(y), 0) AS s, count(y) AS n FROM t GROUP BY 1, 2), a AS (SELECT g, sum(s) AS s, sum(n) AS n FROM c GROUP BY 1),
       p AS (SELECT fold, (sum(sum(s)) OVER () - sum(s)) / (sum(sum(n)) OVER () - sum(n)) AS prior FROM c GROUP BY 1)
       SELECT o_orderkey, round(coalesce(CASE WHEN a.n > c.n THEN (a.s - c.s) / (a.n - c.n) END, prior), 5) AS group_mean
       FROM t JOIN c ON t.g IS NOT DISTINCT FROM c.g AND t.fold = c.fold JOIN a ON t.g IS NOT DISTINCT FROM a.g JOIN p ON t.fold = p.fold""",
)
def mdl6_nulls(spark, sf):
    """A null group is a group; null targets count nowhere."""
    key = F.col("o_orderkey")
    df = table(spark, sf, "orders").select("o_orderkey", F.when(key % 9 != 0, F.col("o_custkey")).alias("g"), F.when(key % 13 != 0, F.col("o_totalprice")).alias("y"))
    out = models.oof_target_mean(split.kfold(df, ["o_orderkey"], 5), "g", "y", "fold", "group_mean")
    return out.select("o_orderkey", F.round("group_mean", 5).alias("group_mean"))


def votes(spark, sf):
    """Three predictions per event."""
    types = F.array(*[F.lit(t) for t in TYPES])
    k = F.col("event_id")
    guesses = F.array(
        F.struct(F.lit("a").alias("model"), F.col("event_type").alias("prediction")),
        F.struct(F.lit("b").alias("model"), F.get(types, (k % 5).cast("int")).alias("prediction")),
        F.struct(F.lit("c").alias("model"), F.get(types, (F.floor(k / 5) % 5).cast("int")).alias("prediction")),
    )
    return table(spark, sf, "events").select("event_id", F.explode(guesses).alias("g")).select("event_id", "g.*")


@query(
    "MDL7_majority_vote",
    """WITH v AS (SELECT event_id, unnest([event_type, ['click','error','purchase','signup','view'][event_id % 5 + 1], ['click','error','purchase','signup','view'][(event_id // 5) % 5 + 1]]) AS p FROM events),
       c AS (SELECT event_id, p, count(*) AS n FROM v GROUP BY 1, 2) SELECT event_id, arg_min(p, (-n, p)) AS prediction FROM c GROUP BY 1""",
)
def mdl7(spark, sf):
    return models.majority_vote(votes(spark, sf), ["event_id"])


@query(
    "MDL7_mean_of_best",
    """WITH p AS (SELECT event_id, value AS y, unnest(['a','b','c','d']) AS model, unnest([value + 1, value + event_id % 7, value * 2, 50.0]) AS p FROM events),
       s AS (SELECT model, sqrt(avg((y - p) ** 2)) AS score FROM p GROUP BY 1 ORDER BY score, model LIMIT 2)
       SELECT event_id, round(avg(p), 6) AS prediction FROM p WHERE model IN (SELECT model FROM s) GROUP BY 1""",
)
def mdl7_mean(spark, sf):
    v, k = F.col("value"), F.col("event_id")
    guesses = F.array(
        F.struct(F.lit("a").alias("model"), (v + 1).alias("prediction")),
        F.struct(F.lit("b").alias("model"), (v + k % 7).alias("prediction")),
        F.struct(F.lit("c").alias("model"), (v * 2).alias("prediction")),
        F.struct(F.lit("d").alias("model"), F.lit(50.0).alias("prediction")),
    )
    long = table(spark, sf, "events").select("event_id", "value", F.explode(guesses).alias("g")).select("event_id", "value", "g.*")
    scores = registry.metric_named("root_mean_squared_error")(long, "value", "prediction", ["model"])
    chosen = models.best_models(scores, 2)
    return models.mean_ensemble(long, ["event_id"], chosen).withColumn("prediction", F.round("prediction", 6))


@query(
    "MDL8_threshold_decision",
    "SELECT event_id, CAST(value / (value + 50) >= 0.5 AS INT) AS at_least, CAST(value / (value + 50) > 0.35 AS INT) AS above FROM events",
)
def mdl8(spark, sf):
    p = F.col("value") / (F.col("value") + 50)
    return table(spark, sf, "events").select(
        "event_id", models.decide(p).alias("at_least"), models.decide(p, 0.35, inclusive=False).alias("above")
    )


_COMPARED = (
    RELABELLED
    + """, g AS (SELECT *, user_id % 4 AS model FROM e), u AS (SELECT model, truth AS class FROM g UNION SELECT model, pred FROM g),
  k AS (SELECT u.model, u.class, count(*) FILTER (g.truth = u.class) AS t, count(*) FILTER (g.pred = u.class) AS p, count(*) FILTER (g.truth = u.class AND g.pred = u.class) AS h
        FROM u JOIN g ON g.model = u.model GROUP BY 1, 2),
  m AS (SELECT model, sum(h) / sum(t) AS accuracy_score, avg(2.0 * h / (t + p)) AS f1_score_avg_macro, avg(h / p) AS precision_score_macro FROM k GROUP BY 1) """
)


@query(
    "MDL9_model_comparison",
    _COMPARED
    + """SELECT model, round(accuracy_score, 9) AS accuracy_score, round(f1_score_avg_macro, 9) AS f1_score_avg_macro, round(precision_score_macro, 9) AS precision_score_macro FROM m""",
)
def mdl9(spark, sf):
    df = relabelled(spark, sf).withColumn("model", F.col("user_id") % 4)
    names = ["accuracy_score", "f1_score_avg_macro", "precision_score_macro"]
    out = models.compare_models(df, "truth", "pred", names)
    return out.withColumns({n: F.round(n, 9) for n in names})


@query("MDL9_best_model", _COMPARED + "SELECT model, round(accuracy_score, 9) AS accuracy_score FROM m ORDER BY m.accuracy_score DESC, model LIMIT 1")
def mdl9_best(spark, sf):
    df = relabelled(spark, sf).withColumn("model", F.col("user_id") % 4)
    out = best_row(models.compare_models(df, "truth", "pred", ["accuracy_score"]), [], "accuracy_score", ["model"])
    return out.withColumn("accuracy_score", F.round("accuracy_score", 9))


@query("MDL10_feature_importance")
def mdl10(spark, sf):
    features = ["l_quantity", "l_discount", "l_tax"]
    model = models.forest(features, "l_extendedprice").fit(lines(spark, sf))
    return models.importances(model, features)


@query(
    "MDL10_importance_facts",
    """WITH n AS (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem),
       c AS (SELECT unnest(['l_extendedprice', 'l_discount', 'l_tax']) AS feature, unnest([e, d, t]) AS r
             FROM (SELECT abs(corr(l_extendedprice, net)) AS e, abs(corr(l_discount, net)) AS d, abs(corr(l_tax, net)) AS t FROM n))
       SELECT true AS whole, feature, r = max(r) OVER () AS leads FROM c""",
)
def mdl10_facts(spark, sf):
    """Importances are no less than 0 and sum to 1, and the feature that correlates best with the target leads."""
    found = models.importances(models.forest(NET, "net").fit(net_prices(spark, sf)), NET).collect()  # one row per feature
    values = [r["importance"] for r in found]
    whole = abs(sum(values) - 1) < 1e-9 and min(values) >= 0
    rows = [(whole, r["feature"], r["importance"] == max(values)) for r in found]
    return spark.createDataFrame(rows, "whole BOOLEAN, feature STRING, leads BOOLEAN")
