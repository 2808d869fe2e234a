"""Metric queries: predictions are fixed functions of the tables, truths are their columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldmark.operators import split
from foldmark.operators.metrics import classification as c
from foldmark.operators.metrics import graders, multilabel, ranking, registry
from foldmark.operators.metrics import regression as reg
from foldmark.operators.ordering import positions
from foldmark.plans import query
from foldmark.plans.aggregates import RELABELLED, relabelled, scored_docs
from foldmark.plans.splits import LIMIT, draw
from foldmark.tables import table


def nine(df, *cols):
    return df.withColumns({x: F.round(x, 9) for x in cols or ("score",)})


AUC = """CASE WHEN count(*) FILTER ({y} = 1) > 0 AND count(*) FILTER ({y} = 0) > 0 THEN
  (sum(CASE WHEN {y} = 1 THEN avg_rank END) - count(*) FILTER ({y} = 1) * (count(*) FILTER ({y} = 1) + 1) / 2.0)
  / (count(*) FILTER ({y} = 1) * count(*) FILTER ({y} = 0)) END"""

_ENTRY = f"""WITH t AS (SELECT d.doc_id, lang, n_chars, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE {draw('d.doc_id')} < {LIMIT} * 2),
  x AS (SELECT lang, n_chars, quality FROM t UNION ALL SELECT 'all', n_chars, quality FROM t),
  k AS (SELECT lang, quality, rank() OVER w + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS avg_rank FROM x
        WINDOW w AS (PARTITION BY lang ORDER BY n_chars))
  SELECT lang, round({AUC.format(y='quality')}, 9) AS score, count(*) AS n FROM k GROUP BY 1"""


@query("ENTRY_holdout_auc_report", _ENTRY)
def entry_report(spark, sf):
    """Hold out two fifths of the labelled documents and score text length as a quality signal."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    labelled = docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    held = split.holdout(labelled, ["doc_id"], frac=2 * LIMIT / 2**32).filter(F.col("role") == "val")
    both = held.withColumn("lang", F.explode(F.array("lang", F.lit("all"))))
    scores = c.roc_auc(both, "quality", "n_chars", ["lang"])
    sizes = both.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return nine(scores.join(sizes, "lang").select("lang", "score", "n"))


@query("MET1_accuracy", RELABELLED + " SELECT user_id, round(avg(CAST(truth = pred AS INT)), 9) AS score FROM e GROUP BY 1")
def met1(spark, sf):
    return nine(c.accuracy(relabelled(spark, sf), "truth", "pred", ["user_id"]))


@query(
    "MET2_roc_auc",
    f"""WITH k AS (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS avg_rank
       FROM documents JOIN labels USING (doc_id)) SELECT lang, round({AUC.format(y='quality')}, 9) AS score FROM k GROUP BY 1""",
)
def met2(spark, sf):
    return nine(c.roc_auc(scored_docs(spark, sf), "quality", "n_chars", ["lang"]))


@query(
    "MET2_roc_auc_pooled",
    f"""WITH t AS (SELECT l_quantity AS s, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem),
       k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS avg_rank FROM t)
       SELECT round({AUC.format(y='y')}, 9) AS score FROM k""",
)
def met2_pooled(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return nine(c.roc_auc(df, "y", "l_quantity"))


@query(
    "MET3_f1_binary",
    """SELECT lang, round(2.0 * count(*) FILTER (n_chars > 1500 AND quality = 1) / (count(*) FILTER (n_chars > 1500) + count(*) FILTER (quality = 1)), 9) AS score
       FROM documents JOIN labels USING (doc_id) GROUP BY 1""",
)
def met3(spark, sf):
    return nine(c.f1_binary(scored_docs(spark, sf), "quality", "guess", ["lang"]))


_CLASSES = (
    RELABELLED
    + """, g AS (SELECT *, event_id % 4 AS fold FROM e), u AS (SELECT fold, truth AS class FROM g UNION SELECT fold, pred FROM g),
  k AS (SELECT u.fold, u.class, count(*) FILTER (g.truth = u.class) AS t, count(*) FILTER (g.pred = u.class) AS p,
        count(*) FILTER (g.truth = u.class AND g.pred = u.class) AS h FROM u JOIN g ON g.fold = u.fold GROUP BY 1, 2) """
)


def folded(spark, sf):
    return relabelled(spark, sf).withColumn("fold", F.col("event_id") % 4)


@query("MET4_f1_macro", _CLASSES + "SELECT fold, round(avg(2.0 * h / (t + p)), 9) AS score FROM k GROUP BY 1")
def met4(spark, sf):
    return nine(c.f1_macro(folded(spark, sf), "truth", "pred", ["fold"]))


@query("MET4_f1_weighted", _CLASSES + "SELECT fold, round(sum(2.0 * h / (t + p) * t) / sum(t), 9) AS score FROM k GROUP BY 1")
def met4_weighted(spark, sf):
    return nine(c.f1_weighted(folded(spark, sf), "truth", "pred", ["fold"]))


@query("MET5_precision_macro", _CLASSES + "SELECT fold, round(avg(CASE WHEN p > 0 THEN h / p ELSE 0 END), 9) AS score FROM k GROUP BY 1")
def met5_precision(spark, sf):
    return nine(c.precision_macro(folded(spark, sf), "truth", "pred", ["fold"]))


@query("MET5_recall_macro", _CLASSES + "SELECT fold, round(avg(CASE WHEN t > 0 THEN h / t ELSE 0 END), 9) AS score FROM k GROUP BY 1")
def met5_recall(spark, sf):
    return nine(c.recall_macro(folded(spark, sf), "truth", "pred", ["fold"]))


@query("MET6_balanced_accuracy", _CLASSES + "SELECT fold, round(avg(h / t) FILTER (t > 0), 9) AS score FROM k GROUP BY 1")
def met6(spark, sf):
    return nine(c.balanced_accuracy(folded(spark, sf), "truth", "pred", ["fold"]))


@query(
    "MET7_matthews",
    _CLASSES
    + """SELECT fold, round((sum(h) * sum(t) - sum(p * t)) / sqrt((CAST(sum(t) AS DOUBLE) ** 2 - sum(p * p)) * (CAST(sum(t) AS DOUBLE) ** 2 - sum(t * t))), 9) AS score
       FROM k GROUP BY 1""",
)
def met7(spark, sf):
    return nine(c.matthews(folded(spark, sf), "truth", "pred", ["fold"]))


@query(
    "MET8_log_loss",
    """WITH t AS (SELECT lang, quality, n_chars / (n_chars + 800.0) AS p FROM documents JOIN labels USING (doc_id))
       SELECT lang, round(avg(-ln(CASE WHEN quality = 1 THEN p ELSE 1 - p END)), 9) AS score, 0 AS bad_rows FROM t GROUP BY 1""",
)
def met8(spark, sf):
    df = scored_docs(spark, sf).withColumn("p", F.col("n_chars") / (F.col("n_chars") + 800.0))
    return nine(c.log_loss(df, "quality", "p", ["lang"]))


@query(
    "MET8_log_loss_multiclass",
    """WITH t AS (SELECT event_type AS y, CASE event_id % 3 WHEN 0 THEN [0.5, 0.2, 0.1, 0.1, 0.1] WHEN 1 THEN [0.1, 0.3, 0.2, 0.2, 0.2] ELSE [0.0, 0.25, 0.25, 0.25, 0.25] END AS p FROM events),
       q AS (SELECT p[list_position(['click','error','purchase','signup','view'], y)] AS x FROM t)
       SELECT round(avg(-ln(least(greatest(x, 2.220446049250313e-16), 1 - 2.220446049250313e-16))), 9) AS score, 0 AS bad_rows FROM q""",
)
def met8_multiclass(spark, sf):
    def vector(*xs):
        return F.array(*[F.lit(x) for x in xs])

    third = F.col("event_id") % 3
    prob = (
        F.when(third == 0, vector(0.5, 0.2, 0.1, 0.1, 0.1))
        .when(third == 1, vector(0.1, 0.3, 0.2, 0.2, 0.2))
        .otherwise(vector(0.0, 0.25, 0.25, 0.25, 0.25))
    )
    df = table(spark, sf, "events").select("event_type", prob.alias("p"))
    return nine(c.log_loss(df, "event_type", "p", classes=["click", "error", "purchase", "signup", "view"]))


def priced(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        "l_returnflag", "l_linenumber", "l_quantity",
        F.col("l_extendedprice").alias("y"), (q * 1500.0 + 100.0).alias("p"),
        F.col("l_discount").alias("y2"), (F.col("l_tax") * 1.1).alias("p2"),
        (F.col("l_linenumber") * 1.0).alias("y3"), (q / 10.0).alias("p3"),
    )


PRICED = """WITH t AS (SELECT l_returnflag, l_linenumber, l_quantity AS w, l_extendedprice AS y, l_quantity * 1500.0 + 100.0 AS p,
  l_discount AS y2, l_tax * 1.1 AS p2, l_linenumber * 1.0 AS y3, l_quantity / 10.0 AS p3 FROM lineitem) """


@query("MET9_mse", PRICED + "SELECT l_returnflag, round(avg((y - p) * (y - p)), 2) AS score FROM t GROUP BY 1")
def met9_mse(spark, sf):
    return reg.mse(priced(spark, sf), "y", "p", ["l_returnflag"]).withColumn("score", F.round("score", 2))


@query("MET9_rmse", PRICED + "SELECT l_returnflag, round(sqrt(avg((y - p) * (y - p))), 4) AS score FROM t GROUP BY 1")
def met9_rmse(spark, sf):
    return reg.rmse(priced(spark, sf), "y", "p", ["l_returnflag"]).withColumn("score", F.round("score", 4))


@query("MET9_mae", PRICED + "SELECT l_returnflag, round(avg(abs(y - p)), 4) AS score FROM t GROUP BY 1")
def met9_mae(spark, sf):
    return reg.mae(priced(spark, sf), "y", "p", ["l_returnflag"]).withColumn("score", F.round("score", 4))


@query("MET10_r2", PRICED + "SELECT l_returnflag, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 9) AS score FROM t GROUP BY 1")
def met10(spark, sf):
    return nine(reg.r2(priced(spark, sf), "y", "p", ["l_returnflag"]))


@query(
    "MET11_rmsle_multitarget",
    PRICED
    + """SELECT l_returnflag, round((sqrt(avg((ln(1 + y) - ln(1 + p)) ** 2)) + sqrt(avg((ln(1 + y2) - ln(1 + p2)) ** 2)) + sqrt(avg((ln(1 + y3) - ln(1 + p3)) ** 2))) / 3, 9) AS score
       FROM t GROUP BY 1""",
)
def met11(spark, sf):
    return nine(reg.rmsle_multitarget(priced(spark, sf), ["y", "y2", "y3"], ["p", "p2", "p3"], ["l_returnflag"]))


@query(
    "MET12_rmse_multitarget",
    PRICED + "SELECT l_returnflag, round((sqrt(avg((y2 - p2) ** 2)) + sqrt(avg((y3 - p3) ** 2))) / 2, 9) AS score FROM t GROUP BY 1",
)
def met12(spark, sf):
    return nine(reg.rmse_multitarget(priced(spark, sf), ["y2", "y3"], ["p2", "p3"], ["l_returnflag"]))


@query("MET13_wmae", PRICED + "SELECT l_returnflag, round(avg(w * abs(y - p)), 2) AS score FROM t GROUP BY 1")
def met13(spark, sf):
    return reg.wmae(priced(spark, sf), "y", "p", "l_quantity", ["l_returnflag"]).withColumn("score", F.round("score", 2))


@query(
    "MET14_reciprocal_rank",
    """WITH t AS (SELECT user_id, CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 0.5 WHEN 'purchase' THEN 1 / 3.0 ELSE 0 END AS r FROM events)
       SELECT user_id, round(avg(r), 9) AS score FROM t GROUP BY 1""",
)
def met14(spark, sf):
    ranked = F.array(F.lit("view"), F.lit("click"), F.lit("purchase"))
    df = table(spark, sf, "events").select("user_id", "event_type", ranked.alias("ranked"))
    return nine(ranking.mean_reciprocal_rank(df, "event_type", "ranked", ["user_id"], k=2))


_INTERACTIONS = """WITH truth AS (SELECT user_id, day(ts) AS item FROM events WHERE value > 150),
  pred AS (SELECT user_id, day(ts) AS item, max(value % 7) AS score FROM events WHERE user_id % 10 <> 0 GROUP BY 1, 2),
  n AS (SELECT user_id, count(*) AS n FROM truth GROUP BY 1),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item) AS place FROM pred),
  h AS (SELECT r.*, row_number() OVER (PARTITION BY user_id ORDER BY place) AS nth FROM r WHERE {cut} AND (user_id, item) IN (SELECT (user_id, item) FROM truth)) """


def interactions(spark, sf):
    """Truth: days with a high value of the user. Predictions: days of the user by a shuffled value."""
    df = table(spark, sf, "events")
    item = F.dayofmonth("ts")
    truth = df.filter("value > 150").select("user_id", item.alias("item"))
    pred = df.filter("user_id % 10 <> 0").groupBy("user_id", item.alias("item")).agg(
        F.max(F.col("value") % 7).alias("score")
    )
    return truth, pred


ORDER = ["-score", "item"]


@query(
    "MET15_map_at_k",
    _INTERACTIONS.format(cut="place <= 10")
    + """SELECT round(avg(coalesce(s, 0) / n), 9) AS score FROM n LEFT JOIN (SELECT user_id, sum(nth / place) AS s FROM h GROUP BY 1) USING (user_id)""",
)
def met15(spark, sf):
    truth, pred = interactions(spark, sf)
    return nine(ranking.map_at_k(truth, pred, "user_id", "item", ORDER, k=10))


@query(
    "MET16_map_full_list",
    _INTERACTIONS.format(cut="true")
    + """SELECT round(avg(coalesce(s, 0) / n), 9) AS score FROM (SELECT * FROM n WHERE user_id IN (SELECT user_id FROM pred)) n
       LEFT JOIN (SELECT user_id, sum(nth / place) AS s FROM h JOIN n USING (user_id) WHERE nth <= n GROUP BY 1) USING (user_id)""",
)
def met16(spark, sf):
    truth, pred = interactions(spark, sf)
    return nine(ranking.map_full_list(truth, pred, "user_id", "item", ORDER))


@query(
    "MET17_map_distinct",
    """WITH truth AS (SELECT user_id, day(ts) AS item FROM events WHERE value > 250),
       pred AS (SELECT user_id, day(ts) AS item, event_id, value % 7 AS score FROM events),
       n AS (SELECT user_id, least(count(*), 100) AS n FROM truth GROUP BY 1),
       r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS place FROM pred),
       f AS (SELECT user_id, item, min(place) AS place FROM r WHERE place <= 100 GROUP BY 1, 2),
       h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY place) AS nth FROM f WHERE (user_id, item) IN (SELECT (user_id, item) FROM truth)),
       s AS (SELECT user_id, sum(nth / place) AS s FROM h GROUP BY 1)
       SELECT round(avg(coalesce(s / n, 0)), 9) AS score FROM (SELECT DISTINCT user_id FROM pred) LEFT JOIN n USING (user_id) LEFT JOIN s USING (user_id)""",
)
def met17(spark, sf):
    df = table(spark, sf, "events").withColumn("item", F.dayofmonth("ts"))
    truth = df.filter("value > 250").select("user_id", "item")
    pred = df.select("user_id", "item", "event_id", (F.col("value") % 7).alias("score"))
    return nine(ranking.map_distinct(truth, pred, "user_id", "item", ["-score", "event_id"]))


@query(
    "MET18_map3_probabilities",
    """WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
       r AS (SELECT vec_id, label, i, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS rn FROM e)
       SELECT round(sum(CASE WHEN i = label AND rn <= 3 THEN 1.0 / rn ELSE 0 END) / count(DISTINCT vec_id), 9) AS score FROM r""",
)
def met18(spark, sf):
    df = table(spark, sf, "embeddings").select("label", F.col("embedding").alias("p"))
    return nine(ranking.map3_from_probabilities(df, "label", "p"))


_BINARY = """WITH truth AS (SELECT user_id, day(ts) AS item, CAST(max(value) > 100 AS INT) AS liked FROM events GROUP BY 1, 2),
  pred AS (SELECT user_id, day(ts) AS item, max(value % 7) AS score FROM events WHERE event_type <> 'error' GROUP BY 1, 2),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item) <= 5 AS INT) AS call FROM pred),
  m AS (SELECT liked, call FROM r JOIN truth USING (user_id, item)) """


def binary_frames(spark, sf):
    df = table(spark, sf, "events").withColumn("item", F.dayofmonth("ts"))
    truth = df.groupBy("user_id", "item").agg((F.max("value") > 100).cast("int").alias("liked"))
    pred = df.filter("event_type <> 'error'").groupBy("user_id", "item").agg(F.max(F.col("value") % 7).alias("score"))
    return truth, pred


@query(
    "MET19_ranking_as_binary",
    _BINARY + "SELECT round(avg(CAST(liked = call AS INT)), 9) AS score FROM m",
)
def met19(spark, sf):
    truth, pred = binary_frames(spark, sf)
    return nine(ranking.ranking_as_binary(truth, pred, "user_id", "item", "liked", score="score"))


@query(
    "MET19_ranking_as_binary_auc",
    _BINARY
    + f""", k AS (SELECT liked, rank() OVER (ORDER BY call) + (count(*) OVER (PARTITION BY call) - 1) / 2.0 AS avg_rank FROM m)
       SELECT round({AUC.format(y='liked')}, 9) AS score FROM k""",
)
def met19_auc(spark, sf):
    truth, pred = binary_frames(spark, sf)
    return nine(ranking.ranking_as_binary(truth, pred, "user_id", "item", "liked", "roc_auc_score", score="score"))


def labelled_orders(spark, sf):
    """Truth: status and priority. Prediction: another priority, a label unknown to the truth, or nothing."""
    k = F.col("o_orderkey")
    pred = (
        F.when(k % 4 == 0, F.array("o_orderstatus", F.lit("never"), F.lit("5-LOW")))
        .when(k % 4 == 1, F.array(F.lit("1-URGENT"), F.lit("1-URGENT"), F.lit("O")))
        .when(k % 4 == 2, F.array().cast("array<string>"))
        .otherwise(F.array("o_orderstatus", "o_orderpriority"))
    )
    return table(spark, sf, "orders").select(
        "o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("truth"), pred.alias("pred")
    )


_LABELLED = """WITH t AS (SELECT o_orderkey, [o_orderstatus, o_orderpriority] AS a, CASE o_orderkey % 4 WHEN 0 THEN list_distinct([o_orderstatus, '5-LOW'])
  WHEN 1 THEN ['1-URGENT', 'O'] WHEN 2 THEN [] ELSE [o_orderstatus, o_orderpriority] END AS b FROM orders),
  s AS (SELECT len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS h FROM t) """


@query("MET20_f1_samples", _LABELLED + "SELECT round(avg(2.0 * h / (na + nb)), 9) AS score FROM s")
def met20(spark, sf):
    return nine(multilabel.f1_samples(labelled_orders(spark, sf), ["o_orderkey"], "truth", "pred"))


@query("MET21_fbeta_micro", _LABELLED + "SELECT round(5.0 * sum(h) / (4 * sum(na) + sum(nb)), 9) AS score FROM s")
def met21(spark, sf):
    return nine(multilabel.fbeta_micro(labelled_orders(spark, sf), "truth", "pred", beta=2.0))


@query(
    "MET22_rank_format",
    """WITH p AS (SELECT user_id, day(ts) AS item, max(value) - 100 AS third FROM events GROUP BY 1, 2),
       d AS (SELECT min(third) >= 0 AND max(third) <= count(*) AS is_rank FROM p)
       SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN is_rank THEN third ELSE -third END, item) AS place FROM p, d""",
)
def met22(spark, sf):
    pred = table(spark, sf, "events").groupBy("user_id", F.dayofmonth("ts").alias("item")).agg(
        (F.max("value") - 100).alias("third")
    )
    order = ranking.rank_order(pred, "user_id", "item", infer=True)
    return positions(pred, order, ["user_id"], "place").select("user_id", "item", "place")


@query(
    "MET23_best_threshold",
    """WITH t AS (SELECT lang, quality AS y, n_chars / (n_chars + 2000.0) AS p FROM documents JOIN labels USING (doc_id)),
       g AS (SELECT i, 0.1::DOUBLE + i * 0.01::DOUBLE AS th FROM (SELECT unnest(range(80)) AS i)),
       f AS (SELECT lang, i, th, 2.0 * count(*) FILTER (p >= th AND y = 1) / (count(*) FILTER (p >= th) + count(*) FILTER (y = 1)) AS f1 FROM t, g GROUP BY 1, 2, 3),
       b AS (SELECT lang, max(f1) AS best FROM f GROUP BY 1)
       SELECT f.lang, round(min(th), 2) AS threshold, round(best, 9) AS score FROM f JOIN b ON f.lang = b.lang AND f1 = best GROUP BY f.lang, best""",
)
def met23(spark, sf):
    df = scored_docs(spark, sf).withColumn("p", F.col("n_chars") / (F.col("n_chars") + 2000.0))
    return nine(c.best_f1_threshold(df, "quality", "p", ["lang"]))


@query(
    "MET24_dispatch",
    RELABELLED
    + """, x AS (SELECT truth, CASE WHEN event_id % 11 = 0 THEN NULL ELSE pred END AS pred, user_id % 3 AS model FROM e)
       SELECT model, round(avg(CAST(truth = pred AS INT)) FILTER (pred IS NOT NULL), 9) AS score, count(*) FILTER (pred IS NULL) AS bad_rows FROM x GROUP BY 1""",
)
def met24(spark, sf):
    df = relabelled(spark, sf).withColumn("model", F.col("user_id") % 3)
    df = df.withColumn("pred", F.when(F.col("event_id") % 11 != 0, F.col("pred")))
    return nine(registry.score(df, "accuracy_score", "truth", "pred", ["model"]))


@query(
    "MET25_direction",
    """WITH s AS (SELECT event_type, user_id % 4 AS model, avg(value) AS score FROM events GROUP BY 1, 2), b AS (SELECT event_type, avg(value) AS baseline FROM events GROUP BY 1)
       SELECT event_type, model, round((score - baseline) * CASE WHEN event_type IN ('error', 'view') THEN -1 ELSE 1 END, 9) + 0.0 AS gain FROM s JOIN b USING (event_type)""",
)
def met25(spark, sf):
    df = table(spark, sf, "events")
    scores = df.groupBy("event_type", (F.col("user_id") % 4).alias("model")).agg(F.avg("value").alias("score"))
    base = df.groupBy("event_type").agg(F.avg("value").alias("baseline"))
    direction = F.when(F.col("event_type").isin("error", "view"), "minimize").otherwise("maximize")
    gain = registry.improvement(F.col("score"), F.col("baseline"), direction)
    return scores.join(base, "event_type").select("event_type", "model", (F.round(gain, 9) + 0.0).alias("gain"))


@query(
    "MET24_grader_multitarget",
    """SELECT user_id % 4 AS model, round((sqrt(avg((value - event_id % 90) ** 2)) + sqrt(avg((user_id - event_id % 140) ** 2))) / 2, 9) AS score,
       CAST(NULL AS VARCHAR) AS error FROM events GROUP BY 1""",
)
def met24_multitarget(spark, sf):
    df = table(spark, sf, "events")
    truth = df.select("event_id", (F.col("user_id") % 4).alias("model"), F.col("value").alias("a"), F.col("user_id").alias("b"))
    pred = df.select(
        "event_id", (F.col("user_id") % 4).alias("model"), (F.col("event_id") % 90).alias("a"), (F.col("event_id") % 140).alias("b")
    )
    entry = {"grader": "multitarget", "metric": "root_mean_squared_error_multitarget", "target_col": ["a", "b"]}
    return nine(graders.grade(truth, pred, entry, ["event_id"], ["model"]))


@query(
    "MET24_grader_ranking",
    _INTERACTIONS.format(cut="place <= 7")
    + """SELECT round(avg(coalesce(s, 0) / n), 9) AS score, CAST(NULL AS VARCHAR) AS error FROM n LEFT JOIN (SELECT user_id, sum(nth / place) AS s FROM h GROUP BY 1) USING (user_id)""",
)
def met24_ranking(spark, sf):
    truth, pred = interactions(spark, sf)
    liked = truth.withColumn("like", F.lit(1))
    return nine(graders.grade(liked, pred, {"grader": "map_at_k", "map_k": 7}, user="user_id", item="item"))


@query(
    "MET24_grader_multilabel",
    _LABELLED + "SELECT round(avg(2.0 * h / (na + nb)), 9) AS score, CAST(NULL AS VARCHAR) AS error FROM s",
)
def met24_multilabel(spark, sf):
    df = labelled_orders(spark, sf)

    def literal(col):
        quoted = F.transform(col, lambda x: F.concat(F.lit("u'"), x, F.lit("'")))
        return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))

    truth = df.select("o_orderkey", literal("truth").alias("labels"))
    pred = df.select("o_orderkey", literal("pred").alias("prediction"))
    entry = {"grader": "multilabel", "metric": "f1_score_multilabel", "target_col": "labels"}
    return nine(graders.grade(truth, pred, entry, ["o_orderkey"]))


@query(
    "MET24_grader_photo_labels",
    """WITH t AS (SELECT list_distinct([l_linenumber, l_suppkey % 5]) AS a, list_distinct([l_linenumber, l_partkey % 9]) AS b FROM
         (SELECT o_orderkey % 7 AS l_linenumber, o_custkey AS l_suppkey, o_orderkey AS l_partkey FROM orders)),
       s AS (SELECT sum(len(a)) AS na, sum(len(list_filter(b, lambda x: x <= 6))) AS nb, sum(len(list_intersect(a, b))) AS h FROM t)
       SELECT round(2.0 * h / (na + nb), 9) AS score, CAST(NULL AS VARCHAR) AS error FROM s""",
)
def met24_photo(spark, sf):
    df = table(spark, sf, "orders")
    first = (F.col("o_orderkey") % 7).cast("string")
    truth = df.select("o_orderkey", F.concat_ws(" ", first, (F.col("o_custkey") % 5).cast("string")).alias("Labels"))
    pred = df.select("o_orderkey", F.concat_ws("  ", first, (F.col("o_orderkey") % 9).cast("string")).alias("prediction"))
    entry = {"grader": "photo_classification", "target_col": "Labels", "beta": 1.0}
    return nine(graders.grade(truth, pred, entry, ["o_orderkey"]))


#: Grader and metric, with the score of a submission that is right throughout.
KEYED = [
    ("default", "accuracy_score", 1.0), ("default", "root_mean_squared_error", 0.0), ("multitarget", "root_mean_squared_error_multitarget", 0.0),
    ("multilabel", "f1_score_multilabel", 1.0), ("classify_leaves", "accuracy_score", 1.0), ("photo_classification", "fbeta", 1.0), ("sheep_classification", "f1_score", 1.0),
]


@query(
    "MET24_incomplete_submissions",
    f"""WITH g AS (SELECT * FROM (VALUES {', '.join(f"('{g}', '{m}', CAST({s} AS DOUBLE))" for g, m, s in KEYED)}) v(grader, metric, whole)),
       n AS (SELECT count(*) FILTER (event_id % 7 = 0) AS missing, count(*) FILTER (event_id % 11 = 0) AS doubled, count(*) FILTER (event_id % 13 = 0) AS extra, count(*) AS n FROM events),
       m AS (SELECT 'm0' AS model, CAST(NULL AS VARCHAR) AS error UNION ALL SELECT 'm1', missing || ' missing' FROM n UNION ALL SELECT 'm2', doubled || ' doubled' FROM n
         UNION ALL SELECT 'm3', extra || ' extra' FROM n UNION ALL SELECT 'm4', n || ' missing' FROM n
         UNION ALL SELECT 'm5', missing || ' missing, ' || (SELECT count(*) FROM events WHERE event_id % 11 = 0 AND event_id % 7 <> 0) || ' doubled' FROM n)
       SELECT grader, metric, model, CASE WHEN error IS NULL THEN whole END AS score, error FROM g, m""",
)
def met24_incomplete(spark, sf):
    """Complete, with missing, doubled and extra keys, empty, and with several faults at once, for each grader that pairs by key."""
    events = table(spark, sf, "events").select("event_id", "event_type", "value", "user_id")
    k = F.col("event_id")
    doubled = F.array_repeat(F.lit(0), F.when(k % 11 == 0, 2).otherwise(1))
    extra = F.when(k % 13 == 0, F.array(F.lit(0), -k - 1)).otherwise(F.array(F.lit(0)))
    sent = [
        events.withColumn("model", F.lit("m0")), events.filter(k % 7 != 0).withColumn("model", F.lit("m1")),
        events.withColumn("_x", F.explode(doubled)).drop("_x").withColumn("model", F.lit("m2")),
        events.withColumn("_x", F.explode(extra)).withColumn("event_id", F.when(F.col("_x") < 0, F.col("_x")).otherwise(k)).drop("_x").withColumn("model", F.lit("m3")),
        events.filter(k % 7 != 0).withColumn("_x", F.explode(doubled)).drop("_x").withColumn("model", F.lit("m5")),
    ]
    pred = sent[0]
    for part in sent[1:]:
        pred = pred.unionByName(part)
    models = spark.createDataFrame([(f"m{i}",) for i in range(6)], "model STRING")
    numbers = F.concat_ws(" ", (F.col("user_id") % 5).cast("string"), (F.col("user_id") % 3 + 5).cast("string"))
    out = None
    for grader, metric, _ in KEYED:
        entry = {"grader": grader, "metric": metric, "target_col": "t"}
        value = {"multilabel": F.array("event_type"), "photo_classification": numbers, "classify_leaves": F.col("user_id")}.get(grader, F.col("value" if "squared" in metric else "event_type"))
        truth, guess = events.select("event_id", value.alias("t")), pred.select("event_id", "model", value.alias("prediction"))
        if grader == "multitarget":
            entry["target_col"] = ["value", "user_id"]
            truth, guess = events.select("event_id", "value", "user_id"), pred.select("event_id", "model", "value", "user_id")
        line = graders.grade(truth, guess, entry, ["event_id"], ["model"], submissions=models)
        line = line.select(F.lit(grader).alias("grader"), F.lit(metric).alias("metric"), "model", F.round("score", 9).alias("score"), "error")
        out = line if out is None else out.unionByName(line)
    return out
