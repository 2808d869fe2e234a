"""Aggregation and pivot queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldmark.operators import aggregate as agg
from foldmark.plans import query
from foldmark.tables import table

TYPES = ["click", "error", "purchase", "signup", "view"]


def relabelled(spark, sf):
    """Events with a prediction: a third of the rows get a type drawn from the id."""
    wrong = F.element_at(
        F.array(*[F.lit(t) for t in TYPES]), (F.floor(F.col("event_id") / 3) % 5 + 1).cast("int")
    )
    pred = F.when(F.col("event_id") % 3 == 0, wrong).otherwise(F.col("event_type"))
    return table(spark, sf, "events").select(
        "event_id", "user_id", F.col("event_type").alias("truth"), pred.alias("pred"), "value"
    )


RELABELLED = """WITH e AS (SELECT event_id, user_id, event_type AS truth, value, CASE WHEN event_id % 3 = 0
  THEN ['click','error','purchase','signup','view'][(event_id // 3) % 5 + 1] ELSE event_type END AS pred FROM events)"""


@query(
    "AGG1_ordered_list",
    """WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS p FROM events)
       SELECT user_id, CAST((p - 1) // 25 AS INT) AS chunk, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY p) AS items FROM p GROUP BY 1, 2""",
)
def agg1(spark, sf):
    df = table(spark, sf, "events").select("user_id", "event_id", "value")
    out = agg.ranked_chunks(df, ["user_id"], "event_id", ["-value", "event_id"], chunk=25)
    return out.withColumn("items", F.array_join(F.transform("items", lambda x: x.cast("string")), ","))


@query(
    "AGG2_frequency_table",
    "SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 9) AS share FROM events GROUP BY 1",
)
def agg2(spark, sf):
    return agg.frequency_table(table(spark, sf, "events"), "event_type").withColumn("share", F.round("share", 9))


@query(
    "AGG3_frequency_encode",
    """WITH t AS (SELECT o_orderkey, coalesce(CAST(nullif(o_custkey, 7) AS VARCHAR), 'unknown') AS c FROM orders)
       SELECT o_orderkey, n AS cust_freq FROM t JOIN (SELECT c, count(*) AS n FROM t GROUP BY 1) USING (c)""",
)
def agg3(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.nullif("o_custkey", F.lit(7).cast("bigint")).alias("c"))
    return agg.frequency_encode(df, "c", "cust_freq").drop("c")


_DESCRIBE = """SELECT '{c}' AS column_name, CAST(count({c}) AS DOUBLE) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
  min({c}) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75,
  max({c}) AS max FROM lineitem"""


@query("AGG4_describe", " UNION ALL ".join(_DESCRIBE.format(c=c) for c in ("l_quantity", "l_extendedprice", "l_discount")))
def agg4(spark, sf):
    out = agg.describe(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "p25", "p50", "p75")})


@query(
    "AGG5_distinct_counts",
    """SELECT 'user_id' AS column_name, count(DISTINCT user_id) AS n FROM events UNION ALL
       SELECT 'event_type', count(DISTINCT event_type) FROM events""",
)
def agg5(spark, sf):
    return agg.distinct_counts(table(spark, sf, "events"), ["user_id", "event_type"])


@query(
    "AGG6_correlations",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(corr({c}, l_extendedprice), 9) AS correlation FROM lineitem"
        for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")
    ),
)
def agg6(spark, sf):
    out = agg.correlations(
        table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    )
    return out.withColumn("correlation", F.round("correlation", 9))


def scored_docs(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(table(spark, sf, "labels"), "doc_id").withColumn(
        "guess", (F.col("n_chars") > 1500).cast("int")
    )


@query(
    "AGG7_confusion_matrix",
    """SELECT quality AS truth, count(*) FILTER (n_chars <= 1500) AS pred_0, count(*) FILTER (n_chars > 1500) AS pred_1
       FROM documents JOIN labels USING (doc_id) GROUP BY 1""",
)
def agg7(spark, sf):
    return agg.confusion_matrix(scored_docs(spark, sf), "quality", "guess", [0, 1])


@query(
    "AGG8_class_report",
    RELABELLED
    + """, t AS (SELECT truth AS class, count(*) AS support FROM e GROUP BY 1), p AS (SELECT pred AS class, count(*) AS predicted FROM e GROUP BY 1),
       h AS (SELECT truth AS class, count(*) AS hits FROM e WHERE truth = pred GROUP BY 1)
       SELECT class, round(hits / predicted, 9) AS precision, round(hits / support, 9) AS recall, round(2 * hits / (support + predicted), 9) AS f1,
       support, round(hits / support, 9) AS accuracy FROM t JOIN p USING (class) JOIN h USING (class)""",
)
def agg8(spark, sf):
    out = agg.class_report(relabelled(spark, sf), "truth", "pred")
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1", "accuracy")})


@query(
    "AGG9_fold_mean",
    """WITH s AS (SELECT event_type, user_id % 5 AS fold, CASE WHEN event_type = 'error' OR user_id % 5 = 3 THEN NULL ELSE avg(value) END AS score
       FROM events GROUP BY 1, 2)
       SELECT event_type, round(avg(score), 9) AS score, count(*) AS folds, count(score) AS valid_folds, count(score) > 0 AS success FROM s GROUP BY 1""",
)
def agg9(spark, sf):
    fold = F.col("user_id") % 5
    failed = (F.col("event_type") == "error") | (F.col("fold") == 3)
    scores = table(spark, sf, "events").groupBy("event_type", fold.alias("fold")).agg(F.avg("value").alias("score"))
    scores = scores.withColumn("score", F.when(failed, F.lit(float("nan"))).otherwise(F.col("score")))
    return agg.fold_mean(scores, ["event_type"]).withColumn("score", F.round("score", 9))


@query(
    "AGG10_best_row",
    """SELECT l_returnflag, arg_min(l_orderkey, (-l_extendedprice, l_orderkey, l_linenumber)) AS l_orderkey,
       arg_min(l_linenumber, (-l_extendedprice, l_orderkey, l_linenumber)) AS l_linenumber, max(l_extendedprice) AS l_extendedprice
       FROM lineitem GROUP BY 1""",
)
def agg10(spark, sf):
    return agg.best_row(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", ["l_orderkey", "l_linenumber"])


@query(
    "AGG11_mean_std",
    """SELECT event_type, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS std_pop, round(stddev_samp(value), 9) AS std_samp
       FROM events GROUP BY 1""",
)
def agg11(spark, sf):
    out = agg.mean_std(table(spark, sf, "events"), ["event_type"], "value")
    return out.withColumns({c: F.round(c, 9) for c in ("mean", "std_pop", "std_samp")})


@query(
    "PVT1_pivot",
    """SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 2) AS "F", round(sum(l_quantity) FILTER (l_linestatus = 'O'), 2) AS "O"
       FROM lineitem GROUP BY 1""",
)
def pvt1(spark, sf):
    return agg.pivot(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"], F.round(F.sum("l_quantity"), 2))


@query(
    "PVT1_unpivot",
    """SELECT l_returnflag, 'quantity' AS measure, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1 UNION ALL
       SELECT l_returnflag, 'tax', round(sum(l_tax), 2) FROM lineitem GROUP BY 1""",
)
def pvt1_unpivot(spark, sf):
    wide = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum("l_tax"), 2).alias("tax")
    )
    return wide.unpivot("l_returnflag", ["quantity", "tax"], "measure", "total")


@query(
    "PVT2_custom_order",
    """SELECT event_type, count(*) AS n, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END AS row_order
       FROM events GROUP BY 1""",
)
def pvt2(spark, sf):
    counts = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return agg.in_order(counts, "event_type", ["view", "click", "purchase"])
