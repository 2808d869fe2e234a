"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldmark.operators import joins
from foldmark.plans import query
from foldmark.tables import table


@query(
    "JN1_left_enrich",
    "SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey",
)
def jn1(spark, sf):
    customers = table(spark, sf, "customer").filter("c_acctbal > 0").select(
        F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment"
    )
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return joins.enrich(df, customers, ["o_custkey"]).drop("o_custkey")


@query(
    "JN2_inner_two_keys",
    """WITH p AS (SELECT l_orderkey, l_partkey, avg(l_quantity) AS pred FROM lineitem GROUP BY 1, 2),
       t AS (SELECT l_orderkey, l_partkey, max(l_extendedprice) AS truth FROM lineitem GROUP BY 1, 2)
       SELECT p.l_orderkey, p.l_partkey, round(pred, 6) AS pred, truth FROM p JOIN t USING (l_orderkey, l_partkey)""",
)
def jn2(spark, sf):
    lines = table(spark, sf, "lineitem")
    keys = ["l_orderkey", "l_partkey"]
    pred = lines.groupBy(*keys).agg(F.round(F.avg("l_quantity"), 6).alias("pred"))
    truth = lines.groupBy(*keys).agg(F.max("l_extendedprice").alias("truth"))
    return joins.match(pred, truth, keys)


@query("JN3_semi", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
def jn3(spark, sf):
    used = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return joins.seen_in(table(spark, sf, "part").select("p_partkey", "p_name"), used, ["p_partkey"])


@query("JN4_anti", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def jn4(spark, sf):
    rich = table(spark, sf, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.missing_from(table(spark, sf, "customer").select("c_custkey", "c_name"), rich, ["c_custkey"])


@query(
    "JN5_side_by_side",
    """WITH t AS (SELECT user_id, event_type, CAST(count(*) AS VARCHAR) || ' runs' AS cell FROM events GROUP BY 1, 2)
       SELECT user_id, coalesce(max(cell) FILTER (event_type = 'view'), '') AS view, coalesce(max(cell) FILTER (event_type = 'click'), '') AS click,
       coalesce(max(cell) FILTER (event_type = 'signup'), '') AS signup FROM t GROUP BY 1""",
)
def jn5(spark, sf):
    cells = table(spark, sf, "events").groupBy("user_id", "event_type").agg(
        F.concat(F.count(F.lit(1)).cast("string"), F.lit(" runs")).alias("cell")
    )
    return joins.side_by_side(cells, "user_id", "event_type", "cell", ["view", "click", "signup"])


@query(
    "JN6_pair_by_key",
    """SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, quality, n_chars,
       CASE WHEN l.doc_id IS NULL THEN 'pred_only' WHEN d.doc_id IS NULL THEN 'truth_only' ELSE 'both' END AS pairing
       FROM (SELECT * FROM labels WHERE toxic = 0) l FULL JOIN (SELECT * FROM documents WHERE lang <> 'de') d ON l.doc_id = d.doc_id""",
)
def jn6(spark, sf):
    truth = table(spark, sf, "labels").filter("toxic = 0").select("doc_id", "quality")
    pred = table(spark, sf, "documents").filter("lang <> 'de'").select("doc_id", "n_chars")
    return joins.pair_by_key(truth, pred, ["doc_id"])


@query(
    "JN6_pair_by_position",
    """WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS position FROM orders),
       b AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS position FROM events)
       SELECT position, o_orderkey, event_id FROM a JOIN b USING (position)""",
)
def jn6_position(spark, sf):
    truth = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    pred = table(spark, sf, "events").select("event_id", "ts")
    out = joins.pair_by_position(truth, pred, ["o_orderdate", "o_orderkey"], ["ts", "event_id"])
    return out.select("position", "o_orderkey", "event_id")
