"""Window, sort, limit and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldmark.operators import aggregate, windows
from foldmark.operators.ordering import positions
from foldmark.plans import query
from foldmark.tables import table

ORDER = ["ts", "event_id"]


def events(spark, sf, *cols):
    return table(spark, sf, "events").select("event_id", "user_id", "ts", *cols)


@query(
    "WIN1_running_sum",
    """SELECT event_id, round(sum(value) OVER w, 4) AS value_cumsum, round(sum(value * (event_id % 7)) OVER w, 4) AS area FROM events
       WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
)
def win1(spark, sf):
    out = windows.running_sums(
        events(spark, sf, "value"), ["user_id"], ORDER, {"value_cumsum": "value", "area": "value * (event_id % 7)"}
    )
    return out.select("event_id", F.round("value_cumsum", 4).alias("value_cumsum"), F.round("area", 4).alias("area"))


_LAGS = """SELECT event_id, value, coalesce(lag(value, 1) OVER w, 0) AS value_lag1, coalesce(lag(value, 2) OVER w, 0) AS value_lag2,
  coalesce(lag(value, 3) OVER w, 0) AS value_lag3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""


@query("WIN2_lags", f"SELECT event_id, value_lag1, value_lag2, value_lag3 FROM ({_LAGS})")
def win2(spark, sf):
    return windows.lags(events(spark, sf, "value"), ["user_id"], ORDER, "value", 3).select(
        "event_id", "value_lag1", "value_lag2", "value_lag3"
    )


@query("WIN3_lag_differences", f"SELECT event_id, value - value_lag1 AS value_diff1, value - value_lag2 AS value_diff2 FROM ({_LAGS})")
def win3(spark, sf):
    lagged = windows.lags(events(spark, sf, "value"), ["user_id"], ORDER, "value", 2)
    return windows.lag_differences(lagged, "value", [1, 2]).select("event_id", "value_diff1", "value_diff2")


@query(
    "WIN4_rank_first",
    "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events",
)
def win4(spark, sf):
    df = table(spark, sf, "events").select("event_id", "event_type", "value")
    return windows.rank_in_group(df, ["event_type"], ["-value", "event_id"]).select("event_id", "rank")


@query("WIN5_global_position", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS position FROM events")
def win5(spark, sf):
    return positions(table(spark, sf, "events").select("event_id", "ts"), ORDER).select("event_id", "position")


@query("SRT1_multi_key_sort", "SELECT user_id, event_id, value FROM events")
def srt1(spark, sf):
    df = table(spark, sf, "events").select("user_id", "event_id", "value")
    return df.orderBy("user_id", F.col("value").desc(), "event_id")


@query(
    "TOP1_top_k_per_group",
    """SELECT user_id, event_id, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events)
       WHERE rank <= 5""",
)
def top1(spark, sf):
    df = table(spark, sf, "events").select("user_id", "event_id", "value")
    return windows.top_k(df, ["user_id"], ["-value", "event_id"], 5)


@query("LIM1_top_n", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def lim1(spark, sf):
    return aggregate.top_rows(table(spark, sf, "part").select("p_partkey", "p_retailprice"), ["-p_retailprice", "p_partkey"], 20)


@query(
    "SET2_merge_append",
    """SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, NULL AS supplier FROM customer UNION ALL
       SELECT s_suppkey, s_acctbal, NULL, s_name FROM supplier""",
)
def set2(spark, sf):
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    suppliers = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.col("s_name").alias("supplier")
    )
    return windows.merge_rows(customers, suppliers)


@query(
    "SET4_last_per_key",
    """SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2""",
)
def set4(spark, sf):
    df = table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return windows.last_per_key(df, ["user_id", "event_type"], ORDER).drop("ts")
