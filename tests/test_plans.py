"""Plan shape: what must not happen on a large cluster."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from foldmark.operators import split, windows
from foldmark.operators.metrics import ranking
from foldmark.operators.ordering import positions
from foldmark.session import small_side
from foldmark.tables import table


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.fixture()
def static(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_hash_split_is_map_only(static, tiny):
    text = plan(split.holdout(table(static, tiny, "orders"), ["o_orderkey"]).select("o_orderkey", "role"))
    assert "Exchange" not in text and "ReadSchema: struct<o_orderkey:bigint>" in text


def test_time_split_moves_no_rows(static, tiny):
    events = table(static, tiny, "events").select("event_id", "ts")
    text = plan(split.time_expanding(events, "ts", ["event_id"], 4))
    assert "Exchange" not in text and "Window" not in text


def test_group_limit_before_the_shuffle(static, tiny):
    events = table(static, tiny, "events").select("event_id", "user_id", "value")
    text = plan(windows.top_k(events, ["user_id"], ["-value", "event_id"], 5))
    tree = text.split("\n\n\n")[0]
    assert tree.count("WindowGroupLimit") == 2 and tree.rindex("WindowGroupLimit") > tree.index("Exchange")


def test_hot_groups_are_windowed_in_slices(static, tiny):
    events = table(static, tiny, "events").select("event_id", "user_id", "ts")
    text = plan(positions(events, ["ts", "event_id"], ["user_id"], slices=8))
    assert all("_slice" in l for l in text.splitlines() if "windowspecdefinition(user_id" in l and "ts#" in l)
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text


def test_filters_reach_the_scan(static, tiny):
    late = table(static, tiny, "events").filter(F.col("ts") >= "2024-01-20").select("event_id")
    assert "GreaterThanOrEqual(ts,2024-01-20" in plan(late)
    df = table(static, tiny, "events").filter((F.col("value") > 60) & (F.col("value") < 200)).select("event_id")
    text = plan(df)
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,60.0), LessThan(value,200.0)]" in text
    assert "ReadSchema: struct<event_id:bigint,value:double>" in text


def test_small_side_checks_the_size(static, tiny):
    orders = table(static, tiny, "orders").select("o_orderkey")
    keys = orders.groupBy("o_orderkey").count()
    assert "BroadcastHashJoin" in plan(orders.join(small_side(keys), "o_orderkey"))
    static.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan(orders.join(small_side(keys, max_rows=10), "o_orderkey"))
    finally:
        static.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        static.catalog.clearCache()


def test_map_at_k_keeps_k_rows_per_task(static, tiny):
    events = table(static, tiny, "events").withColumnRenamed("event_type", "item")
    truth = events.select("user_id", "item")
    pred = events.select("user_id", "item", "value", "event_id")
    assert "WindowGroupLimit" in plan(ranking.map_at_k(truth, pred, "user_id", "item", ["-value", "event_id"]))
