"""Split queries. Sides and folds come from md5 of the key, which SQL can repeat."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldmark.operators import split
from foldmark.plans import query
from foldmark.tables import table


def draw(key: str) -> str:
    """SQL for the 32-bit hash of a key under seed 42."""
    return f"CAST('0x' || substr(md5('42|' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT)"


LIMIT = int(0.2 * 2**32)


def orders(spark, sf):
    return table(spark, sf, "orders")


def events(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")


@query(
    "SPL1_holdout",
    f"SELECT o_orderkey, CASE WHEN {draw('o_orderkey')} < {LIMIT} THEN 'val' ELSE 'train' END AS role FROM orders",
)
def spl1(spark, sf):
    return split.holdout(orders(spark, sf), ["o_orderkey"]).select("o_orderkey", "role")


@query(
    "SPL1_holdout_exact",
    """SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5('42|' || o_orderkey)) <= ceil(0.2 * count(*) OVER ())
       THEN 'val' ELSE 'train' END AS role FROM orders""",
)
def spl1_exact(spark, sf):
    return split.holdout(orders(spark, sf), ["o_orderkey"], mode="exact").select("o_orderkey", "role")


@query(
    "SPL2_stratified_holdout",
    """SELECT o_orderkey, o_orderstatus, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42|' || o_orderkey))
       <= ceil(0.2 * count(*) OVER (PARTITION BY o_orderstatus)) THEN 'val' ELSE 'train' END AS role FROM orders""",
)
def spl2(spark, sf):
    out = split.stratified_holdout(orders(spark, sf), ["o_orderkey"], ["o_orderstatus"])
    return out.select("o_orderkey", "o_orderstatus", "role")


@query(
    "SPL3_quantile_stratified",
    """WITH q AS (SELECT quantile_cont(o_totalprice, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS b FROM orders),
       t AS (SELECT o_orderkey, len(list_filter(list_distinct(b), lambda e: o_totalprice > e)) AS bin FROM orders, q)
       SELECT o_orderkey, bin, CASE WHEN row_number() OVER (PARTITION BY bin ORDER BY md5('42|' || o_orderkey))
       <= ceil(0.2 * count(*) OVER (PARTITION BY bin)) THEN 'val' ELSE 'train' END AS role FROM t""",
)
def spl3(spark, sf):
    binned = split.quantile_bins(orders(spark, sf).select("o_orderkey", "o_totalprice"), "o_totalprice")
    return split.stratified_holdout(binned, ["o_orderkey"], ["bin"]).drop("o_totalprice")


@query("SPL4_kfold", f"SELECT o_orderkey, {draw('o_orderkey')} % 5 AS fold FROM orders")
def spl4(spark, sf):
    return split.kfold(orders(spark, sf), ["o_orderkey"], 5).select("o_orderkey", "fold")


@query(
    "SPL5_stratified_kfold",
    """SELECT event_id, event_type, (row_number() OVER (PARTITION BY event_type ORDER BY md5('42|' || event_id)) - 1) % 5 AS fold
       FROM events""",
)
def spl5(spark, sf):
    return split.stratified_kfold(events(spark, sf), ["event_id"], ["event_type"], 5).select("event_id", "event_type", "fold")


@query("SPL6_group_kfold", f"SELECT event_id, user_id, {draw('user_id')} % 5 AS fold FROM events")
def spl6(spark, sf):
    return split.group_kfold(events(spark, sf), "user_id", 5).select("event_id", "user_id", "fold")


@query(
    "SPL6_group_kfold_balanced",
    """WITH g AS (SELECT user_id, (row_number() OVER (ORDER BY count(*) DESC, user_id) - 1) % 10 AS turn FROM events GROUP BY 1)
       SELECT event_id, e.user_id, CASE WHEN turn < 5 THEN turn ELSE 9 - turn END AS fold FROM events e JOIN g ON e.user_id = g.user_id""",
)
def spl6_balanced(spark, sf):
    return split.group_kfold(events(spark, sf), "user_id", 5, balanced=True).select("event_id", "user_id", "fold")


@query(
    "SPL6_group_kfold_lightest",
    """WITH RECURSIVE c AS (SELECT CASE WHEN user_id % 10 < 3 THEN 0 WHEN user_id % 10 = 3 THEN user_id % 100 ELSE user_id * 20 + event_id % 20 END AS grp, count(*) AS n FROM events GROUP BY 1),
       g AS (SELECT n, row_number() OVER (ORDER BY n DESC, grp) AS i FROM c),
       s AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS loads, -1 AS fold, 0::BIGINT AS n
         UNION ALL
         SELECT g.i, list_transform([1, 2, 3, 4, 5], lambda f: s.loads[f] + CASE WHEN f = list_position(s.loads, list_min(s.loads)) THEN g.n ELSE 0 END),
           list_position(s.loads, list_min(s.loads)) - 1, g.n FROM s JOIN g ON g.i = s.i + 1)
       SELECT fold::INTEGER AS fold, n AS size, count(*) AS groups FROM s WHERE i > 0 GROUP BY 1, 2""",
)
def spl6_lightest(spark, sf):
    """Skewed groups: one with three tenths of the rows, some of middle size, and many small ones; SQL deals them one by one."""
    user, low = F.col("user_id"), F.col("user_id") % 10
    grp = F.when(low < 3, 0).when(low == 3, user % 100).otherwise(user * 20 + F.col("event_id") % 20)
    df = split.group_kfold_lightest(events(spark, sf).withColumn("grp", grp.cast("bigint")), "grp", 5)
    sizes = df.groupBy("grp", "fold").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("fold", "size").agg(F.count(F.lit(1)).alias("groups"))


@query(
    "SPL7_group_holdout",
    f"SELECT event_id, user_id, CASE WHEN {draw('user_id')} < {LIMIT} THEN 'val' ELSE 'train' END AS role FROM events",
)
def spl7(spark, sf):
    return split.group_holdout(events(spark, sf), "user_id").select("event_id", "user_id", "role")


_FOLDS = """WITH p AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS pos, count(*) OVER () AS n FROM events),
       f AS (SELECT unnest(range(4)) AS fold)
       SELECT event_id, fold, CASE WHEN pos <= {low} THEN 'train' ELSE 'val' END AS role FROM p, f WHERE pos <= {high}"""


@query("SPL8_time_expanding", _FOLDS.format(low="n * (fold + 1) // 5", high="n * (fold + 2) // 5"))
def spl8(spark, sf):
    return split.time_expanding(events(spark, sf), "ts", ["event_id"], 4).select("event_id", "fold", "role")


@query("SPL9_time_series_split", _FOLDS.format(low="n - (4 - fold) * (n // 5)", high="n - (3 - fold) * (n // 5)"))
def spl9(spark, sf):
    return split.time_series_split(events(spark, sf), "ts", ["event_id"], 4).select("event_id", "fold", "role")


@query(
    "SPL10_ordered_holdout",
    """SELECT event_id, CASE WHEN row_number() OVER (ORDER BY ts, event_id) > count(*) OVER () - ceil(0.2 * count(*) OVER ())
       THEN 'val' ELSE 'train' END AS role FROM events""",
)
def spl10(spark, sf):
    return split.ordered_holdout(events(spark, sf), ["ts", "event_id"]).select("event_id", "role")


@query(
    "SPL11_last_period",
    """SELECT o_orderkey, CASE WHEN year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders) THEN 'val' ELSE 'train' END AS role
       FROM orders""",
)
def spl11(spark, sf):
    df = orders(spark, sf).select("o_orderkey", F.year("o_orderdate").alias("year"))
    return split.last_period_holdout(df, "year").drop("year")


@query(
    "SPL12_key_list",
    """SELECT doc_id, lang, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'val' ELSE 'train' END AS role FROM documents""",
)
def spl12(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    chosen, rest = split.key_list_split(docs, "doc_id", table(spark, sf, "labels").select("doc_id"))
    return chosen.withColumn("role", F.lit("val")).unionByName(rest.withColumn("role", F.lit("train")))


@query(
    "SPL13_project_role",
    f"""WITH t AS (SELECT *, CASE WHEN {draw('l_orderkey')} < {LIMIT} THEN 'val' ELSE 'train' END AS role FROM lineitem)
       SELECT 'train' AS part, count(*) AS n, 11 AS n_columns, round(sum(l_quantity), 2) AS total FROM t WHERE role = 'train' UNION ALL
       SELECT 'x_val', count(*), 10, round(sum(l_quantity), 2) FROM t WHERE role = 'val' UNION ALL
       SELECT 'y_val', count(*), 1, round(sum(l_extendedprice), 2) FROM t WHERE role = 'val' UNION ALL
       SELECT 'excluded_train', count(*), 2, round(sum(l_quantity), 2) FROM t WHERE role = 'train' UNION ALL
       SELECT 'excluded_val', count(*), 2, round(sum(l_quantity), 2) FROM t WHERE role = 'val'""",
)
def spl13(spark, sf):
    drawn = split.holdout(table(spark, sf, "lineitem"), ["l_orderkey"])
    parts = split.project_role(drawn, "l_extendedprice", exclude=["l_tax"], weight="l_quantity")
    out = None
    for name, part in parts.items():
        total = "l_extendedprice" if name == "y_val" else "l_quantity"
        line = part.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(total), 2).alias("total")).select(
            F.lit(name).alias("part"), "n", F.lit(len(part.columns)).alias("n_columns"), "total"
        )
        out = line if out is None else out.unionByName(line)
    return out


@query(
    "SPL14_multi_table",
    f"""WITH f AS (SELECT l_partkey, l_suppkey, l_orderkey, CASE WHEN {draw('l_orderkey')} < {LIMIT} THEN 'val' ELSE 'train' END AS side FROM lineitem),
       s AS (SELECT DISTINCT side FROM f)
       SELECT 'facts' AS name, side, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS keys FROM f GROUP BY 2 UNION ALL
       SELECT 'part', side, count(*), CAST(sum(p_partkey) AS BIGINT) FROM part, s WHERE (side, p_partkey) IN (SELECT (side, l_partkey) FROM f) GROUP BY 2 UNION ALL
       SELECT 'supplier', side, count(*), CAST(sum(s_suppkey) AS BIGINT) FROM supplier, s WHERE (side, s_suppkey) IN (SELECT (side, l_suppkey) FROM f) GROUP BY 2 UNION ALL
       SELECT 'orders', side, count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders, s WHERE (side, o_orderkey) IN (SELECT (side, l_orderkey) FROM f) GROUP BY 2 UNION ALL
       SELECT 'order_ids', side, count(*), CAST(sum(id) AS BIGINT) FROM
         (SELECT side, o_orderkey, unnest([o_orderkey, o_orderkey + 1, o_orderkey + 2]) AS id FROM orders, s) x
         WHERE (side, o_orderkey) IN (SELECT (side, l_orderkey) FROM f) AND (side, id) IN (SELECT (side, l_orderkey) FROM f) GROUP BY 2""",
)
def spl14(spark, sf):
    facts = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    key = F.col("o_orderkey")
    parts = split.multi_table_split(
        facts,
        ["l_orderkey"],
        {
            "part": (table(spark, sf, "part").select("p_partkey"), "p_partkey", "l_partkey"),
            "supplier": (table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", "l_suppkey"),
            "orders": (
                orders(spark, sf).select("o_orderkey", F.array(key, key + 1, key + 2).alias("ids")),
                "o_orderkey",
                "l_orderkey",
            ),
        },
        {"orders": [("ids", "l_orderkey")]},
    )
    keys = {"facts": "l_partkey", "part": "p_partkey", "supplier": "s_suppkey", "orders": "o_orderkey"}
    out = None
    for name, part in parts.items():
        base, side = name.rsplit("_", 1)
        pieces = [(base, part.select(F.col(keys[base]).alias("k")))]
        if base == "orders":
            pieces.append(("order_ids", part.select(F.explode("ids").alias("k"))))
        for label, ids in pieces:
            line = ids.agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("keys")).select(
                F.lit(label).alias("name"), F.lit(side).alias("side"), "n", "keys"
            )
            out = line if out is None else out.unionByName(line)
    return out


@query(
    "SPL15_multilabel",
    f"""SELECT o_orderkey, o_orderstatus || '|' || o_orderpriority AS labels,
       CASE WHEN {draw('o_orderkey')} < {LIMIT} THEN 'val' ELSE 'train' END AS role FROM orders""",
)
def spl15(spark, sf):
    literal = F.concat(F.lit("[u'"), F.col("o_orderstatus"), F.lit("', u'"), F.col("o_orderpriority"), F.lit("']"))
    df = orders(spark, sf).select("o_orderkey", literal.alias("labels"))
    out = split.multilabel_holdout(df, ["o_orderkey"], "labels")
    return out.withColumn("labels", F.array_join("labels", "|"))


@query(
    "SPL_registry_by_name",
    f"""SELECT o_orderkey, 0 AS fold, CASE WHEN {draw('o_orderkey')} < {LIMIT} THEN 'val' ELSE 'train' END AS role FROM orders""",
)
def spl_registry(spark, sf):
    return split.split(orders(spark, sf), ["o_orderkey"], "csv").select("o_orderkey", "fold", "role")


@query(
    "SPL_leak_check",
    f"""WITH u AS (SELECT DISTINCT user_id, {draw('user_id')} % 5 AS val FROM events), f AS (SELECT unnest(range(5)) AS fold)
       SELECT fold, count(*) FILTER (WHERE val <> fold) AS train_keys, count(*) FILTER (WHERE val = fold) AS val_keys,
       0 AS shared_keys FROM u, f GROUP BY fold""",
)
def spl_leak_check(spark, sf):
    folds = split.split(events(spark, sf), ["event_id"], "recommendation", n_splits=5, group="user_id")
    return split.leak_report(folds, ["user_id"])


# The same splits with nulls: every such value is one of its own, and null times come last.


@query(
    "SPL2_null_strata",
    """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS s, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 3 END AS c FROM orders)
       SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY s, c ORDER BY md5('42|' || o_orderkey)) <= ceil(0.2 * count(*) OVER (PARTITION BY s, c)) THEN 'val' ELSE 'train' END AS role FROM t""",
)
def spl2_nulls(spark, sf):
    key = F.col("o_orderkey")
    df = orders(spark, sf).select("o_orderkey", F.when(key % 4 != 0, F.col("o_orderstatus")).alias("s"), F.when(key % 3 != 0, F.col("o_custkey") % 3).alias("c"))
    return split.stratified_holdout(df, ["o_orderkey"], ["s", "c"]).select("o_orderkey", "role")


@query(
    "SPL3_null_values",
    """WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice END AS p FROM orders), q AS (SELECT quantile_cont(p, [0.2, 0.4, 0.6, 0.8]) AS b FROM v),
       t AS (SELECT o_orderkey, CASE WHEN p IS NULL THEN -1 ELSE len(list_filter(list_distinct(b), lambda e: p > e)) END AS bin FROM v, q)
       SELECT o_orderkey, bin::INTEGER AS bin, CASE WHEN row_number() OVER (PARTITION BY bin ORDER BY md5('42|' || o_orderkey)) <= ceil(0.2 * count(*) OVER (PARTITION BY bin)) THEN 'val' ELSE 'train' END AS role FROM t""",
)
def spl3_nulls(spark, sf):
    df = orders(spark, sf).select("o_orderkey", F.when(F.col("o_orderkey") % 6 != 0, F.col("o_totalprice")).alias("p"))
    return split.stratified_holdout(split.quantile_bins(df, "p", 5), ["o_orderkey"], ["bin"]).drop("p")


@query(
    "SPL5_null_strata",
    """WITH t AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_type END AS s FROM events)
       SELECT event_id, ((row_number() OVER (PARTITION BY s ORDER BY md5('42|' || event_id)) - 1) % 4)::INTEGER AS fold FROM t""",
)
def spl5_nulls(spark, sf):
    df = events(spark, sf).select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("s"))
    return split.stratified_kfold(df, ["event_id"], ["s"], 4).select("event_id", "fold")


def timed(spark, sf):
    return events(spark, sf).select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("moment"))


_TIMED = """WITH t AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN ts END AS moment FROM events),
       p AS (SELECT event_id, row_number() OVER (ORDER BY moment NULLS LAST, event_id) AS pos, count(*) OVER () AS n FROM t), f AS (SELECT unnest(range(3)) AS fold)"""


@query(
    "SPL8_null_times",
    _TIMED + " SELECT event_id, fold::INTEGER AS fold, CASE WHEN pos <= n * (fold + 1) // 4 THEN 'train' ELSE 'val' END AS role FROM p, f WHERE pos <= n * (fold + 2) // 4",
)
def spl8_nulls(spark, sf):
    return split.time_expanding(timed(spark, sf), "moment", ["event_id"], 3).select("event_id", "fold", "role")


@query(
    "SPL9_null_times",
    _TIMED
    + """ SELECT event_id, fold::INTEGER AS fold, CASE WHEN pos <= n - (3 - fold) * (n // 4) THEN 'train' ELSE 'val' END AS role FROM p, f WHERE pos <= n - (2 - fold) * (n // 4)""",
)
def spl9_nulls(spark, sf):
    return split.time_series_split(timed(spark, sf), "moment", ["event_id"], 3).select("event_id", "fold", "role")


@query("SPL10_null_times", _TIMED + " SELECT event_id, CASE WHEN pos > n - ceil(0.3 * n) THEN 'val' ELSE 'train' END AS role FROM p")
def spl10_nulls(spark, sf):
    return split.ordered_holdout(timed(spark, sf), ["moment", "event_id"], 0.3).select("event_id", "role")
