"""Projection, filter and cleaning queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foldmark.functions import dates, text, values, vectors
from foldmark.operators import clean
from foldmark.plans import query
from foldmark.tables import table


def r(col: Column, digits: int = 6) -> Column:
    return F.round(col, digits)


@query("PRJ1_drop_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def prj1(spark, sf):
    return values.drop_present(table(spark, sf, "orders"), ["o_totalprice", "o_orderdate", "index", "Unnamed: 0"])


@query(
    "PRJ2_select_by_type",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem",
)
def prj2(spark, sf):
    df = table(spark, sf, "lineitem")
    return df.select(values.columns_of_type(df, "number"))


@query("PRJ3_clean_header", "SELECT p_partkey AS id, p_name AS name, p_size FROM part")
def prj3(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_name", "p_size").toDF(" p_partkey", "p_name ", " p_size ")
    return values.clean_header(df, {"p_partkey": "id", "p_name": "name"})


@query(
    "PRJ4_derive_by_prefix",
    """SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS l_quantity,
       l_extendedprice / (l_quantity + 1.0) AS rate_l_extendedprice,
       l_discount / (l_quantity + 1.0) AS rate_l_discount FROM lineitem""",
)
def prj4(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    df = df.withColumnsRenamed({"l_extendedprice": "num_l_extendedprice", "l_discount": "num_l_discount"})
    out = values.derive_by_prefix(df, "num_", lambda c: c / (F.col("l_quantity") + 1.0), "rate_")
    return out.select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        F.col("rate_num_l_extendedprice").alias("rate_l_extendedprice"),
        F.col("rate_num_l_discount").alias("rate_l_discount"),
    )


@query("FLT1_open_range", "SELECT event_id, value FROM events WHERE value > 60 AND value < 200")
def flt1(spark, sf):
    return clean.open_range(table(spark, sf, "events"), "value", 60, 200).select("event_id", "value")


@query(
    "FLT2_null_partition",
    """SELECT CASE WHEN l.quality IS NULL THEN 'unlabelled' ELSE 'labelled' END AS part, d.lang,
       count(*) AS n, CAST(sum(d.n_chars) AS BIGINT) AS chars
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2""",
)
def flt2(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    joined = docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    known, unknown = clean.null_partition(joined, "quality")
    both = known.withColumn("part", F.lit("labelled")).unionByName(unknown.withColumn("part", F.lit("unlabelled")))
    return both.groupBy("part", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("FLT3_drop_null_keys", "SELECT event_id, event_type FROM events WHERE event_type <> 'error'")
def flt3(spark, sf):
    df = table(spark, sf, "events").select(
        "event_id", F.nullif(F.col("event_type"), F.lit("error")).alias("event_type")
    )
    return df.dropna(subset=["event_type"])


@query("FLT4_equality_mask", "SELECT doc_id, quality, toxic FROM labels WHERE toxic = 1")
def flt4(spark, sf):
    return table(spark, sf, "labels").filter(F.col("toxic") == 1)


@query(
    "NUL1_constant_fill",
    """SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'unknown') AS status,
       coalesce(nullif(o_orderpriority, '5-LOW'), '') AS priority,
       coalesce(nullif(o_custkey, 10), -1) AS cust FROM orders""",
)
def nul1(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey",
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"),
        F.nullif("o_custkey", F.lit(10).cast("bigint")).alias("cust"),
    )
    return df.fillna({"status": "unknown", "priority": "", "cust": -1})


@query(
    "NUL2_median_fill",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         nullif(l_quantity, 10) AS q, nullif(l_discount, 0.05) AS d FROM lineitem),
       m AS (SELECT quantile_cont(q, 0.5) AS mq, quantile_cont(d, 0.5) AS md FROM t)
       SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(coalesce(q, mq), 6) AS q,
              round(coalesce(d, md), 6) AS d FROM t, m""",
)
def nul2(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.nullif("l_quantity", F.lit(10.0)).alias("q"),
        F.nullif("l_discount", F.lit(0.05)).alias("d"),
    )
    return clean.fill(df, clean.fit_medians(df, ["q", "d"])).withColumns({"q": r(F.col("q")), "d": r(F.col("d"))})


@query(
    "NUL3_mode_fill",
    """WITH t AS (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS p,
         nullif(o_orderstatus, 'O') AS s FROM orders),
       mp AS (SELECT p FROM t WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p LIMIT 1),
       ms AS (SELECT s FROM t WHERE s IS NOT NULL GROUP BY s ORDER BY count(*) DESC, s LIMIT 1)
       SELECT o_orderkey, coalesce(t.p, mp.p) AS p, coalesce(t.s, ms.s) AS s FROM t, mp, ms""",
)
def nul3(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey",
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"),
        F.nullif("o_orderstatus", F.lit("O")).alias("s"),
    )
    return clean.fill(df, clean.fit_modes(df, ["p", "s"]))


@query(
    "NUL4_missing_counts",
    """WITH t AS (SELECT nullif(event_type, 'view') AS event_type,
         CASE WHEN value > 100 THEN value END AS value, nullif(user_id, 5) AS user_id FROM events)
       SELECT 'event_type' AS column_name, count(*) - count(event_type) AS missing FROM t UNION ALL
       SELECT 'value', count(*) - count(value) FROM t UNION ALL
       SELECT 'user_id', count(*) - count(user_id) FROM t""",
)
def nul4(spark, sf):
    df = table(spark, sf, "events").select(
        F.nullif("event_type", F.lit("view")).alias("event_type"),
        F.when(F.col("value") > 100, F.col("value")).alias("value"),
        F.nullif("user_id", F.lit(5).cast("bigint")).alias("user_id"),
    )
    return clean.missing_counts(df)


@query(
    "CST1_coerce",
    """SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS number,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE epoch_us(ts) END AS micros FROM events""",
)
def cst1(spark, sf):
    df = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("event_id").cast("string")).alias("number"),
        F.when(F.col("event_id") % 5 == 0, "no date").otherwise(F.col("ts").cast("string")).alias("at"),
    )
    return df.select(
        "event_id",
        values.as_number(F.col("number")).alias("number"),
        F.unix_micros(values.as_timestamp(F.col("at"))).alias("micros"),
    )


@query(
    "MAP1_value_map",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS code,
       coalesce(CASE o_orderpriority WHEN '1-URGENT' THEN 1 END, 0) AS urgent FROM orders""",
)
def map1(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        values.recode(F.col("o_orderstatus"), {"F": 0, "O": 1}).alias("code"),
        values.recode(F.col("o_orderpriority"), {"1-URGENT": 1}, F.lit(0)).alias("urgent"),
    )


@query(
    "MAP2_map_with_fallback",
    """SELECT c_custkey, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS nation
       FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) ON c_nationkey = n_nationkey""",
)
def map2(spark, sf):
    mapping = table(spark, sf, "nation").filter("n_nationkey % 4 <> 0").select(
        F.col("n_nationkey").cast("string").alias("source"), F.col("n_name").alias("target")
    )
    df = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"))
    return clean.map_with_fallback(df, "nation", mapping)


@query(
    "MTH1_log_exp_round",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(ln(1 + l_quantity), 6) AS logged,
       greatest(round_even(exp(l_discount * 10) - 1, 0), 0.0) AS counted,
       CAST(round_even(l_quantity / 4, 0) AS DOUBLE) AS halves FROM lineitem""",
)
def mth1(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        r(F.log1p("l_quantity")).alias("logged"),
        values.unlog_count(F.col("l_discount") * 10).alias("counted"),
        values.half_even(F.col("l_quantity") / 4).alias("halves"),
    )


@query(
    "MTH2_ratios",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / (l_quantity + 1e-6), 6) AS per_unit,
       round(l_discount / (l_tax + 1.0), 6) AS plus_one,
       round(CASE WHEN l_tax > 0 THEN l_discount / l_tax ELSE 0 END, 6) AS guarded FROM lineitem""",
)
def mth2(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        r(values.ratio(F.col("l_extendedprice"), F.col("l_quantity"), 1e-6)).alias("per_unit"),
        r(values.ratio(F.col("l_discount"), F.col("l_tax"), 1.0)).alias("plus_one"),
        r(values.guarded_ratio(F.col("l_discount"), F.col("l_tax"))).alias("guarded"),
    )


@query(
    "MTH3_interactions",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(l_discount - l_tax, 6) + 0.0 AS difference,
       round(l_quantity * l_discount, 6) AS product, round(l_quantity * l_quantity, 6) AS squared,
       round(l_quantity * (l_linenumber + 1), 6) AS weighted FROM lineitem""",
)
def mth3(spark, sf):
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        (r(d - t) + 0.0).alias("difference"),
        r(q * d).alias("product"),
        r(q * q).alias("squared"),
        r(q * (F.col("l_linenumber") + 1)).alias("weighted"),
    )


@query(
    "MTH4_indicators",
    """SELECT c_custkey, CAST(c_acctbal > 5000 AS INT) AS rich, CAST(c_mktsegment = 'BUILDING' AS INT) AS building,
       CAST(c_acctbal > 0 AND c_acctbal < 1000 AS INT) AS middle,
       CAST(c_acctbal > 5000 AS INT) + CAST(c_mktsegment = 'BUILDING' AS INT) + CAST(c_nationkey > 10 AS INT) AS score
       FROM customer""",
)
def mth4(spark, sf):
    bal = F.col("c_acctbal")
    rich, building, far = bal > 5000, F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey") > 10
    return table(spark, sf, "customer").select(
        "c_custkey",
        values.flag(rich).alias("rich"),
        values.flag(building).alias("building"),
        values.flag((bal > 0) & (bal < 1000)).alias("middle"),
        values.flag_sum(rich, building, far).alias("score"),
    )


@query(
    "MTH5_haversine",
    """WITH t AS (SELECT event_id, (event_id % 180) - 90.0 AS lat1, (user_id % 360) - 180.0 AS lon1,
         value / 10.0 AS lat2, value / 3.0 AS lon2 FROM events),
       h AS (SELECT event_id, power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) *
         power(sin(radians(lon2 - lon1) / 2), 2) AS a FROM t)
       SELECT event_id, round(2 * atan2(sqrt(a), sqrt(1 - a)) * 6371 * 1000, 3) AS metres FROM h""",
)
def mth5(spark, sf):
    df = table(spark, sf, "events").select(
        "event_id",
        ((F.col("event_id") % 180).cast("double") - 90.0).alias("lat1"),
        ((F.col("user_id") % 360).cast("double") - 180.0).alias("lon1"),
        (F.col("value") / 10.0).alias("lat2"),
        (F.col("value") / 3.0).alias("lon2"),
    )
    metres = values.haversine_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return df.select("event_id", r(metres, 3).alias("metres"))


@query(
    "MTH6_rescale",
    """SELECT vec_id, pos - 1 AS pos, round(CAST(x AS DOUBLE) / 255, 9) AS x FROM
       (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)""",
)
def mth6(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", vectors.rescale(F.col("embedding"), 255).alias("v"))
    return df.select("vec_id", F.posexplode("v").alias("pos", "x")).withColumns(
        {"x": F.round("x", 9), "pos": F.col("pos").cast("bigint")}
    )


@query(
    "MTH7_age",
    """SELECT o_orderkey, 2024 - year(o_orderdate) AS fixed_age,
       (SELECT max(year(o_orderdate)) + 1 FROM orders) - year(o_orderdate) AS data_age FROM orders""",
)
def mth7(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    return clean.age(clean.age(df, "year", "fixed_age", reference=2024), "year", "data_age").drop("year")


@query(
    "DAT1_date_parts",
    """SELECT event_id, year(ts) AS at_year, month(ts) AS at_month, day(ts) AS at_day, hour(ts) AS at_hour,
       isodow(ts) - 1 AS at_weekday FROM events""",
)
def dat1(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", *[c.alias(n) for n, c in dates.date_parts(F.col("ts"), "at").items()]
    )


@query(
    "DAT2_unix_seconds",
    """WITH t AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE epoch_us(ts) // 1000000 END AS s FROM events)
       SELECT event_id, coalesce(year(make_timestamp(s * 1000000)), 2010) AS at_year,
       coalesce(month(make_timestamp(s * 1000000)), 6) AS at_month,
       coalesce(isodow(make_timestamp(s * 1000000)) - 1, 0) AS at_weekday,
       coalesce(hour(make_timestamp(s * 1000000)), 12) AS at_hour FROM t""",
)
def dat2(spark, sf):
    seconds = F.when(F.col("event_id") % 7 != 0, F.unix_timestamp("ts"))
    return table(spark, sf, "events").select(
        "event_id", *[c.alias(n) for n, c in dates.unix_parts(seconds, "at").items()]
    )


@query(
    "DAT3_delay_days",
    """SELECT l_orderkey, l_linenumber, l_partkey,
       CAST(floor((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0) AS BIGINT) AS delay
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def dat3(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        dates.delay_days(F.col("o_orderdate"), F.col("l_shipdate")).alias("delay"),
    )


@query(
    "DAT4_year_prefix",
    """SELECT o_orderkey, year(o_orderdate) AS fiscal_year FROM orders""",
)
def dat4(spark, sf):
    label = F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-"), F.date_format(F.add_months("o_orderdate", 12), "yy"))
    return table(spark, sf, "orders").select("o_orderkey", dates.year_prefix(label).alias("fiscal_year"))


@query(
    "STR1_concat",
    """SELECT p_partkey, p_brand || '_' || p_type AS pair, coalesce(nullif(p_brand, 'Brand#2'), '') || ' ' || p_name AS filled,
       nullif(p_brand, 'Brand#2') || '_' || p_type AS voided FROM part""",
)
def str1(spark, sf):
    brand = F.nullif("p_brand", F.lit("Brand#2"))
    return table(spark, sf, "part").select(
        "p_partkey",
        text.joined("_", F.col("p_brand"), F.col("p_type")).alias("pair"),
        text.joined(" ", brand, F.col("p_name")).alias("filled"),
        text.joined("_", brand, F.col("p_type"), null_if_missing=True).alias("voided"),
    )


@query(
    "STR2_extract_numbers",
    r"""WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'V' || (p_size % 4 * 2 + 6) || ' engine'
           ELSE p_size || '.5HP 1.' || (p_partkey % 10) || 'L ' || (p_size % 3 + 4) || ' Cylinder' END AS engine,
         CASE WHEN p_partkey % 3 = 0 THEN 'Automatic' ELSE (p_size % 5 + 4) || '-Speed A/T' END AS box, p_brand FROM part)
       SELECT p_partkey, TRY_CAST(nullif(regexp_extract(engine, '(\d+\.?\d*)HP', 1), '') AS DOUBLE) AS hp,
       TRY_CAST(nullif(regexp_extract(engine, '(\d+\.?\d*)L', 1), '') AS DOUBLE) AS litres,
       coalesce(TRY_CAST(nullif(regexp_extract(engine, '(\d+)\s*Cylinder', 1), '') AS DOUBLE),
         CASE WHEN contains(engine, 'V6') THEN 6.0 WHEN contains(engine, 'V8') THEN 8.0
              WHEN contains(engine, 'V10') THEN 10.0 WHEN contains(engine, 'V12') THEN 12.0 END) AS cylinders,
       TRY_CAST(nullif(regexp_extract(box, '(\d+)-Speed', 1), '') AS DOUBLE) AS gears,
       TRY_CAST(nullif(regexp_extract(p_brand, '#(\d+)', 1), '') AS DOUBLE) AS brand FROM t""",
)
def str2(spark, sf):
    size, key = F.col("p_size"), F.col("p_partkey")
    engine = F.when(
        key % 4 == 0, F.concat(F.lit("V"), (size % 4 * 2 + 6).cast("string"), F.lit(" engine"))
    ).otherwise(
        F.concat(size.cast("string"), F.lit(".5HP 1."), (key % 10).cast("string"), F.lit("L "),
                 (size % 3 + 4).cast("string"), F.lit(" Cylinder"))
    )
    box = F.when(key % 3 == 0, "Automatic").otherwise(F.concat((size % 5 + 4).cast("string"), F.lit("-Speed A/T")))
    df = table(spark, sf, "part").select("p_partkey", engine.alias("engine"), box.alias("box"), "p_brand")
    return df.select(
        "p_partkey",
        text.extract_number(F.col("engine"), text.HORSEPOWER).alias("hp"),
        text.extract_number(F.col("engine"), text.LITRES).alias("litres"),
        text.cylinders(F.col("engine")).alias("cylinders"),
        text.extract_number(F.col("box"), text.GEARS).alias("gears"),
        text.extract_number(F.col("p_brand"), r"#(\d+)").alias("brand"),
    )


@query("STR3_strip_tags", "SELECT page_id, lower(regexp_replace(html, '<[^>]+>', '', 'g')) AS plain FROM pages")
def str3(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "html")
    return pages.select("page_id", text.strip_tags(F.col("html")).alias("plain"))


@query(
    "STR4_text_statistics",
    r"""WITH t AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws,
         lang || ',' || source AS tags FROM documents)
       SELECT doc_id, length(text) AS char_count, len(ws) AS word_count,
       len(regexp_extract_all(text, '[.!?]+')) + 1 AS sentence_count,
       round(CASE WHEN len(ws) > 0 THEN list_sum(list_transform(ws, lambda w: length(w))) / len(ws) ELSE 0 END, 6) AS mean_word_length,
       round(CASE WHEN length(text) > 0 THEN len(regexp_extract_all(text, '\p{Lu}')) / length(text) ELSE 0 END, 6) AS capital_ratio,
       len(regexp_extract_all(text, '!')) AS exclamation_count, len(regexp_extract_all(text, '\?')) AS question_count,
       len(string_split(tags, ',')) AS tag_count FROM t""",
)
def str4(spark, sf):
    stats = text.text_statistics(F.col("text"))
    stats["mean_word_length"] = r(stats["mean_word_length"])
    stats["capital_ratio"] = r(stats["capital_ratio"])
    stats["tag_count"] = text.comma_count(text.joined(",", F.col("lang"), F.col("source")))
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return docs.select("doc_id", *[c.alias(n) for n, c in stats.items()])


@query(
    "STR5_base_name",
    """SELECT page_id, list_last(string_split(url, '/')) AS name,
       string_split(list_last(string_split(url, '/')), '?')[1] AS head FROM pages""",
)
def str5(spark, sf):
    name = text.base_name(F.col("url"))
    return table(spark, sf, "pages").select("page_id", name.alias("name"), text.first_part(name, "?").alias("head"))


@query(
    "STR6_remove_parentheses",
    r"""SELECT event_id, TRY_CAST(trim(regexp_replace(CAST(value AS VARCHAR) || ' (' || event_type || ')', '\([^)]*\)', '', 'g')) AS DOUBLE) AS number
       FROM events""",
)
def str6(spark, sf):
    noted = F.concat(F.col("value").cast("string"), F.lit(" ("), F.col("event_type"), F.lit(")"))
    return table(spark, sf, "events").select(
        "event_id", text.without_parentheses(noted).try_cast("double").alias("number")
    )


@query(
    "JSN1_loose_json",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 2 AS n_args, event_type AS name FROM events""",
)
def jsn1(spark, sf):
    loose = F.concat(
        F.lit("{'name': '"), F.col("event_type"), F.lit("', 'args': ['a', 'b'], 'k': "),
        F.regexp_extract("props", r"(\d+)", 1), F.lit("}"),
    )
    df = table(spark, sf, "events").select("event_id", text.loose_json(loose, "name STRING, args ARRAY<STRING>, k BIGINT").alias("j"))
    return df.select("event_id", "j.k", F.size("j.args").alias("n_args"), "j.name")


@query(
    "ARR1_list_literal",
    """SELECT o_orderkey, CASE o_orderkey % 5
         WHEN 0 THEN o_orderstatus || '|' || o_orderpriority
         WHEN 1 THEN o_orderstatus || ',x|' || o_orderpriority
         WHEN 2 THEN o_orderstatus || '|' || o_orderpriority
         WHEN 3 THEN o_orderpriority ELSE '' END AS labels,
       CASE o_orderkey % 5 WHEN 3 THEN 1 WHEN 4 THEN 0 ELSE 2 END AS n FROM orders""",
)
def arr1(spark, sf):
    s, p, k = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderkey") % 5
    literal = (
        F.when(k == 0, F.concat(F.lit("[u'"), s, F.lit("', u'"), p, F.lit("']")))
        .when(k == 1, F.concat(F.lit('["'), s, F.lit(",x\", '"), p, F.lit("']")))
        .when(k == 2, F.concat(F.lit("["), s, F.lit(" , "), p, F.lit("]")))
        .when(k == 3, F.concat(F.lit(" "), p))
        .otherwise("[]")
    )
    df = table(spark, sf, "orders").select("o_orderkey", text.parse_list_literal(literal).alias("l"))
    return df.select("o_orderkey", F.array_join("l", "|").alias("labels"), F.size("l").alias("n"))


@query(
    "ARR2_parse_ints",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 1 THEN 0 ELSE l_partkey + l_suppkey END AS total,
       CASE WHEN l_linenumber = 1 THEN 0 ELSE 2 END AS n FROM lineitem""",
)
def arr2(spark, sf):
    ids = F.when(
        F.col("l_linenumber") != 1,
        F.concat(F.lit("  "), F.col("l_partkey").cast("string"), F.lit("  "), F.col("l_suppkey").cast("string"), F.lit(" x1 ")),
    )
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.parse_ints(ids).alias("a"))
    total = F.aggregate("a", F.lit(0).cast("bigint"), lambda x, y: x + y)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", total.alias("total"), F.size("a").alias("n"))


@query(
    "ARR3_filter_by_valid_ids",
    """WITH t AS (SELECT o_orderkey, [o_custkey, o_custkey + 1, o_orderkey % 1000] AS ids FROM orders),
       x AS (SELECT o_orderkey, unnest(ids) AS id FROM t)
       SELECT t.o_orderkey, coalesce(string_agg(CAST(x.id AS VARCHAR), ' ' ORDER BY x.id), '') AS kept FROM t
       LEFT JOIN (SELECT DISTINCT * FROM x WHERE id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 3000)) x
       ON t.o_orderkey = x.o_orderkey GROUP BY 1""",
)
def arr3(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey",
        F.array_distinct(F.array("o_custkey", F.col("o_custkey") + 1, F.col("o_orderkey") % 1000)).alias("ids"),
    )
    valid = table(spark, sf, "customer").filter("c_acctbal > 3000").select(F.col("c_custkey").alias("id"))
    out = clean.keep_valid_ids(df, "o_orderkey", "ids", valid)
    return out.select("o_orderkey", F.array_join(F.transform(F.sort_array("ids"), lambda x: x.cast("string")), " ").alias("kept"))


@query(
    "ARR4_element_count",
    r"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS parts FROM documents""",
)
def arr4(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.word_total(F.col("text")).alias("parts"))


@query(
    "ARR5_argmax_topk",
    """WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
       r AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS rn FROM e)
       SELECT vec_id, CAST(max(CASE WHEN rn = 1 THEN i END) AS BIGINT) AS best,
       string_agg(CAST(i AS VARCHAR), ' ' ORDER BY rn) AS top3 FROM r WHERE rn <= 3 GROUP BY 1""",
)
def arr5(spark, sf):
    top = F.transform(vectors.top_indices(F.col("embedding"), 3), lambda i: i.cast("string"))
    return table(spark, sf, "embeddings").select(
        "vec_id", vectors.argmax(F.col("embedding")).alias("best"), F.array_join(top, " ").alias("top3")
    )
