"""Leakage queries on reports made from orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldmark.operators import leakage as lk
from foldmark.plans import query
from foldmark.tables import table


def joined_array(col):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), " ")


def headers(spark, sf):
    """Submission heads: with a traceback, without one, unclosed, or too short."""
    key, k4 = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 4
    top = F.concat(F.lit("# /runs/"), key, F.lit(".py \n#  "), "o_orderstatus", F.lit('\n"""'), "o_orderpriority")
    text = (
        F.when(k4 == 0, F.concat(top, F.lit('\nTrace a\nline b\n"""\nx = 1')))
        .when(k4 == 1, F.concat(top, F.lit('\n"""\nx = 1')))
        .when(k4 == 2, F.concat(top, F.lit("\nnever\nclosed")))
        .otherwise(top)
    )
    return table(spark, sf, "orders").select("o_orderkey", text.alias("text"))


@query(
    "LK1_header_fields",
    """SELECT o_orderkey, '/runs/' || o_orderkey || '.py' AS original_file_path, o_orderstatus AS entrypoint_status,
       CASE WHEN o_orderkey % 4 = 3 THEN 'BAD_HEADER_FORMAT' ELSE o_orderpriority END AS error_status,
       CASE o_orderkey % 4 WHEN 0 THEN 'Trace a line b ' WHEN 2 THEN 'never closed ' END AS traceback FROM orders""",
)
def lk1(spark, sf):
    return lk.parse_headers(headers(spark, sf)).drop("text")


def pages(spark, sf):
    """Report pages with a summary table, warnings and line buttons."""
    k = F.col("event_id")
    user = F.col("user_id").cast("string")
    html = F.concat(
        F.lit('<html><body><table class="sum"><tr><th>Leakage</th><th>Detected</th></tr><tr><td>Pre-processing leakage</td><td> '),
        (k % 5).cast("string"),
        F.lit("</td></tr><tr><td><b>Overlap leakage</b></td><td>"),
        F.when(k % 3 == 0, "n/a").otherwise((k % 7).cast("string")),
        F.lit("</td></tr><tr><td>No independence test data</td><td>"),
        (k % 2).cast("string"),
        F.lit('</td></tr></table><button style="background-color: red; color: white">'),
        F.col("event_type"),
        F.lit(' &amp; leak</button><button onclick="highlight_lines(['),
        user, F.lit(", "), (F.col("user_id") + 1).cast("string"),
        F.lit('])">highlight train/test sites</button><button style="color: blue" onclick="mark_leak_lines(['),
        user,
        F.lit('])">show and go to first leak src</button>'),
        F.when(
            k % 4 == 0,
            F.concat(
                F.lit('<button style="background-color: red">second</button><button onclick="mark_leak_lines(['),
                k.cast("string"),
                F.lit('])">show and go to first leak src</button>'),
            ),
        ).otherwise(""),
        F.lit("</body></html>"),
    )
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return events.select("event_id", F.when(k % 11 != 0, html).alias("html"))


@query(
    "LK2_leakage_counts",
    """SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN event_id % 5 END AS preprocessing_leakage,
       CASE WHEN event_id % 11 <> 0 THEN CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 7 END END AS overlap_leakage,
       CASE WHEN event_id % 11 <> 0 THEN event_id % 2 END AS no_independence FROM events""",
)
def lk2(spark, sf):
    return lk.parse_reports(pages(spark, sf)).select("event_id", *lk.COUNTERS)


@query(
    "LK3_red_buttons",
    """SELECT event_id, event_type || ' & leak' || CASE WHEN event_id % 4 = 0 THEN '|second' ELSE '' END AS warnings FROM events WHERE event_id % 11 <> 0
       UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 11 = 0""",
)
def lk3(spark, sf):
    return lk.parse_reports(pages(spark, sf)).select("event_id", F.array_join("warnings", "|").alias("warnings"))


@query(
    "LK4_button_lines",
    """SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN user_id || ' ' || (user_id + 1) END AS highlight_lines,
       CASE WHEN event_id % 11 <> 0 THEN user_id || CASE WHEN event_id % 4 = 0 THEN ' ' || event_id ELSE '' END END AS mark_leak_lines FROM events""",
)
def lk4(spark, sf):
    out = lk.parse_reports(pages(spark, sf))
    return out.select("event_id", *[joined_array(F.col(c)).alias(c) for c in ("highlight_lines", "mark_leak_lines")])


@query(
    "LK5_enclosing_functions",
    """WITH o AS (SELECT o_custkey AS file, o_orderkey, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS d FROM orders),
       l AS (SELECT DISTINCT file, d AS line FROM o),
       f AS (SELECT file, d - 40 AS start_line, arg_max(o_orderkey, (d + o_orderkey % 300, 'f' || o_orderkey)) AS k, max(d + o_orderkey % 300) AS end_line FROM o GROUP BY 1, 2)
       SELECT f.file, start_line, end_line, 'f' || k AS name, string_agg(CAST(line AS VARCHAR), ' ' ORDER BY line) AS contains_lines
       FROM f JOIN l ON f.file = l.file AND line BETWEEN start_line AND end_line GROUP BY 1, 2, 3, 4""",
)
def lk5(spark, sf):
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("bigint")
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("file"), "o_orderkey", day.alias("line"))
    functions = orders.select(
        "file",
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("name"),
        (F.col("line") - 40).alias("start_line"),
        (F.col("line") + F.col("o_orderkey") % 300).alias("end_line"),
    )
    out = lk.enclosing_functions(orders.select("file", "line"), functions)
    return out.withColumn("contains_lines", joined_array(F.col("contains_lines")))


@query(
    "LK5_broken_spans",
    """WITH o AS (SELECT o_custkey % 40 AS file, o_orderkey, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS d FROM orders),
       l AS (SELECT DISTINCT file, d AS line FROM o),
       e AS (SELECT file, o_orderkey, d - o_orderkey % 700 AS start_line, CASE o_orderkey % 5 WHEN 0 THEN 1000000000000 WHEN 1 THEN d - 800 WHEN 2 THEN NULL ELSE d + o_orderkey % 9 END AS end_line FROM o),
       f AS (SELECT file, start_line, arg_max(o_orderkey, (coalesce(end_line, -1000000), 'f' || o_orderkey)) AS k, max(end_line) AS end_line FROM e GROUP BY 1, 2)
       SELECT f.file, start_line, end_line, 'f' || k AS name, count(*) AS lines, min(line) AS first_line, max(line) AS last_line
       FROM f JOIN l ON f.file = l.file AND line BETWEEN start_line AND end_line GROUP BY 1, 2, 3, 4""",
)
def lk5_broken(spark, sf):
    """Spans with ends far beyond any file, ends before their starts, and none at all."""
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("bigint")
    key = F.col("o_orderkey")
    orders = table(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("file"), "o_orderkey", day.alias("line"))
    end = F.when(key % 5 == 0, F.lit(10**12)).when(key % 5 == 1, F.col("line") - 800).when(key % 5 > 2, F.col("line") + key % 9)
    functions = orders.select("file", F.concat(F.lit("f"), key.cast("string")).alias("name"), (F.col("line") - key % 700).alias("start_line"), end.alias("end_line"))
    out = lk.enclosing_functions(orders.select("file", "line"), functions)
    lines = F.col("contains_lines")
    return out.select("file", "start_line", "end_line", "name", F.size(lines).cast("bigint").alias("lines"), F.array_min(lines).alias("first_line"), F.array_max(lines).alias("last_line"))


def reports(spark, sf):
    """Report rows: a tenth has no page, a third leaks nothing, one or two functions each."""
    k = F.col("o_orderkey")
    one = F.struct(
        F.when(k % 4 == 0, "train").otherwise("preprocess").alias("name"),
        F.when(k % 5 == 0, F.array(F.lit("df"))).otherwise(F.array(F.lit("df"), F.lit("is_train"))).alias("args"),
    )
    two = F.struct(F.lit("fit").alias("name"), F.array(F.lit("X"), F.lit("y")).alias("args"))
    none = F.array().cast("array<struct<name:string,args:array<string>>>")
    funcs = F.when(k % 3 == 0, none).when(k % 7 == 0, F.array(one, two)).otherwise(F.array(one))
    path = F.concat(F.lit("out/m"), (F.col("o_custkey") % 4).cast("string"), F.lit("_"), k.cast("string"))
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(path, F.lit(".py")).alias("python_file_path"),
        F.when(k % 10 != 0, F.concat(path, F.lit(".html"))).alias("html_file_path"),
        (k % 3).alias("preprocessing_leakage"),
        funcs.alias("funcs"),
    )


REPORTS = """WITH r AS (SELECT o_orderkey, 'm' || (o_custkey % 4) AS model, o_orderkey % 3 AS leak,
  CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS n_funcs,
  CASE WHEN o_orderkey % 4 = 0 THEN 'train' ELSE 'preprocess' END AS name, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 2 END AS n_args
  FROM orders WHERE o_orderkey % 10 <> 0), f AS (SELECT *, n_funcs = 1 AND (n_args = 1 OR name = 'train') AS fp FROM r) """


@query("LK6_leakage_rate", REPORTS + "SELECT model, count(*) AS files, count(*) FILTER (leak <> 0) AS leaking, round(count(*) FILTER (leak <> 0) / count(*), 9) AS rate FROM r GROUP BY 1")
def lk6(spark, sf):
    return lk.leakage_rate(lk.with_model(reports(spark, sf)), ["model"]).withColumn("rate", F.round("rate", 9))


@query(
    "LK7_function_signatures",
    REPORTS
    + """SELECT o_orderkey, n_funcs, CASE n_funcs WHEN 0 THEN '' WHEN 1 THEN CAST(n_args AS VARCHAR) ELSE n_args || ' 2' END AS func_n_args,
       CASE n_funcs WHEN 0 THEN '' ELSE name || CASE n_args WHEN 1 THEN '([''df''])' ELSE '([''df'', ''is_train''])' END END
       || CASE n_funcs WHEN 2 THEN '; fit([''X'', ''y''])' ELSE '' END AS func_sig FROM r""",
)
def lk7(spark, sf):
    out = lk.function_signatures(lk.with_model(reports(spark, sf)))
    return out.select(
        "o_orderkey", "n_funcs", joined_array(F.col("func_n_args")).alias("func_n_args"), F.array_join("func_sig", "; ").alias("func_sig")
    )


@query("LK8_false_positives", REPORTS + "SELECT o_orderkey, model, n_args, name FROM f WHERE fp")
def lk8(spark, sf):
    out = lk.function_signatures(lk.with_model(reports(spark, sf))).filter(lk.is_false_positive())
    return out.select("o_orderkey", "model", F.get("func_n_args", F.lit(0)).alias("n_args"), F.get("func_name", F.lit(0)).alias("name"))


@query(
    "LK9_corrected_rate",
    REPORTS
    + """SELECT model, count(*) AS files, count(*) FILTER (leak <> 0) AS leaking, count(*) FILTER (fp) AS false_positives,
       count(*) FILTER (leak <> 0) - count(*) FILTER (fp) AS remaining, round((count(*) FILTER (leak <> 0) - count(*) FILTER (fp)) / count(*), 9) AS rate,
       round(count(*) FILTER (fp) / count(*) FILTER (leak <> 0), 9) AS false_positive_rate FROM f GROUP BY 1""",
)
def lk9(spark, sf):
    out = lk.corrected_rate(lk.function_signatures(lk.with_model(reports(spark, sf))), ["model"])
    return out.withColumns({c: F.round(c, 9) for c in ("rate", "false_positive_rate")})


@query("LK9_remaining_rows", REPORTS + "SELECT model, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM f WHERE leak <> 0 AND NOT fp GROUP BY 1")
def lk9_rows(spark, sf):
    out = lk.remaining_reports(lk.function_signatures(lk.with_model(reports(spark, sf))), "python_file_path")
    return out.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query(
    "JN7_report_halves",
    """SELECT 'out/' || o_orderkey || '.py' AS python_file_path, CASE WHEN o_orderkey % 3 <> 0 THEN 'out/' || o_orderkey || '.html' END AS html_file_path,
       CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS html FROM orders WHERE o_orderkey % 4 <> 1""",
)
def jn7(spark, sf):
    stem = F.concat(F.lit("out/"), F.col("o_orderkey").cast("string"))
    orders = table(spark, sf, "orders")
    py = orders.select(F.concat(stem, F.when(F.col("o_orderkey") % 4 == 1, ".ir.py").otherwise(".py")).alias("path"))
    html = orders.filter("o_orderkey % 3 <> 0").select(
        F.concat(stem, F.lit(".html")).alias("path"), F.col("o_orderpriority").alias("text")
    )
    return lk.pair_reports(py, html)
