"""Leaderboard queries on runs made from events: competition = type and day, model and language from ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldmark.operators import leaderboard as lb
from foldmark.plans import query
from foldmark.session import dealt, shared_dir
from foldmark.sources.results import read_sheets, unpivot_sheet
from foldmark.tables import table

CELL = ["comp", "model", "lang"]

NAMES = [n for n, _, _ in lb.LANGUAGES]
CODES_SQL = "[" + ", ".join(f"'{c}'" for _, c, _ in lb.LANGUAGES) + "]"


def runs(spark, sf):
    """Runs with raw text; every ninth failed, every thirteenth has no number."""
    key = F.col("event_id")
    raw = (
        F.when(key % 9 == 0, "None")
        .when(key % 13 == 0, "ValueError: bad")
        .otherwise(F.format_string("%.2f", F.col("value")))
    )
    codes = F.array(*[F.lit(c) for _, c, _ in lb.LANGUAGES])
    return table(spark, sf, "events").select(
        "event_id",
        "user_id",
        F.concat("event_type", F.lit("-"), F.dayofmonth("ts").cast("string")).alias("comp"),
        F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("model"),
        F.get(codes, (key % 14).cast("int")).alias("lang"),
        raw.alias("raw"),
        F.when(F.col("event_type").isin("error", "view"), "rmse").otherwise("accuracy").alias("metric"),
        F.lit(60.0).alias("baseline"),
    )


RUNS = f"""WITH runs AS (SELECT event_id, event_type || '-' || day(ts) AS comp, 'm' || (user_id % 4) AS model, {CODES_SQL}[event_id % 14 + 1] AS lang,
  CASE WHEN event_id % 9 = 0 THEN 'None' WHEN event_id % 13 = 0 THEN 'ValueError: bad' ELSE printf('%.2f', value) END AS raw,
  CASE WHEN event_type IN ('error', 'view') THEN 'rmse' ELSE 'accuracy' END AS metric, 60.0 AS baseline FROM events),
  s AS (SELECT *, TRY_CAST(raw AS DOUBLE) AS score FROM runs),
  p AS (SELECT *, CASE WHEN metric = 'accuracy' THEN score / baseline ELSE CASE WHEN score = 0 THEN 0 ELSE baseline / score END END AS r FROM s),
  c AS (SELECT comp, model, lang, count(r) AS runs, greatest(3, count(r)) AS n, coalesce(sum(r), 0) AS sr, coalesce(avg(r), 0) AS mr, coalesce(var_pop(r), 0) AS vr,
        count(score) / 3 * 100 AS rate FROM p GROUP BY 1, 2, 3),
  cells AS (SELECT comp, model, lang, runs, sr / n AS rp, sqrt((vr * runs + mr * mr * runs * (n - runs) / n) / n) AS rp_std, rate FROM c)"""


def scored(spark, sf):
    return runs(spark, sf).withColumn("score", lb.run_score(F.col("raw")))


def cells(spark, sf):
    """One row per cell with relative performance and pass rate."""
    rated = scored(spark, sf)
    perf = lb.relative_performance(rated, CELL)
    rates = lb.valid_run_rate(rated, CELL).select(*CELL, F.col("pass_rate").alias("rate"))
    return perf.join(rates, CELL)


def sheet(spark, sf):
    """One result-sheet cell per event, in the spellings such cells have."""
    key, v = F.col("event_id") % 6, F.format_string("%.2f", F.col("value"))
    cell = (
        F.when(key == 0, "")
        .when(key == 1, "None")
        .when(key == 2, v)
        .when(key == 3, F.concat(v, F.lit(", None, 0.8")))
        .when(key == 4, F.lit("None(es), 1.0 (note)"))
        .otherwise(F.concat(v, F.lit(", 0.6, Error: x, "), v))
    )
    return table(spark, sf, "events").select("event_id", cell.alias("cell"))


def parsed_cells(spark, sf):
    cells = sheet(spark, sf)
    return cells.select("event_id", *[c.alias(n) for n, c in lb.parse_cell(F.col("cell")).items()])


PARSED = """WITH p AS (SELECT event_id, [0, 0, 1, 2, 1, 3][event_id % 6 + 1] AS ok, [0, 1, 1, 3, 2, 4][event_id % 6 + 1] AS total FROM events)"""


def rounded(df, digits=9, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query(
    "LB1_explode_runs",
    """WITH t AS (SELECT event_id, printf('%.2f', value) AS v, event_id % 6 AS k FROM events),
       r AS (SELECT event_id, unnest(CASE k WHEN 2 THEN [v] WHEN 3 THEN [v, '0.8'] WHEN 4 THEN ['None(es)', '1.0 (note)'] WHEN 5 THEN [v, '0.6', 'Error: x', v] END) AS raw,
         unnest(CASE k WHEN 2 THEN [0] WHEN 3 THEN [0, 1] WHEN 4 THEN [0, 1] WHEN 5 THEN [0, 1, 2, 3] END) AS run FROM t)
       SELECT event_id, run, raw FROM r""",
)
def lb1(spark, sf):
    return lb.explode_runs(sheet(spark, sf))


@query(
    "LB2_valid_run_rate",
    RUNS + " SELECT comp, model, lang, count(score) AS valid_runs, round(count(score) / 3 * 100, 9) AS pass_rate FROM s GROUP BY 1, 2, 3",
)
def lb2(spark, sf):
    return rounded(lb.valid_run_rate(runs(spark, sf), CELL), 9, "pass_rate")


@query("LB3_pass_rate", PARSED + " SELECT event_id, ok, total, round(ok / greatest(3, total), 9) AS rate FROM p")
def lb3(spark, sf):
    return parsed_cells(spark, sf).withColumn("rate", F.round(lb.pass_rate(F.col("ok"), F.col("total")), 9))


@query("LB4_pass_fraction", PARSED + " SELECT event_id, ok || '/' || greatest(3, total) AS fraction FROM p")
def lb4(spark, sf):
    return parsed_cells(spark, sf).select("event_id", lb.pass_fraction(F.col("ok"), F.col("total")).alias("fraction"))


@query("LB5_relative_performance", RUNS + " SELECT comp, model, lang, runs, round(rp, 9) AS rp, round(rp_std, 9) AS rp_std FROM cells")
def lb5(spark, sf):
    out = lb.relative_performance(scored(spark, sf), CELL)
    return out.withColumns({"rp": F.round("rp", 9), "rp_std": F.round("rp_std", 9)})


def sheet_runs(spark, sf):
    """Runs read back from a sheet: a row per user and kind of event, a column per model and language, most cells empty."""
    cell = F.concat_ws(", ", F.sort_array(F.collect_list("raw")))
    entries = [(f"m{m}", c) for m in range(4) for _, c, _ in lb.LANGUAGES]
    said = runs(spark, sf).withColumn("entry", F.concat_ws("-", "model", "lang")).withColumn("comp", F.concat_ws("-", "user_id", "metric"))
    wide = said.groupBy("comp", "baseline", "metric").pivot("entry", [f"{m}-{c}" for m, c in entries]).agg(cell)
    cells = unpivot_sheet(wide, [m for m, _ in entries], [c for _, c in entries], ["comp", "baseline", "metric"])
    return lb.explode_runs(cells, keep_empty=True).withColumn("score", lb.run_score(F.col("raw")))


@query(
    "LB5_sheet_with_empty_cells",
    RUNS.replace("event_type || '-' || day(ts) AS comp", "user_id || '-' || CASE WHEN event_type IN ('error', 'view') THEN 'rmse' ELSE 'accuracy' END AS comp")
    + f""", every AS (SELECT comp, 'm' || m AS model, lang FROM (SELECT DISTINCT comp FROM runs), (SELECT unnest(range(4)) AS m), (SELECT unnest({CODES_SQL}) AS lang))
       SELECT comp, model, lang, coalesce(runs, 0) AS runs, round(coalesce(rp, 0), 9) AS rp, round(coalesce(rate, 0), 9) AS pass_rate
       FROM every LEFT JOIN cells USING (comp, model, lang)""",
)
def lb5_sheet(spark, sf):
    said = sheet_runs(spark, sf)
    perf = lb.relative_performance(said, CELL).drop("rp_std")
    rates = lb.valid_run_rate(said, CELL).select(*CELL, "pass_rate")
    return rounded(perf.join(rates, CELL), 9, "rp", "pass_rate")


def sheet_files(spark, sf):
    """Three sheets as files, users dealt over them: two header rows, a row per user and kind of event; the second has its columns the other way round."""
    entries = [(f"m{m}", n, c) for m in range(4) for n, c, _ in lb.LANGUAGES]
    said = runs(spark, sf).withColumns({"entry": F.concat_ws("-", "model", "lang"), "comp": F.concat_ws("-", "user_id", "metric"), "sheet": F.col("user_id") % 3})
    cell = F.concat_ws(", ", F.sort_array(F.collect_list("raw")))
    wide = said.groupBy("sheet", "comp", "baseline", "metric").pivot("entry", [f"{m}-{c}" for m, _, c in entries]).agg(cell)
    quoted = F.array(*[F.concat(F.lit('"'), F.coalesce(F.col(f"`{m}-{c}`"), F.lit("")), F.lit('"')) for m, _, c in entries])
    turned = F.when(F.col("sheet") == 1, F.reverse(quoted)).otherwise(quoted)
    line = F.concat_ws(",", F.lit("1"), "comp", F.col("baseline").cast("string"), F.lit("events"), "metric", F.array_join(turned, ","))
    body = wide.select("sheet", F.lit(2).alias("rank"), line.alias("value"))
    heads = []
    for sheet in range(3):
        order = entries[::-1] if sheet == 1 else entries
        names = ["" if k and order[k - 1][0] == m else m for k, (m, _, _) in enumerate(order)]
        heads += [(sheet, 0, ",,,,," + ",".join(names)), (sheet, 1, "no,name,baseline,domain,metric," + ",".join(n for _, n, _ in order))]
    lines = spark.createDataFrame(heads, "sheet LONG, rank INT, value STRING").unionByName(body)
    path = shared_dir(spark, "sheets")
    lines.repartition("sheet").sortWithinPartitions("sheet", "rank", "value").select("sheet", "value").write.partitionBy("sheet").text(path)
    return path


CELLS_PER_TASK = 100_000


@query(
    "SRC11_sheets_to_table",
    RUNS.replace("event_type || '-' || day(ts) AS comp", "user_id || '-' || CASE WHEN event_type IN ('error', 'view') THEN 'rmse' ELSE 'accuracy' END AS comp")
    + f""", every AS (SELECT comp, 'm' || m AS model, lang FROM (SELECT DISTINCT comp FROM runs), (SELECT unnest(range(4)) AS m), (SELECT unnest({CODES_SQL}) AS lang)),
       j AS (SELECT comp, model, lang, coalesce(rp, 0) AS rp, coalesce(rate, 0) AS rate FROM every LEFT JOIN cells USING (comp, model, lang)),
       a AS (SELECT model, lang, avg(greatest(0, 1 - greatest(rp, 0))) AS area, avg(CASE WHEN rp <= 0 THEN 1 WHEN rp < 1 THEN 1 - rp + rp * ln(rp) ELSE 0 END) AS ln_area,
         avg(CAST(rp <= 1 AS INT)) * 100 AS win_rate, avg(rate) AS pass_rate FROM j GROUP BY 1, 2),
       b AS (SELECT * FROM a UNION ALL SELECT model, 'Avg.', avg(area), avg(ln_area), avg(win_rate), avg(pass_rate) FROM a GROUP BY 1)
       SELECT model, lang, round(area, 9) AS AUP_std, round(ln_area, 9) AS AUP_ln, round(win_rate, 9) AS win_rate, round(pass_rate, 9) AS pass_rate FROM b""",
)
def src11_table(spark, sf):
    """From raw sheets to the result table: areas, win and pass rates per model and language with the average row; empty cells are 0."""
    said = lb.explode_runs(read_sheets(spark, sheet_files(spark, sf)), keep_empty=True).withColumn("score", lb.run_score(F.col("raw")))
    said = said.withColumn("lang", lb.language_code(F.col("lang")))
    cell = ["file", "comp", "metric", "model", "lang"]
    said = dealt(said, cell, CELLS_PER_TASK)  # once, for both aggregates and their join
    rates = lb.valid_run_rate(said, cell).select(*cell, F.col("pass_rate").alias("rate"))
    found = lb.relative_performance(said, cell).join(rates, cell)
    rows = lb.with_average_row(lb.summary(found, ["model", "lang"], rate="rate"), ["model"])
    return rounded(rows.select("model", "lang", "AUP_std", "AUP_ln", "win_rate", "pass_rate"), 9, "AUP_std", "AUP_ln", "win_rate", "pass_rate")


@query(
    "LB6_profile",
    RUNS
    + """, g AS (SELECT unnest(range(101)) * 0.01::DOUBLE AS tau) SELECT model, round(tau, 2) AS tau, round(avg(CAST(rp <= tau AS INT)), 9) AS rho
       FROM cells, g GROUP BY 1, 2""",
)
def lb6(spark, sf):
    out = lb.profile(cells(spark, sf), ["model"], points=101)
    return out.withColumns({"tau": F.round("tau", 2), "rho": F.round("rho", 9)})


@query(
    "LB7_aup_std",
    RUNS
    + """, g AS (SELECT unnest(range(1001)) AS i), w AS (SELECT i, i * 0.001::DOUBLE AS tau, CASE WHEN i IN (0, 1000) THEN 0.0005 ELSE 0.001 END AS w FROM g),
       q AS (SELECT model, lang, tau, w, avg(CAST(rp <= tau AS INT)) AS rho FROM cells, w GROUP BY 1, 2, 3, 4),
       a AS (SELECT model, lang, sum(w * rho) AS grid FROM q GROUP BY 1, 2),
       e AS (SELECT model, lang, avg(greatest(0, 1 - greatest(rp, 0))) AS exact FROM cells GROUP BY 1, 2)
       SELECT a.model, a.lang, round(grid, 9) AS grid, round(exact, 9) AS exact FROM a JOIN e ON a.model = e.model AND a.lang = e.lang""",
)
def lb7(spark, sf):
    terms = lb.area_terms(F.col("rp"))
    return cells(spark, sf).groupBy("model", "lang").agg(
        F.round(F.avg(terms["AUP_std_grid"]), 9).alias("grid"), F.round(F.avg(terms["AUP_std"]), 9).alias("exact")
    )


@query(
    "LB8_aup_ln",
    RUNS
    + """ SELECT model, lang, round(avg(CASE WHEN rp <= 0 THEN 1 WHEN rp < 1 THEN 1 - rp + rp * ln(rp) ELSE 0 END), 9) AS "AUP_ln" FROM cells GROUP BY 1, 2""",
)
def lb8(spark, sf):
    return rounded(lb.profile_area(cells(spark, sf), ["model", "lang"], "AUP_ln"), 9, "AUP_ln")


@query(
    "LB9_aup_invln",
    RUNS
    + """, g AS (SELECT unnest(range(1000)) AS i), t AS (SELECT i, CASE WHEN i = 999 THEN 1 - 1e-8::DOUBLE ELSE 1e-8::DOUBLE + i * ((1 - 2 * 1e-8::DOUBLE) / 999) END AS tau FROM g),
       w AS (SELECT tau, -1 / ln(tau) * CASE WHEN i IN (0, 999) THEN 0.5 ELSE 1 END AS w FROM t),
       q AS (SELECT model, tau, w, avg(CAST(rp <= tau AS INT)) AS rho FROM cells, w GROUP BY 1, 2, 3)
       SELECT model, round(sum(w * rho) / sum(w), 9) AS "AUP_invln" FROM q GROUP BY 1""",
)
def lb9(spark, sf):
    return rounded(lb.profile_area(cells(spark, sf), ["model"], "AUP_invln"), 9, "AUP_invln")


_RATES = "round(avg(CAST(rp <= 1 AS INT)) * 100, 9) AS win_rate, round(avg(CAST(rp > 1 AS INT)) * 100, 9) AS beats_baseline_rate"


@query("LB10_win_rate", RUNS + f" SELECT model, lang, {_RATES} FROM cells GROUP BY 1, 2")
def lb10(spark, sf):
    out = lb.summary(cells(spark, sf), ["model", "lang"])
    return rounded(out, 9, "win_rate", "beats_baseline_rate").select("model", "lang", "win_rate", "beats_baseline_rate")


_PER_LANG = """, l AS (SELECT model, lang, avg(greatest(0, 1 - greatest(rp, 0))) AS aup, avg(rate) AS pass_rate FROM cells GROUP BY 1, 2),
  a AS (SELECT * FROM l UNION ALL SELECT model, 'Avg.', avg(aup), avg(pass_rate) FROM l GROUP BY 1)"""


def averaged(spark, sf):
    per_lang = lb.summary(cells(spark, sf), ["model", "lang"], rate="rate")
    return lb.with_average_row(per_lang, ["model"])


@query("LB11_average_row", RUNS + _PER_LANG + " SELECT model, lang, round(aup, 9) AS aup, round(pass_rate, 9) AS pass_rate FROM a")
def lb11(spark, sf):
    return averaged(spark, sf).select(
        "model", "lang", F.round("AUP_std", 9).alias("aup"), F.round("pass_rate", 9).alias("pass_rate")
    )


@query("LB12_cell_text", RUNS + _PER_LANG + " SELECT model, lang, printf('%.5f / %.0f%%', aup, pass_rate) AS cell FROM a")
def lb12(spark, sf):
    return averaged(spark, sf).select("model", "lang", lb.cell_text(F.col("AUP_std"), F.col("pass_rate")).alias("cell"))


@query(
    "LB13_gap_vs_english",
    RUNS
    + """ SELECT c.comp, c.model, c.lang, round(c.rate - e.rate, 9) + 0.0 AS gap FROM cells c
       LEFT JOIN (SELECT * FROM cells WHERE lang = 'EN') e ON c.comp = e.comp AND c.model = e.model WHERE c.lang <> 'EN'""",
)
def lb13(spark, sf):
    out = lb.gap_to(cells(spark, sf).select(*CELL, "rate"), ["comp", "model"], "lang", "rate")
    return out.withColumn("gap", F.round("gap", 9) + 0.0)


@query("LB14_language_stats", RUNS + " SELECT model, lang, round(avg(rate), 9) AS mean, round(stddev_samp(rate), 9) AS std FROM cells GROUP BY 1, 2")
def lb14(spark, sf):
    return rounded(lb.language_stats(cells(spark, sf), ["model"], "lang", "rate"), 9, "mean", "std")


@query(
    "LB13_display_rates_from_sheets",
    RUNS.replace("event_type || '-' || day(ts) AS comp", "user_id || '-' || CASE WHEN event_type IN ('error', 'view') THEN 'rmse' ELSE 'accuracy' END AS comp")
    + f""", every AS (SELECT comp, 'm' || m AS model, lang FROM (SELECT DISTINCT comp FROM runs), (SELECT unnest(range(4)) AS m), (SELECT unnest({CODES_SQL}) AS lang)),
       d AS (SELECT comp, model, lang, count(*) AS total, count(score) AS ok FROM s GROUP BY 1, 2, 3),
       j AS (SELECT comp, model, lang, coalesce(ok, 0) / greatest(coalesce(total, 0), 3) AS rate FROM every LEFT JOIN d USING (comp, model, lang)),
       g AS (SELECT j.model, j.lang, j.rate, j.rate - e.rate AS gap FROM j JOIN (SELECT comp, model, rate FROM j WHERE lang = 'EN') e ON j.comp = e.comp AND j.model = e.model)
       SELECT model, lang, round(avg(rate), 9) AS mean, round(stddev_samp(rate), 9) AS std, round(avg(CASE WHEN lang <> 'EN' THEN gap END), 9) + 0.0 AS mean_gap FROM g GROUP BY 1, 2""",
)
def lb13_display(spark, sf):
    """Pass rates by the display rule, straight from raw sheets: mean and deviation per model and language, and the mean distance from English."""
    said = read_sheets(spark, sheet_files(spark, sf)).withColumn("lang", lb.language_code(F.col("lang")))
    rule = lb.parse_cell(F.coalesce("cell", F.lit("")))
    rated = said.select("file", *CELL, lb.pass_rate(rule["ok"], rule["total"]).alias("rate"))
    gaps = lb.gap_to(rated, ["file", "comp", "model"], "lang", "rate").groupBy("model", "lang").agg(F.avg("gap").alias("mean_gap"))
    stats = lb.language_stats(rated, ["model"], "lang", "rate").join(gaps, ["model", "lang"], "left")
    return rounded(stats, 9, "mean", "std").withColumn("mean_gap", F.round("mean_gap", 9) + 0.0).select("model", "lang", "mean", "std", "mean_gap")


@query(
    "LB15_resource_groups",
    RUNS
    + """, l AS (SELECT model, lang, avg(rate) AS m FROM cells GROUP BY 1, 2),
       t AS (SELECT model, m, CASE WHEN lang IN ('EN','FR','ES','IT','ZH') THEN 'high' WHEN lang IN ('RO','KK','BE') THEN 'low' ELSE 'medium' END AS resource_group FROM l
             UNION ALL SELECT model, m, 'all' FROM l) SELECT model, resource_group, round(avg(m), 9) AS mean_rate FROM t GROUP BY 1, 2""",
)
def lb15(spark, sf):
    return rounded(lb.group_means(cells(spark, sf), ["model"], "lang", "rate"), 9, "mean_rate")


@query(
    "LB16_language_code",
    f"""SELECT event_id, CASE WHEN event_id % 17 = 14 THEN 'AR' WHEN event_id % 17 = 15 THEN 'Avg' WHEN event_id % 17 = 16 THEN 'Klingon' ELSE {CODES_SQL}[event_id % 17 + 1] END AS code FROM events""",
)
def lb16(spark, sf):
    names = F.array(*[F.lit(n) for n in [*NAMES, "Arab", "Avg.", "Klingon"]])
    name = F.get(names, (F.col("event_id") % 17).cast("int"))
    return table(spark, sf, "events").select("event_id", lb.language_code(name).alias("code"))


@query(
    "LB17_task_coverage",
    """WITH k AS (SELECT DISTINCT c_nationkey AS comp, c_mktsegment AS lang FROM customer WHERE c_acctbal > 8500 AND c_nationkey % 7 <> 3),
       w AS (SELECT n_nationkey AS comp, unnest(['BUILDING','MACHINERY','FURNITURE','HOUSEHOLD','AUTOMOBILE']) AS lang FROM nation)
       SELECT w.comp, w.lang, k.comp IS NOT NULL AS present FROM w LEFT JOIN k ON w.comp = k.comp AND w.lang = k.lang WHERE w.comp IN (SELECT comp FROM k)""",
)
def lb17(spark, sf):
    competitions = table(spark, sf, "nation").select(F.col("n_nationkey").alias("comp"))
    tasks = table(spark, sf, "customer").filter("c_acctbal > 8500 AND c_nationkey % 7 <> 3").select(
        F.col("c_nationkey").alias("comp"), F.col("c_mktsegment").alias("lang")
    )
    segments = ["BUILDING", "MACHINERY", "FURNITURE", "HOUSEHOLD", "AUTOMOBILE"]
    return lb.task_coverage(competitions, tasks, "comp", "lang", segments)
