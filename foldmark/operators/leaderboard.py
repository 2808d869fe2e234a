"""Leaderboard statistics on a long table of runs: one row per (competition, model, language, run).

Cell-level numbers come from one aggregate over the runs; profile areas are averages of closed forms or of
grid tail weights over the cells, so no table is ever crossed with a grid of thresholds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldmark.functions.text import strip, without_parentheses
from foldmark.functions.values import as_number

RUNS_PER_CELL = 3

# fixed values: metrics where a higher score is better; all others count as lower-is-better
HIGHER_IS_BETTER = ["roc_auc", "f1_score", "accuracy", "r2_score", "FScoreMacro"]
# fixed values: cell contents that stand for no run
NO_RUN = ["None", "nan", "NaN", ""]
# fixed values: languages with code, resource group and place in the table order
LANGUAGES = [
    ("English", "EN", "high"),
    ("French", "FR", "high"),
    ("Spanish", "ES", "high"),
    ("Italian", "IT", "high"),
    ("Chinese", "ZH", "high"),
    ("Japanese", "JA", "medium"),
    ("Russian", "RU", "medium"),
    ("Polish", "PL", "medium"),
    ("Turkish", "TR", "medium"),
    ("Arabic", "AR", "medium"),
    ("Ukrainian", "UK", "medium"),
    ("Romanian", "RO", "low"),
    ("Kazakh", "KK", "low"),
    ("Belarusian", "BE", "low"),
]
# fixed values: spellings found in result sheets
LANGUAGE_ALIASES = {"Arab": "AR", "Ukranian": "UK", "Belarus": "BE", "Avg.": "Avg", "Avg": "Avg"}

# fixed values: grid of the inverse-logarithm profile
INVLN_EPS, INVLN_POINTS = 1e-8, 1000


def language_table(spark: SparkSession) -> DataFrame:
    rows = [(name, code, group, i) for i, (name, code, group) in enumerate(LANGUAGES)]
    return spark.createDataFrame(rows, "language STRING, code STRING, resource_group STRING, place INT")


def language_code(col: Column) -> Column:
    """Two-letter code for a language name or one of its spellings; other text stays."""
    codes = {**{n: c for n, c, _ in LANGUAGES}, **LANGUAGE_ALIASES}
    pairs = [F.lit(x) for kv in codes.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), col)


def resource_group(code: Column) -> Column:
    pairs = [F.lit(x) for _, c, g in LANGUAGES for x in (c, g)]
    return F.try_element_at(F.create_map(*pairs), code)


def explode_runs(cells: DataFrame, cell: str = "cell", keep_empty: bool = False) -> DataFrame:
    """One row per run of a comma-separated cell: ``run`` from 0 and the ``raw`` text.

    Blank parts and parts that say none are dropped; a single text that is no number is no run. ``keep_empty`` leaves
    one row with NULLs for a cell without a run, so that it counts as 0 in what is summed up per cell.
    """
    parts = F.split(F.col(cell), ",")
    alone = F.size(parts) == 1
    usable = F.filter(
        F.transform(parts, lambda p: F.struct(strip(p).alias("raw"))),
        lambda s: ~s["raw"].isin(NO_RUN) & (~alone | as_number(s["raw"]).isNotNull()),
    )
    rest = [c for c in cells.columns if c != cell]
    each = F.posexplode_outer if keep_empty else F.posexplode
    return cells.select(*rest, each(usable).alias("run", "_s")).select(*rest, "run", "_s.raw")


def run_score(raw: Column) -> Column:
    """Score of one run; NULL if the text reports an error or is no number."""
    failed = raw.rlike("None|nan|NaN|Error") | F.contains(F.lower(raw), F.lit("err"))
    return F.when(~failed, as_number(raw))


def valid_run_rate(runs: DataFrame, by: Sequence[str], raw: str = "raw") -> DataFrame:
    """Runs with a score and their rate against the expected three, in percent."""
    valid = F.count(run_score(F.col(raw)))
    return runs.groupBy(*by).agg(valid.alias("valid_runs"), (valid / RUNS_PER_CELL * 100).alias("pass_rate"))


def parse_cell(cell: Column) -> dict[str, Column]:
    """``ok`` and ``total`` runs of a cell by the display rule."""
    parts = F.transform(F.split(strip(cell), ","), strip)
    blank = cell.isNull() | (cell == "")

    def passes(p: Column) -> Column:
        low = F.lower(p)
        bad = low.rlike("none|nan|error|unexpected|unk") | (
            F.contains(low, F.lit("es")) & (F.length(p) < 20)
        )
        return ~bad & as_number(without_parentheses(p)).isNotNull()

    return {
        "ok": F.when(blank, 0).otherwise(F.size(F.filter(parts, passes))),
        "total": F.when(blank, 0).otherwise(F.size(parts)),
    }


def pass_rate(ok: Column, total: Column) -> Column:
    """Share of passed runs, against three while there are fewer."""
    return ok / F.greatest(total, F.lit(RUNS_PER_CELL))


def pass_fraction(ok: Column, total: Column) -> Column:
    """The same as text, such as '2/3'."""
    return F.concat_ws("/", ok.cast("string"), F.greatest(total, F.lit(RUNS_PER_CELL)).cast("string"))


def relative_score(score: Column, baseline: Column, metric: Column) -> Column:
    """Score over baseline, or baseline over score where lower is better; 0 for a zero divisor."""
    up = metric.isin(HIGHER_IS_BETTER)
    above, below = F.when(up, score).otherwise(baseline), F.when(up, baseline).otherwise(score)
    return F.when(below == 0, F.lit(0.0)).otherwise(above / below)


def relative_performance(
    runs: DataFrame, by: Sequence[str], score: str = "score", baseline: str = "baseline", metric: str = "metric"
) -> DataFrame:
    """Mean and population deviation of the relative scores per cell, missing runs counting as 0."""
    ratio = F.when(F.col(score).isNotNull(), relative_score(F.col(score), F.col(baseline), F.col(metric)))
    cells = runs.groupBy(*by).agg(
        F.count(ratio).alias("runs"),
        F.coalesce(F.sum(ratio), F.lit(0.0)).alias("_s"),
        F.coalesce(F.avg(ratio), F.lit(0.0)).alias("_m"),
        F.coalesce(F.var_pop(ratio), F.lit(0.0)).alias("_v"),
    )
    n = F.greatest(F.col("runs"), F.lit(RUNS_PER_CELL))
    share = F.col("runs") / n  # the others are zeros, which add the spread between them and the mean of the runs
    spread = F.sqrt(F.col("_v") * share + F.col("_m") * F.col("_m") * share * (1 - share))
    return cells.select(*by, "runs", (F.col("_s") / n).alias("rp"), spread.alias("rp_std"))


def first_reached(r: Column, start: float, step: float, points: int) -> Column:
    """Index of the first grid value start + i * step that is not below r; ``points`` if none is."""

    def at(i: Column) -> Column:
        return F.lit(start) + i * F.lit(step)

    near = F.ceil((r - F.lit(start)) / F.lit(step))
    index = F.when(at(near - 1) >= r, near - 1).when(at(near) >= r, near).otherwise(near + 1)
    return F.least(F.greatest(index, F.lit(0)), F.lit(points)).cast("int")


def profile(cells: DataFrame, by: Sequence[str], r: str = "rp", points: int = 1001) -> DataFrame:
    """rho(tau), the share of cells with r <= tau, at ``points`` equal steps over [0, 1].

    Cells are counted per grid index first; the running total then has ``points`` rows per group.
    """
    by = list(by)
    step = 1.0 / (points - 1)
    counts = cells.groupBy(*by, first_reached(F.col(r), 0.0, step, points).alias("_i")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    gathered = counts.groupBy(*by).agg(
        F.collect_list(F.struct("_i", "_n")).alias("_have"), F.sum("_n").alias("_total")
    )  # at most points + 1 entries
    empty = F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)),
        lambda i: F.struct(i.alias("_i"), F.lit(0).cast("bigint").alias("_n")),
    )
    grid = (
        gathered.select(*by, "_total", F.explode(F.concat("_have", empty)).alias("e"))
        .groupBy(*by, "_total", F.col("e._i").alias("_i"))
        .agg(F.sum("e._n").alias("_n"))
    )
    upto = Window.partitionBy(*by).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    rho = F.sum("_n").over(upto) / F.col("_total")
    return grid.withColumn("rho", rho).filter(F.col("_i") < points).select(
        *by, (F.col("_i") * F.lit(step)).alias("tau"), "rho"
    )


def _std_tail(r: Column) -> Column:
    """Trapezoid area of the step 1[r <= tau] on 1001 points."""
    i = first_reached(r, 0.0, 0.001, 1001)
    return F.when(i == 0, 1.0).when(i <= 1000, (1000 - i) * 0.001 + 0.0005).otherwise(0.0)


def _invln_weights() -> list[float]:
    """Share of the trapezoid weight -1 / ln(tau) that lies at or after each grid point, then 0."""
    low, high = INVLN_EPS, 1 - INVLN_EPS
    step = (high - low) / (INVLN_POINTS - 1)
    taus = [low + i * step for i in range(INVLN_POINTS - 1)] + [high]
    weights = [-1.0 / math.log(t) for t in taus]
    ends = [step / 2 if i in (0, INVLN_POINTS - 1) else step for i in range(INVLN_POINTS)]
    areas = [w * e for w, e in zip(weights, ends)]
    tails, total = [0.0], 0.0
    for area in reversed(areas):
        total += area
        tails.append(total)
    return [t / total for t in reversed(tails)]


def area_terms(r: Column) -> dict[str, Column]:
    """Per-cell terms whose mean over the cells is the area under the profile.

    ``AUP_std`` integrates rho over [0, 1], ``AUP_ln`` weighs it by -ln(tau), ``AUP_invln`` by
    -1/ln(tau) on a grid. The last weight dominates, so AUP_invln is close to the share of r < 1.
    """
    step = (1 - 2 * INVLN_EPS) / (INVLN_POINTS - 1)
    at = first_reached(r, INVLN_EPS, step, INVLN_POINTS)
    at = F.when(r > 1 - INVLN_EPS, INVLN_POINTS).otherwise(F.least(at, F.lit(INVLN_POINTS - 1)))
    tail = F.get(F.array(*[F.lit(w) for w in _invln_weights()]), at)
    return {
        "AUP_std": F.greatest(F.lit(0.0), 1 - F.greatest(r, F.lit(0.0))),
        "AUP_std_grid": _std_tail(r),
        "AUP_ln": F.when(r <= 0, 1.0).when(r < 1, 1 - r + r * F.ln(r)).otherwise(0.0),
        "AUP_invln": tail,
    }


def profile_area(cells: DataFrame, by: Sequence[str], kind: str = "AUP_std", r: str = "rp") -> DataFrame:
    return cells.groupBy(*by).agg(F.avg(area_terms(F.col(r))[kind]).alias(kind))


def summary(cells: DataFrame, by: Sequence[str], r: str = "rp", rate: str | None = None) -> DataFrame:
    """All profile areas, the win rate and, if given, the mean pass rate per group.

    ``win_rate`` counts r <= 1 as published; ``beats_baseline_rate`` counts r > 1.
    """
    value = F.col(r)
    parts = [F.avg(c).alias(n) for n, c in area_terms(value).items() if n != "AUP_std_grid"]
    parts += [
        (F.avg((value <= 1).cast("double")) * 100).alias("win_rate"),
        (F.avg((value > 1).cast("double")) * 100).alias("beats_baseline_rate"),
    ]
    if rate:
        parts.append(F.avg(rate).alias("pass_rate"))
    return cells.groupBy(*by).agg(*parts)


def with_average_row(per_lang: DataFrame, by: Sequence[str], lang: str = "lang", label: str = "Avg.") -> DataFrame:
    """Append, per group, the mean over languages: a mean of means."""
    numbers = [c for c in per_lang.columns if c not in (*by, lang)]
    average = per_lang.groupBy(*by).agg(*[F.avg(c).alias(c) for c in numbers])
    return per_lang.unionByName(average.withColumn(lang, F.lit(label)))


def cell_text(area: Column, rate: Column) -> Column:
    """'0.12345 / 67%', halves of the percentage to even."""
    return F.format_string("%.5f / %.0f%%", area, F.rint(rate))


def gap_to(df: DataFrame, by: Sequence[str], lang: str, rate: str, reference: str = "EN") -> DataFrame:
    """Rate minus the reference language's rate within each group; the reference itself is dropped."""
    base = F.max(F.when(F.col(lang) == reference, F.col(rate))).over(Window.partitionBy(*by))
    return df.withColumn("gap", F.col(rate) - base).filter(F.col(lang) != reference).drop(rate)


def language_stats(df: DataFrame, by: Sequence[str], lang: str, rate: str) -> DataFrame:
    """Mean and sample deviation over competitions per language; missing rates are skipped."""
    return df.filter(F.col(rate).isNotNull()).groupBy(*by, lang).agg(
        F.avg(rate).alias("mean"), F.stddev_samp(rate).alias("std")
    )


def group_means(df: DataFrame, by: Sequence[str], code: str, rate: str) -> DataFrame:
    """Per resource group, and overall, the mean of the languages' mean rates."""
    per_lang = df.groupBy(*by, code).agg(F.avg(rate).alias("_m"))
    tagged = per_lang.withColumn("resource_group", F.explode(F.array(resource_group(F.col(code)), F.lit("all"))))
    return tagged.filter(F.col("resource_group").isNotNull()).groupBy(*by, "resource_group").agg(
        F.avg("_m").alias("mean_rate")
    )


def task_coverage(competitions: DataFrame, tasks: DataFrame, comp: str, lang: str, languages: Sequence[str]) -> DataFrame:
    """Every competition with at least one task, once per language, and whether the text is there."""
    wanted = competitions.select(comp).withColumn(lang, F.explode(F.array(*[F.lit(x) for x in languages])))
    have = tasks.select(comp, lang).distinct().withColumn("_have", F.lit(True))
    known = wanted.join(tasks.select(comp).distinct(), comp, "left_semi")
    return known.join(have, [comp, lang], "left").select(
        comp, lang, F.coalesce("_have", F.lit(False)).alias("present")
    )
