"""Result files of submissions, result sheets and report folders."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldmark.operators.leakage import pair_reports
from foldmark.session import materialize, shuffle_partitions, small_side

# fixed values: fields of a result file
RESULT = (
    "submission_id STRING, comp STRING, model STRING, lang STRING, fold INT, score DOUBLE, cv_scores ARRAY<DOUBLE>, "
    "errors ARRAY<STRING>, tracebacks ARRAY<STRING>, success BOOLEAN, grader STRING"
)
# fixed values: layout of a result sheet
FIRST_CELL, NAME_COLUMN, BASELINE_COLUMN, METRIC_COLUMN = 5, 1, 2, 4
SHEET_COLUMNS = 256  # a sheet may have at most
SHEET_ROWS = 4096  # of a task, after reading


def read_results(
    spark: SparkSession, path: str, schema: str = RESULT, indented: bool = False, corrupt: str | None = None
) -> DataFrame:
    """Result files with the path each row came from.

    ``indented`` reads one value, or one array of them, per file; else one per line. ``corrupt`` names a column that
    takes the text of what could not be read.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("multiLine", indented)
    if corrupt:
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
        schema = f"{schema}, `{corrupt}` STRING"
    df = reader.schema(schema).json(path)
    return df.withColumn("file_path", F.col("_metadata.file_path"))


def fill_right(names: Sequence[str | None]) -> list[str | None]:
    """Header row with blanks filled from the left, as merged cells are saved."""
    out: list[str | None] = []
    for name in names:
        out.append(name if name not in (None, "") else (out[-1] if out else None))
    return out


def unpivot_sheet(
    wide: DataFrame, models: Sequence[str], languages: Sequence[str], id_columns: Sequence[str]
) -> DataFrame:
    """Long cells from a sheet whose columns after ``id_columns`` belong to (model, language) pairs."""
    cells = [c for c in wide.columns if c not in id_columns]
    entries = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.lit(g).alias("lang"), F.col(f"`{c}`").cast("string").alias("cell"))
            for c, m, g in zip(cells, models, languages, strict=True)
        ]
    )
    return wide.select(*id_columns, F.explode(entries).alias("e")).select(*id_columns, "e.*")


def read_sheets(spark: SparkSession, path: str, columns: int = SHEET_COLUMNS) -> DataFrame:
    """Result sheets with two header rows, models above languages, in long form, any number of files at once.

    Columns: file, comp, baseline, metric, model, lang, cell. Each sheet has its own headers: they become a table of (file, place,
    model, language), blanks filled from the left, that the cells of the file meet by place. Records may have several lines, so
    a file is one task's work to read, and its rows keep their order in the numbers they get there. From then on they are dealt to
    tasks of ``SHEET_ROWS`` rows on average, so that what is made of their cells takes no more memory in larger sheets.
    """
    names = [f"_c{i}" for i in range(columns)]
    reader = spark.read.schema(", ".join(f"{n} STRING" for n in names)).options(header=False, escape='"', multiLine=True, recursiveFileLookup=True)
    raw = reader.csv(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"), F.array(*names).alias("cells"))
    raw = materialize(raw, "sheets")
    first = raw.groupBy("file").agg(F.min("row").alias("first"))
    placed = raw.join(small_side(first), "file").withColumn("row", F.col("row") - F.col("first"))
    heads = placed.filter("row < 2").select("file", "row", F.posexplode("cells").alias("place", "name")).filter(F.col("place") >= FIRST_CELL)
    filled = F.nullif(F.trim("name"), F.lit(""))
    heads = heads.groupBy("file", "place").agg(F.max(F.when(F.col("row") == 0, filled)).alias("model"), F.max(F.when(F.col("row") == 1, filled)).alias("lang"))
    leftwards = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)  # the columns of one sheet
    heads = heads.withColumn("model", F.last("model", True).over(leftwards)).filter("lang is not null")
    heads = heads.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("place", "model", "lang"))).alias("heads"))
    cell = F.transform("heads", lambda h: F.struct(h["model"].alias("model"), h["lang"].alias("lang"), F.get("cells", h["place"]).alias("cell")))
    tasks = max(shuffle_partitions(spark), math.ceil(raw.count() / SHEET_ROWS))
    body = placed.filter("row >= 2").repartition(tasks, "file", "row").join(small_side(heads), "file")
    return body.select(
        "file", F.get("cells", F.lit(NAME_COLUMN)).alias("comp"), F.trim(F.get("cells", F.lit(BASELINE_COLUMN))).try_cast("double").alias("baseline"),
        F.get("cells", F.lit(METRIC_COLUMN)).alias("metric"), F.explode(cell).alias("e"),
    ).select("file", "comp", "baseline", "metric", "e.*")


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """One sheet: comp, baseline, metric, model, lang, cell."""
    return read_sheets(spark, path).drop("file")


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Submissions with their report pages: every .py but .ir.py, its .html or NULLs."""

    def texts(pattern: str) -> DataFrame:
        reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
        found = reader.text(folder, wholetext=True)
        return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))

    return pair_reports(texts("*.py"), texts("*.html"))
