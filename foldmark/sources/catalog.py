"""Dataset catalog and per-language task texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmark.operators.leaderboard import LANGUAGES

# fixed values: fields of a catalog entry
ENTRY = (
    "metric STRING, target_col STRING, direction STRING, cv_folds INT, output_hint STRING, grader STRING, "
    "split_strategy STRING, load_strategy STRING, stratified_split BOOLEAN, weight_col STRING, "
    "exclude_cols ARRAY<STRING>, image_col STRING, time_col STRING, map_k INT, beta DOUBLE, binary_threshold INT, "
    "files MAP<STRING, STRUCT<type: STRING, required: BOOLEAN, extensions: ARRAY<STRING>>>, "
    "file_mapping MAP<STRING, STRUCT<filename: STRING, type: STRING, required: BOOLEAN>>"
)
TASK = "`comp-id` STRING, description STRING, data_card STRING, domain STRING, metric STRING"


def parse_catalog(texts: DataFrame, col: str = "value") -> DataFrame:
    """One row per entry of JSON objects keyed by id; keys that start with '_' are skipped.

    ``target_col`` becomes an array whether the entry gives one name or a list. Unset folds, grader and
    strategies get their defaults.
    """
    entries = texts.select(F.explode(F.from_json(col, "MAP<STRING, STRING>")).alias("comp_id", "_json"))
    parsed = entries.filter(~F.startswith("comp_id", F.lit("_"))).select(
        "comp_id", F.from_json("_json", ENTRY).alias("e")
    ).select("comp_id", "e.*")
    target = F.when(
        F.startswith("target_col", F.lit("[")), F.from_json("target_col", "ARRAY<STRING>")
    ).otherwise(F.array("target_col"))
    # fixed values: defaults of a catalog entry
    defaults = {"cv_folds": 1, "grader": "default", "split_strategy": "csv", "load_strategy": "default", "stratified_split": False}
    return parsed.withColumn("target_col", F.when(F.col("target_col").isNotNull(), target)).fillna(defaults)


def read_catalog(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Catalog files: one JSON object per file, or per line with ``lines``."""
    return parse_catalog(spark.read.text(path, wholetext=not lines))


def read_tasks(
    spark: SparkSession, path: str, schema: str = TASK, pattern: str = r"([^/.]+)\.[^/]*$",
    languages: list[str] | None = None,
) -> DataFrame:
    """Task rows of all language files with ``lang`` from the file path; an unknown language is an error."""
    known = languages if languages is not None else [name for name, _, _ in LANGUAGES]
    rows = (
        spark.read.options(header=True, escape='"', multiLine=True, recursiveFileLookup=True)
        .schema(schema)
        .csv(path)
        .withColumn("lang", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))
    )
    strange = [r["lang"] for r in rows.filter(~F.col("lang").isin(known)).select("lang").distinct().limit(10).collect()]
    if strange:
        raise ValueError(f"no such language: {strange}")
    return rows
