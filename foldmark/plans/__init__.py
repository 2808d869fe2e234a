"""Registered queries: one Spark plan per operator, with the SQL that must give the same rows."""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_MODULES = (
    "sources",
    "cleaning",
    "splits",
    "joins",
    "aggregates",
    "windows",
    "metrics",
    "encoders",
    "models",
    "leaderboard",
    "leakage",
    "contract",
    "streaming",
)

# Integer widths: SQL functions count in 64 bits where Spark returns 32, and the other way round for literals.
NARROW = {
    "SPL3_quantile_stratified": ["bin"],
    "SPL4_kfold": ["fold"],
    "SPL5_stratified_kfold": ["fold"],
    "SPL6_group_kfold": ["fold"],
    "SPL6_group_kfold_balanced": ["fold"],
    "SPL8_time_expanding": ["fold"],
    "SPL9_time_series_split": ["fold"],
    "SPL_leak_check": ["fold"],
    "SRC3_catalog": ["cv_folds"],
    "SRC6_fold_sink": ["fold"],
    "SRC12_report_pairs": ["html_length"],
    "MTH7_age": ["fixed_age", "data_age"],
    "DAT1_date_parts": ["at_year", "at_month", "at_day", "at_hour", "at_weekday"],
    "DAT2_unix_seconds": ["at_year", "at_month", "at_weekday", "at_hour"],
    "DAT4_year_prefix": ["fiscal_year"],
    "STR4_text_statistics": [
        "char_count", "word_count", "sentence_count", "exclamation_count", "question_count", "tag_count"
    ],
    "ARR4_element_count": ["parts"],
    "TOP1_top_k_per_group": ["rank"],
    "MET22_rank_format": ["item"],
    "TXT1_tokens_bigrams": ["words", "terms"],
    "IMG1_histogram_features": ["filled"],
    "LK2_leakage_counts": ["preprocessing_leakage", "overlap_leakage", "no_independence"],
}
WIDE = {
    "SPL_leak_check": ["shared_keys"],
    "MET8_log_loss": ["bad_rows"],
    "MET8_log_loss_multiclass": ["bad_rows"],
    "UDF3_custom_metric": ["bad_rows"],
}


def _sized(name: str, sql: str) -> str:
    """The oracle with its integer columns as wide as Spark's."""
    casts = [f"CAST({c} AS INTEGER) AS {c}" for c in NARROW.get(name, ())]
    casts += [f"CAST({c} AS BIGINT) AS {c}" for c in WIDE.get(name, ())]
    return f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql})" if casts else sql


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``fn(spark, sf_dir)`` under ``name`` with its oracle, if SQL can express it."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = _sized(name, sql)
        return fn

    return register


def load_all() -> None:
    """Import every plan module once."""
    here = os.path.dirname(__file__)
    for module in _MODULES:
        if not os.path.exists(os.path.join(here, module + ".py")):
            continue
        importlib.import_module(f"foldmark.plans.{module}")
