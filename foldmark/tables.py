"""Access to the parquet tables of a scale-factor folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foldmark.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the folder."""
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")
