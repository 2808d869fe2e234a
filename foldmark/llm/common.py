"""Columns and tables that the operators share.

Words are maximal runs without the white space bytes space and \\t to \\r. Texts that are null count as empty.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmark.tables import table as read_table

WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = 16 * 1024 * 1024  # of an Arrow batch; long texts come in smaller batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the folder, read so that Python workers get batches of bounded size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return read_table(spark, sf_dir, name)


def ascii_lower(col: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def words(col: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(WORD), F.lit(0))


def crc_part(col: Column, parts: int) -> Column:
    """crc32 of the value as text, modulo ``parts``; null counts as the empty text."""
    return F.pmod(F.coalesce(F.crc32(col.cast("string").cast("binary")), F.lit(0)), F.lit(parts))
