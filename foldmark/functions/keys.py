"""Portable row keys: the same rows fall on the same side on every engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SPACE = 1 << 32


def row_digest(keys: list[str], seed: int = 42) -> Column:
    """32 hex digits, uniform over rows; text order of the digest is a seeded shuffle."""
    parts = [F.lit(str(seed))] + [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def digest_head(digest: Column, digits: int = 8) -> Column:
    """Leading hex digits of a digest as a number."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def row_hash(keys: list[str], seed: int = 42) -> Column:
    """Uniform integer in [0, 2**32) per key."""
    return digest_head(row_digest(keys, seed))
