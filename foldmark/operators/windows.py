"""Order-dependent features per group, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldmark.operators.ordering import Key, as_keys, lagged, positions, running


def running_sums(df: DataFrame, by: Sequence[str], order: Sequence[str | Key], cols: dict[str, str]) -> DataFrame:
    """Cumulative sums within the group; ``cols`` maps a new name to an SQL expression."""
    return running(df, order, by, sums={n: F.expr(e) for n, e in cols.items()})


def lags(df: DataFrame, by: Sequence[str], order: Sequence[str | Key], col: str, steps: int) -> DataFrame:
    """Values 1..steps rows earlier, 0 where there is none or it is missing."""
    out = lagged(df, order, by, col, steps, "_lag")
    return out.withColumns(
        {f"{col}_lag{k}": F.coalesce(F.col(f"_lag{k}"), F.lit(0)) for k in range(1, steps + 1)}
    ).drop(*[f"_lag{k}" for k in range(1, steps + 1)])


def lag_differences(df: DataFrame, col: str, steps: Sequence[int]) -> DataFrame:
    """Value minus its lag, for lag columns made by ``lags``."""
    return df.withColumns({f"{col}_diff{k}": F.col(col) - F.col(f"{col}_lag{k}") for k in steps})


def rank_in_group(df: DataFrame, by: Sequence[str], order: Sequence[str | Key], out: str = "rank") -> DataFrame:
    """1-based rank without ties: the later keys of ``order`` decide."""
    return positions(df, order, by, out)


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[str | Key], k: int, out: str = "rank") -> DataFrame:
    """First k rows per group. Each task keeps at most k rows per group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*[key.column() for key in as_keys(order)])
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def merge_rows(*frames: DataFrame) -> DataFrame:
    """Append rows of different columns; a column a frame lacks is NULL there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def last_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last along ``order``."""
    rest = [c for c in df.columns if c not in key]
    lead = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*key).agg(lead.alias("_r")).select(*key, *[F.col(f"_r.{c}") for c in rest])
