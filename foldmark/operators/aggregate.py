"""Grouped summaries. Rows are counted per distinct value before anything is ranked or compared."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldmark.operators.ordering import Key, exact_quantiles, positions
from foldmark.session import small_side


def ranked_chunks(
    df: DataFrame, by: Sequence[str], item: str, order: Sequence[str | Key], chunk: int = 1000
) -> DataFrame:
    """Ordered items per group as arrays of at most ``chunk`` entries, numbered along the order.

    A group of any length stays whole: it spreads over as many rows as it needs.
    """
    placed = positions(df, order, by, "_p")
    cell = placed.withColumn("chunk", F.floor((F.col("_p") - 1) / chunk).cast("int"))
    listed = F.sort_array(F.collect_list(F.struct("_p", F.col(item).alias("item"))))
    return cell.groupBy(*by, "chunk").agg(F.transform(listed, lambda s: s["item"]).alias("items"))


def frequency_table(df: DataFrame, col: str) -> DataFrame:
    """Count and share per value, missing values left out."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    shared = counts.crossJoin(F.broadcast(total))
    return shared.select(col, "n", (F.col("n") / F.col("_total")).alias("share"))


def frequency_encode(df: DataFrame, col: str, out: str, missing: str = "unknown") -> DataFrame:
    """Number of rows with the same value, on every row; missing values count as one value."""
    filled = F.coalesce(F.col(col).cast("string"), F.lit(missing))
    keyed = df.withColumn("_f", filled)
    counts = keyed.groupBy("_f").agg(F.count(F.lit(1)).alias(out))
    return keyed.join(small_side(counts), "_f").drop("_f")


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, quartiles and max per column, in long form."""
    quartiles = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    stats = df.agg(
        *[
            F.struct(
                F.count(c).cast("double").alias("count"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"),
                *[
                    F.lit(v).cast("double").alias(f"p{p}")
                    for p, v in zip((25, 50, 75), quartiles[c])
                ],
                F.max(c).cast("double").alias("max"),
            ).alias(c)
            for c in cols
        ]
    )
    long = stats.unpivot([], list(cols), "column_name", "s")
    return long.select("column_name", "s.*")


def distinct_counts(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column; ``approximate`` uses a sketch."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(c).alias(c) for c in cols]).unpivot([], list(cols), "column_name", "n")


def correlations(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of each column with the target, one scan, best first."""
    wide = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in cols])
    long = wide.unpivot([], list(cols), "feature", "correlation")
    return long.orderBy(F.col("correlation").desc_nulls_last())


def confusion(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per (truth, prediction)."""
    return df.groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(df: DataFrame, truth: str, pred: str, classes: Sequence) -> DataFrame:
    """One row per true class, one column ``pred_<class>`` per given class."""
    cells = confusion(df, truth, pred)
    wide = cells.groupBy("truth").pivot("pred", list(classes)).agg(F.sum("n"))
    return wide.fillna(0).select("truth", *[F.col(str(c)).alias(f"pred_{c}") for c in classes])


def class_counts(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Per class of truth or prediction: ``support``, ``predicted`` and ``hits``."""
    cells = confusion(df.filter(F.col(truth).isNotNull() & F.col(pred).isNotNull()), truth, pred, by)
    zero = F.lit(0).cast("bigint")
    same = F.col("truth") == F.col("pred")
    parts = F.array(
        F.struct(
            F.col("truth").alias("class"), F.col("n").alias("t"), zero.alias("p"),
            F.when(same, F.col("n")).otherwise(zero).alias("h"),
        ),
        F.struct(F.col("pred").alias("class"), zero.alias("t"), F.col("n").alias("p"), zero.alias("h")),
    )
    long = cells.select(*by, F.explode(parts).alias("r"))
    return long.groupBy(*by, F.col("r.class").alias("class")).agg(
        F.sum("r.t").alias("support"), F.sum("r.p").alias("predicted"), F.sum("r.h").alias("hits")
    )


def share(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def class_report(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1, support and accuracy per class."""
    t, p, h = F.col("support"), F.col("predicted"), F.col("hits")
    return class_counts(df, truth, pred, by).select(
        *by, "class", share(h, p).alias("precision"), share(h, t).alias("recall"),
        share(2 * h, t + p).alias("f1"), "support",
        F.when(t > 0, h / t).alias("accuracy"),
    )


def fold_mean(scores: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    """Mean over the folds that have a score; ``success`` is false where none has."""
    valid = F.when(~F.isnan(score), F.col(score))
    return scores.groupBy(*by).agg(
        F.avg(valid).alias("score"),
        F.count(F.lit(1)).alias("folds"),
        F.count(valid).alias("valid_folds"),
        (F.count(valid) > 0).alias("success"),
    )


def best_row(df: DataFrame, by: Sequence[str], metric: str, keep: Sequence[str], lowest: bool = False) -> DataFrame:
    """Columns ``keep`` of the row with the best metric; ties go to the smallest kept values."""
    value = F.col(metric) if lowest else -F.col(metric)
    lead = F.min(F.struct(value.alias("v"), *keep))
    return df.filter(F.col(metric).isNotNull()).groupBy(*by).agg(lead.alias("b")).select(
        *by, *[F.col(f"b.{c}") for c in keep],
        (F.col("b.v") if lowest else -F.col("b.v")).alias(metric),
    )


def top_rows(df: DataFrame, order: Sequence[str | Key], n: int) -> DataFrame:
    """The first n rows of the order."""
    keys = [k if isinstance(k, Key) else Key(k.lstrip("-"), not k.startswith("-")) for k in order]
    return df.orderBy(*[k.column() for k in keys]).limit(n)


def mean_std(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Mean with population and sample standard deviation."""
    return df.groupBy(*by).agg(
        F.avg(col).alias("mean"), F.stddev_pop(col).alias("std_pop"), F.stddev_samp(col).alias("std_samp")
    )


def pivot(df: DataFrame, row: str, column: str, values: Sequence, agg: Column) -> DataFrame:
    """One column per given value."""
    return df.groupBy(row).pivot(column, list(values)).agg(agg)


def in_order(df: DataFrame, col: str, order: Sequence[str]) -> DataFrame:
    """Sort rows by a fixed list of values; values outside it come last."""
    place: Mapping[str, int] = {v: i for i, v in enumerate(order)}
    pairs = [F.lit(x) for kv in place.items() for x in kv]
    return df.withColumn("row_order", F.try_element_at(F.create_map(*pairs), F.col(col))).orderBy(
        F.col("row_order").asc_nulls_last()
    )
