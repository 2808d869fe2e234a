"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Every source gets a share of all words by its weight, but at most ``limit`` times what it has; the excess goes to
the others by weight (water filling in closed form). A source is then taken in whole epochs, and the rest of its
target as a weighted sample without replacement: a document with quality weight w draws u from a digest of the row
and has the key u ** (1 / w). Documents enter by falling key while the running sum of words is below the rest; the
document at the edge gives the words that are still missing. Keys are handled as -ln(u) / w, which falls where
the key rises.

The edge is found without sorting a source: words are summed per slice of keys and per block of slices, then only the
block, the slice and the keys around the edge are sorted. Taking is a comparison of each row with its source's edge.

Edge cases: null text is 0 words and is taken as 0; a null source is a source, the last one; rows that repeat draw
the same key and share what is missing at the edge evenly; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldmark.llm.common import WORD
from foldmark.session import materialize, small_side

WEIGHTS = (1.0, 2.0, 3.0)  # of the sources by code point, repeating
LIMIT = 3
SEED = 7
SLICE_ROWS = 2_000  # rows of the whole table per slice of keys
OUTPUT = ("size", "source_size", "target", "taken")
MARKS = "#*$%&|<>!~^={}[]"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, words: Column) -> Column:
    """1 to 10: 10 without marks, 1 with a mark per word or more."""
    marks = F.length(text) - F.length(F.translate(text, MARKS, ""))
    share = F.least(F.lit(1.0), F.coalesce(marks, F.lit(0)) / F.greatest(words, F.lit(1)))
    return F.lit(10.0) - F.lit(9.0) * share


def draw(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """Uniform in (0, 1), the same on every run for the same row."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    head = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return (head + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """Add ``target`` to (source, source_size): one row per source, so the windows below hold sources only."""
    ranked = sizes.withColumn("_r", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_r") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * float(limit))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "_r")
    before = F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    ranked = ranked.withColumn("_level", (total - before) / open_weight).withColumn("_place", F.row_number().over(by_ratio))
    fits = F.col("_level") * F.col("_w") <= F.col("_cap")
    level = F.min(F.when(fits, F.struct("_place", "_level"))).over(Window.partitionBy())["_level"]
    ranked = ranked.withColumn("_water", level)
    target = F.coalesce(F.least("_cap", F.col("_water") * F.col("_w")), F.col("_cap"))
    return ranked.select("source", "source_size", target.alias("target"))


def _first_to_reach(parts: DataFrame, by: str) -> DataFrame:
    """Of each source the first ``by`` at which the running sum of n reaches rest, with its n and what is missing before it as rest."""
    upto = F.sum("n").over(Window.partitionBy("source").orderBy(by))
    met = parts.withColumn("upto", upto).filter("upto >= rest").withColumn("rest", F.col("rest") - F.col("upto") + F.col("n"))
    return met.groupBy("source").agg(F.min(F.struct(by, "n", "rest")).alias("m")).select("source", "m.*")


def _within(rows: DataFrame, marks: DataFrame, by: str | None = None) -> DataFrame:
    """The rows of the marked sources, or of the marked ``by`` of each source, with the mark's rest."""
    own = marks.select(F.col("source").alias("_s"), *([F.col(by).alias("_at")] if by else []), "rest")
    same = F.col("source").eqNullSafe(F.col("_s"))
    return rows.join(small_side(own), same & (F.col(by) == F.col("_at")) if by else same).drop("_s", "_at")


def _edges(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """The key at which the fractional part of each source ends, the words missing there and the words that tie.

    Found in three steps, blocks of slices, slices, keys; each window holds about the square root of the slices or one slice.
    """
    slices = max(64, -(-rows.count() // SLICE_ROWS))
    place = 1.0 - (F.exp(-F.col("key")) + F.exp(-F.col("key") * 10.0)) / 2.0  # near even for weights from 1 to 10
    number = F.least(F.floor(place * slices), F.lit(slices - 1)).cast("long")
    sliced = rows.filter("size > 0").withColumn("slice", number)
    sums = materialize(sliced.groupBy("source", "slice").agg(F.sum("size").alias("n")), "mixing")
    sums = sums.withColumn("block", F.floor(F.col("slice") / math.isqrt(slices)))
    blocks = sums.groupBy("source", "block").agg(F.sum("n").alias("n"))
    block = _first_to_reach(_within(blocks, goals.filter("rest > 0")), "block")
    piece = _first_to_reach(_within(sums, block, "block"), "slice")
    tied = _within(sliced, piece, "slice").groupBy("source", "key", "rest").agg(F.sum("size").alias("n"))
    edge = _first_to_reach(tied, "key")
    return edge.select(F.col("source").alias("_s"), F.col("key").alias("_key"), F.col("n").alias("_tie"), F.col("rest").alias("_missing"))


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, limit: int = LIMIT, seed: int = SEED, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, source_size, target and taken per row, and the columns of ``carry``; columns named like a result give way."""
    text, size = F.col("text"), F.col("size")
    others = [c for c in dict.fromkeys(carry) if c not in ("doc_id", "source") and c not in OUTPUT]
    rows = docs.select("doc_id", "source", *[F.col(c).alias(f"_carried_{c}") for c in others], n_words(text).alias("size"), F.col("text").alias("_text"))
    key = -F.log(draw(F.col("doc_id"), F.col("_text"), seed)) / quality_weight(F.col("_text"), size)
    rows = rows.withColumn("key", key).drop("_text")
    rows = materialize(rows, "mixing")
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, limit)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = goals.withColumn("epochs", epochs).withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    goals = materialize(goals, "mixing")
    marks = goals.join(small_side(_edges(rows, goals)), F.col("source").eqNullSafe(F.col("_s")), "left").select(
        F.col("source").alias("_source"), "source_size", "target", "epochs", "_key", "_tie", "_missing"
    )
    part = (
        F.when(F.col("key") < F.col("_key"), size)
        .when(F.col("key") == F.col("_key"), F.floor(size * F.col("_missing") / F.col("_tie")).cast("long"))
        .otherwise(F.lit(0))
    )
    out = rows.join(small_side(marks), F.col("source").eqNullSafe(F.col("_source")))
    taken = (F.col("epochs") * size + part).cast("long").alias("taken")
    brought = ["source"] * ("source" in carry) + [F.col(f"_carried_{c}").alias(c) for c in others]
    return out.select("doc_id", *brought, "size", "source_size", "target", taken)


ORACLE = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5('7|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u,
    coalesce(length(text) - length(translate(text, '#*$%&|<>!~^={}[]', '')), 0) AS marks
  FROM documents),
k AS (SELECT *, -ln(u) / (10.0::DOUBLE - 9.0::DOUBLE * least(1.0::DOUBLE, marks::DOUBLE / greatest(size, 1))) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) AS r FROM d GROUP BY source),
w AS (SELECT *, (1 + r % 3)::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, row_number() OVER o AS place,
    ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY cap / w, r)),
t AS (SELECT source, source_size, coalesce(least(cap, w * (SELECT arg_min(level, place) FROM l WHERE level * w <= cap)), cap) AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
h AS (SELECT *, floor(target - epochs * source_size)::BIGINT AS rest FROM g),
c AS (SELECT k.doc_id, k.size, h.source_size, h.target, h.epochs, h.rest,
    (sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key))::BIGINT AS upto, (sum(k.size) OVER (PARTITION BY k.source, k.key))::BIGINT AS tie
  FROM k JOIN h ON k.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + CASE WHEN size = 0 OR rest = 0 THEN 0 WHEN upto < rest THEN size WHEN upto - tie < rest AND upto = rest THEN size
     WHEN upto - tie < rest THEN floor(size * (rest - upto + tie)::DOUBLE / tie)::BIGINT ELSE 0 END)::BIGINT AS taken
FROM c"""
