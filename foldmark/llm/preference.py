"""Preference formatting of pairs of conversations.

For a pair of a chosen and a rejected conversation, the longest common prefix of turns is the prompt and is rendered
once; what follows on either side is its completion. The result has one row per rendered turn, so that no
conversation has to fit into one task: pair_id, part (prompt, chosen, rejected), turn, role, rendered and trained.
Joining ``rendered`` of a part by ``turn`` gives its text. ``trained`` is the loss mask: true for assistant turns of
the completions, never for the prompt.

Turns are aligned by their number, and rows that share one by their place among them, in order of (role, text). Edge cases: null
roles and texts render as empty, and are equal to each other but not to empty ones; a null turn stands before all others; rows without conv_id, and pairs of which neither side has turns, have no result; a side without turns leaves the
other as a completion; equal conversations are all prompt; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldmark.operators.ordering import positions
from foldmark.session import materialize

FIRST = -(1 << 62)  # stands for a null turn


def formatted(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rendered turns of every pair; ``pairs`` has pair_id, chosen_id and rejected_id."""
    sides = pairs.select(
        "pair_id",
        F.explode(
            F.array(
                F.struct(F.lit(True).alias("chosen"), F.col("chosen_id").alias("conv")),
                F.struct(F.lit(False).alias("chosen"), F.col("rejected_id").alias("conv")),
            )
        ).alias("side"),
    ).select("pair_id", "side.chosen", "side.conv").filter("conv is not null").distinct()
    said = _placed(turns.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(FIRST)).alias("turn"), "role", "text"))
    said = said.select("conv_id", "turn", "place", F.struct("role", "text").alias("said"))
    placed = said.join(sides, F.col("conv_id") == F.col("conv"))
    each = placed.groupBy("pair_id", "turn", "place").agg(
        F.min(F.when(F.col("chosen"), F.col("said"))).alias("c"), F.min(F.when(~F.col("chosen"), F.col("said"))).alias("r")
    )
    return _rendered(each)


def _placed(said: DataFrame) -> DataFrame:
    """Add ``place``, 1 where a row has its turn for itself; only rows that share one are sorted, in slices."""
    said = said.filter("conv_id is not null")
    shared = said.groupBy(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn")).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    shared = materialize(shared.select("_conv", "_turn"), "preference")
    if shared.isEmpty():
        return said.withColumn("place", F.lit(1).cast("long"))
    same = (F.col("conv_id") == F.col("_conv")) & (F.col("turn") == F.col("_turn"))
    alone = said.join(shared, same, "left_anti").withColumn("place", F.lit(1).cast("long"))
    ranked = said.join(shared, same, "left_semi").withColumns({"_r": F.col("role").isNotNull(), "_t": F.col("text").isNotNull()})
    ranked = positions(ranked, ["_r", "role", "_t", "text"], by=["conv_id", "turn"], name="place")  # nulls first, as in the order of structs
    return alone.unionByName(ranked.drop("_r", "_t"))


def _rendered(each: DataFrame) -> DataFrame:
    """From one row per pair and turn with both sides to the parts."""
    same = F.col("c").eqNullSafe(F.col("r"))
    at = F.struct("turn", "place")
    cut = each.groupBy(F.col("pair_id").alias("_pair")).agg(F.min(F.when(~same, at)).alias("_cut"))
    laid = each.join(cut, F.col("pair_id").eqNullSafe(F.col("_pair")))
    prompt = F.col("_cut").isNull() | (at < F.col("_cut"))

    def part(name: str, said: str):
        return F.struct(F.lit(name).alias("part"), F.col(said).alias("said"))

    parts = F.when(prompt, F.array(part("prompt", "c"))).otherwise(F.array(part("chosen", "c"), part("rejected", "r")))
    rows = laid.select("pair_id", "turn", F.explode(parts).alias("p")).filter("p.said is not null")
    role, text = F.coalesce("p.said.role", F.lit("")), F.coalesce("p.said.text", F.lit(""))
    return rows.select(
        "pair_id",
        F.col("p.part").alias("part"),
        F.when(F.col("turn") != FIRST, F.col("turn")).alias("turn"),
        F.col("p.said.role").alias("role"),
        F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n")).alias("rendered"),
        ((role == "assistant") & (F.col("p.part") != "prompt")).alias("trained"),
    )


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """Pairs of neighbouring conversations: 2k chosen, 2k + 1 rejected; either may be missing."""
    ids = turns.select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id")).filter("pair_id is not null").distinct()
    return ids.select("pair_id", (F.col("pair_id") * 2).alias("chosen_id"), (F.col("pair_id") * 2 + 1).alias("rejected_id"))


def _is_reply() -> Column:
    """Whether a row is the assistant's at the last turn, ``last``, that has any."""
    return F.coalesce((F.col("turn") == F.col("last")) & (F.col("role") == "assistant"), F.lit(False))


def swapped_replies(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and pairs made of conversations that hold an assistant's turn with a number.

    Conversation c up to the last such turn is chosen as 2c; rejected, as 2c + 1, are the same turns with the reply of
    the next such conversation by number (after the last, the first) in place of its own. Of several replies at a last turn, all
    are chosen and the least is handed on. Rows without a number come before the reply like any other.
    """
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").filter("conv_id is not null")
    last = turns.filter("role = 'assistant' and turn is not null").groupBy(F.col("conv_id").alias("_conv")).agg(F.max("turn").alias("last"))
    upto = turns.join(last, F.col("conv_id") == F.col("_conv")).drop("_conv").filter("turn is null or turn <= last")
    replies = upto.filter(_is_reply()).groupBy("conv_id", "last").agg(F.min(F.struct("text")).alias("reply"))
    numbered = materialize(positions(replies.select("conv_id", "last", "reply.text"), ["conv_id"], name="k"), "preference")
    n = numbered.count()
    previous = F.when(F.col("k") == 1, F.lit(n)).otherwise(F.col("k") - 1)
    given = numbered.select(previous.alias("_k"), F.col("text").alias("_text"))
    swapped = numbered.join(given, F.col("k") == F.col("_k"))
    rejected = upto.filter(~_is_reply()).select("conv_id", "turn", "role", "text").unionByName(
        swapped.select("conv_id", F.col("last").alias("turn"), F.lit("assistant").alias("role"), F.col("_text").alias("text"))
    )
    both = upto.select((F.col("conv_id") * 2).alias("conv_id"), "turn", "role", "text").unionByName(
        rejected.select((F.col("conv_id") * 2 + 1).alias("conv_id"), "turn", "role", "text")
    )
    pairs = numbered.select(F.col("conv_id").alias("pair_id"), (F.col("conv_id") * 2).alias("chosen_id"), (F.col("conv_id") * 2 + 1).alias("rejected_id"))
    return both, pairs


ORACLE = f"""
WITH v AS (SELECT * FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, max(turn) AS last FROM v WHERE role = 'assistant' AND turn IS NOT NULL GROUP BY conv_id),
p AS (SELECT v.*, l.last, coalesce(turn = last AND role = 'assistant', false) AS reply FROM v JOIN l USING (conv_id) WHERE turn IS NULL OR turn <= last),
w AS (SELECT conv_id, last, min(text) AS text, count(text) = count(*) AS whole FROM p WHERE reply GROUP BY conv_id, last),
g AS (SELECT conv_id, last, coalesce(lead(CASE WHEN whole THEN text END) OVER o, CASE WHEN lead(conv_id) OVER o IS NULL THEN first_value(CASE WHEN whole THEN text END) OVER o END) AS text
  FROM w WINDOW o AS (ORDER BY conv_id)),
b AS (SELECT conv_id AS pair_id, true AS chosen, turn, role, text FROM p
  UNION ALL SELECT conv_id, false, turn, role, text FROM p WHERE NOT reply
  UNION ALL SELECT conv_id, false, last, 'assistant', text FROM g),
m AS (SELECT pair_id, chosen, coalesce(turn, {FIRST}) AS turn, role, text,
    row_number() OVER (PARTITION BY pair_id, chosen, turn ORDER BY role NULLS FIRST, text NULLS FIRST) AS place FROM b),
c AS (SELECT * FROM m WHERE chosen), r AS (SELECT * FROM m WHERE NOT chosen),
e AS (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.turn, r.turn) AS turn, coalesce(c.place, r.place) AS place, c.place AS cp, r.place AS rp,
    c.role AS crole, c.text AS ctext, r.role AS rrole, r.text AS rtext,
    c.place IS NOT NULL AND r.place IS NOT NULL AND c.role IS NOT DISTINCT FROM r.role AND c.text IS NOT DISTINCT FROM r.text AS same
  FROM c FULL JOIN r ON c.pair_id = r.pair_id AND c.turn = r.turn AND c.place = r.place),
u AS (SELECT pair_id, min(CASE WHEN NOT same THEN row(turn, place) END) AS cut FROM e GROUP BY pair_id),
a AS (SELECT e.*, cut IS NULL OR row(turn, place) < cut AS prompt FROM e JOIN u USING (pair_id)),
o AS (SELECT pair_id, 'prompt' AS part, turn, crole AS role, ctext AS text FROM a WHERE prompt
  UNION ALL SELECT pair_id, 'chosen', turn, crole, ctext FROM a WHERE NOT prompt AND cp IS NOT NULL
  UNION ALL SELECT pair_id, 'rejected', turn, rrole, rtext FROM a WHERE NOT prompt AND rp IS NOT NULL)
SELECT pair_id, part, nullif(turn, {FIRST}) AS turn, role, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS rendered,
  coalesce(role, '') = 'assistant' AND part <> 'prompt' AS trained FROM o"""
