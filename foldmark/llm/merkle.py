"""Merkle manifest of a dataset: a digest tree per source, one root over the sources, and a proof per row.

A row is a leaf: the digest of its fields, each with its length, so that no two rows have the same bytes. Leaves are
numbered per source, and every ``FAN`` consecutive nodes become the digest of their digests, level by level, until one
is left, the subroot; the subroots in order of their sources become the root in the same way.

Each level is one window over runs of ``FAN`` nodes. Lag and lead columns at the fixed offsets 1 to FAN - 1, masked by
the slot of a node in its run and by the length of the run, are its siblings; the row in slot 0 hashes itself and its
siblings to the parent. A window holds one run, so a source with a third of all rows is spread like any other, and
every level has a FAN-th of the rows of the level below. Numbers come from slices of (source, doc_id), never from a
window over a source. Levels are kept as tables, so a lost executor costs a part of one level.

Proofs go down the same way: a node's path is its slot and siblings and then the path of its parent, joined by (source, run).

Edge cases: a null field is ``-``; a null source is a source, the first; rows without a doc_id come last in their source,
by their digest, and belong to the part of the rows that are tampered with; rows with one doc_id stand by their
digest; rows that repeat are leaves of their own, next to each other; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldmark.llm.common import ascii_lower, crc_part
from foldmark.operators.ordering import SLICE, as_keys, with_slices
from foldmark.session import materialize, small_side

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED_PARTS = 5
STEPS = "array<struct<slot:int,siblings:string>>"


def framed(col: Column) -> Column:
    """A value with its length in bytes before it, so that fields cannot run into each other."""
    value = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_of(text: Column) -> Column:
    return digest(*[framed(text if name == "text" else F.col(name)) for name in FIELDS])


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add the place from 0 within ``grp`` along ``order`` and the size of the group, as pos and n."""
    sliced = with_slices(rows, order, by=["grp"])
    sizes = sliced.groupBy("grp", SLICE).count()
    earlier = Window.partitionBy("grp").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select(
        F.col("grp").alias("_grp"), F.col(SLICE).alias("_at"), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_start"),
        F.sum("count").over(Window.partitionBy("grp")).alias("n"),
    )
    cell = Window.partitionBy("grp", SLICE).orderBy(*[k.column() for k in as_keys(order)])
    placed = sliced.withColumn("_row", F.row_number().over(cell) - 1)
    met = placed.join(small_side(start), (F.col("grp") == F.col("_grp")) & (F.col(SLICE) == F.col("_at")))
    return met.withColumn("pos", F.col("_row") + F.col("_start")).drop(SLICE, "_row", "_grp", "_at", "_start")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Add run, slot and siblings, the digests of the others of the run from left to right, to (grp, pos, n, h)."""
    run = F.floor(F.col("pos") / FAN).cast("long")
    nodes = nodes.withColumns({"run": run, "slot": (F.col("pos") % FAN).cast("int")})
    length = F.least(F.lit(FAN), F.col("n") - F.col("run") * FAN)
    order = Window.partitionBy("grp", "run").orderBy("pos")
    left = [F.when(F.col("slot") >= d, F.lag("h", d).over(order)) for d in range(FAN - 1, 0, -1)]
    right = [F.when(F.col("slot") + d < length, F.lead("h", d).over(order)) for d in range(1, FAN)]
    return nodes.withColumn("siblings", F.concat_ws("", *left, *right))


def _parents(nodes: DataFrame) -> DataFrame:
    """The nodes one level up, from the first child of every run."""
    first = nodes.filter("slot = 0 and n > 1")
    return first.select("grp", F.col("run").alias("pos"), F.ceil(F.col("n") / FAN).cast("long").alias("n"), digest(F.col("h"), F.col("siblings")).alias("h"))


def climbed(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """All levels from ``nodes`` up, with siblings, and (grp, h) of the one node that is left of each group.

    The levels above the first are kept with their siblings; those of the first are made anew where they are read, which moves less.
    """
    levels = [with_siblings(nodes)]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        above = materialize(_parents(levels[-1]), "merkle")
        most = -(-most // FAN)
        levels.append(materialize(with_siblings(above), "merkle"))
    tops = [nodes, *levels[1:]]
    top = tops[0].filter("n = 1").select("grp", "h")
    for level in tops[1:]:
        top = top.unionByName(level.filter("n = 1").select("grp", "h"))
    return levels, top


def with_paths(levels: list[DataFrame]) -> DataFrame:
    """The nodes of the first level with ``path``: slot and siblings of each level up to the last node."""
    above = None
    for level in reversed(levels):
        step = F.array(F.struct("slot", "siblings"))
        path = F.when(F.col("n") > 1, step).otherwise(F.array()).cast(STEPS)
        if above is not None:
            parent = above.select(F.col("grp").alias("_grp"), F.col("pos").alias("_pos"), F.col("path").alias("_path"))
            level = level.join(parent.hint("merge"), (F.col("grp") == F.col("_grp")) & (F.col("run") == F.col("_pos")), "left")
            path = F.concat(path, F.coalesce("_path", F.array().cast(STEPS)))
        above = level.withColumn("path", path).drop("run", "slot", "siblings", "_grp", "_pos", "_path")
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""

    def up(h: Column, step: Column) -> Column:
        width = step["slot"] * 64  # hex digits of a digest
        return digest(F.substring(step["siblings"], F.lit(1), width), h, F.substr(step["siblings"], width + 1))

    return F.aggregate(path, leaf, up)


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified per row of ``docs``.

    ``tampered`` marks the rows whose text, by assumption, came back with A-Z in lower case; folded_root is what their proof gives then.
    """
    text = F.col("text")
    if tampered is None:
        tampered = F.lit(False)
    changed = F.when(tampered, leaf_of(ascii_lower(text)))
    grp = F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("0"))  # the null source sorts first
    leaves = docs.select(grp.alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(text).alias("h"), changed.alias("changed"))
    leaves = leaves.withColumn("_tie", F.monotonically_increasing_id())
    leaves = materialize(leaves, "merkle")
    leaves = materialize(numbered(leaves, ["doc_id", "h", "_tie"]).drop("_tie"), "merkle")
    levels, subroots = climbed(leaves)
    named = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "h")
    sources = materialize(numbered(named, ["name"]), "merkle")
    upper, top = climbed(sources)
    root = F.lit(getattr(top.first(), "h", None)).cast("string")  # one digest
    over = with_paths(upper).select("name", F.col("h").alias("subroot"), F.col("path").alias("over"))
    over = materialize(over, "merkle")
    met = with_paths(levels).join(small_side(over), F.col("grp") == F.col("name"))
    path = F.concat("path", "over")
    met = met.select("doc_id", F.col("h").alias("leaf"), "subroot", root.alias("root"), F.coalesce("changed", "h").alias("from"), path.alias("path"))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: s["siblings"]), ""), 256)
    out = met.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.col("from"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def part_tampered(docs: DataFrame, parts: int = TAMPERED_PARTS) -> DataFrame:
    """The manifest with every row tampered with whose crc32(doc_id as text) is divisible by ``parts``."""
    return manifest(docs, crc_part(F.col("doc_id"), parts) == 0)


def _sql_field(name: str) -> str:
    return f"coalesce(octet_length(encode({name}::VARCHAR))::VARCHAR || ':' || {name}::VARCHAR, '-')"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sql_field(text if f == "text" else f) for f in FIELDS) + ")"


# crc32 by its table: remainders of the bytes by the reversed polynomial 0xEDB88320 (3988292384), then one step per digit
ORACLE = f"""
WITH RECURSIVE
t AS (SELECT list(c ORDER BY i) AS v FROM (
  SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, coalesce('1' || source, '0') AS grp, {_sql_leaf("text")} AS leaf,
    {_sql_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS other,
    xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(coalesce(doc_id::VARCHAR, '')) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
      lambda c, b: xor(c >> 8, v[(xor(c, b) & 255) + 1])), 4294967295) % 5 AS part
  FROM documents, t),
o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS LAST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM d),
up AS (
  SELECT 0 AS k, grp, pos, n, leaf AS h FROM o
  UNION ALL
  SELECT k + 1, grp, pos // {FAN}, (any_value(n) + {FAN - 1}) // {FAN}, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY k, grp, pos // {FAN}),
sub AS (SELECT grp, h, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS k, pos, n, h FROM sub
  UNION ALL
  SELECT k + 1, pos // {FAN}, (any_value(n) + {FAN - 1}) // {FAN}, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY k, pos // {FAN}),
alln AS (SELECT k, grp, pos, n, h FROM up UNION ALL SELECT 1000 + k, '', pos, n, h FROM top),
sib AS (SELECT k, grp, pos,
    coalesce(string_agg(h, '') OVER (PARTITION BY k, grp, pos // {FAN} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (PARTITION BY k, grp, pos // {FAN} ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM alln WHERE n > 1),
path AS (
  SELECT o.grp AS g, o.pos AS p, sib.k, l, r FROM o JOIN sib ON sib.grp = o.grp AND sib.k < 1000 AND sib.pos = o.pos >> (4 * sib.k)
  UNION ALL
  SELECT o.grp, o.pos, sib.k, l, r FROM o JOIN sub ON o.grp = sub.grp JOIN sib ON sib.k >= 1000 AND sib.pos = sub.pos >> (4 * (sib.k - 1000))),
s AS (SELECT g, p, list(struct_pack(l := l, r := r) ORDER BY k) AS steps, string_agg(l || r, '' ORDER BY k) AS proof FROM path GROUP BY g, p),
e AS (SELECT o.doc_id, o.leaf, sub.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_concat([struct_pack(l := CASE WHEN part = 0 THEN other ELSE leaf END, r := '')], coalesce(steps, [])),
      lambda a, b: struct_pack(l := sha256(b.l || a.l || b.r), r := '')).l AS folded_root
  FROM o JOIN sub ON o.grp = sub.grp LEFT JOIN s ON o.grp = s.g AND o.pos = s.p)
SELECT *, folded_root = root AS verified FROM e"""
