"""Ordered computation over groups of any size.

A window over ``partitionBy(group)`` sorts a whole group in one task, and a group may be a third of the table. Rows are
therefore dealt out by ranges of (group, sort keys) into slices of near-equal row count, whatever the size of the table
or of a group; all sort keys count, in Spark's own order of nulls and NaN. The slices are kept as a table, so that every
later step sees the same ones. Each (group, slice) is windowed on its own, and an aggregate per slice carries totals
forward for the few groups that span slices: at most two per slice, hence a broadcast of bounded size.

The last sort key should be unique; rows that are equal in all keys stay in one slice.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldmark.session import forget, materialize, shuffle_partitions

SLICE = "_slice"
SLICE_ROWS = 1_000_000  # of a slice, about, where a table has more than fill the session's partitions
BRACKET = 1 / 2_000  # share of the rows on either side of a wanted rank that are looked at one by one


@dataclass(frozen=True)
class Key:
    """A sort key; nulls come last in both directions."""

    name: str
    ascending: bool = True

    def column(self) -> Column:
        col = F.col(self.name)
        return col.asc_nulls_last() if self.ascending else col.desc_nulls_last()


def as_keys(order: Sequence[str | Key]) -> list[Key]:
    return [
        k if isinstance(k, Key) else Key(k.lstrip("-"), not k.startswith("-")) for k in order
    ]


def with_slices(
    df: DataFrame, order: Sequence[str | Key], slices: int | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """A kept copy of ``df`` with ``_slice``, which never decreases along ``by`` and ``order``.

    Without a given number there are as many slices as the session has partitions; a table whose slices would
    get over SLICE_ROWS rows on average is dealt out once more, from the copy, into as many as that takes.
    """
    keys = [*[F.col(c) for c in by], *[k.column() for k in as_keys(order)]]

    def dealt(rows: DataFrame, n: int) -> DataFrame:
        return materialize(rows.repartitionByRange(n, *keys).withColumn(SLICE, F.spark_partition_id().cast("bigint")), "slices")

    n = slices or shuffle_partitions(df.sparkSession)
    kept = dealt(df, n)
    need = 0 if slices else -(-kept.count() // SLICE_ROWS)  # the count of a stored table reads its footers
    if need <= n:
        return kept
    finer = dealt(kept.drop(SLICE), need)
    forget(kept)
    return finer


def _grouped(by: Sequence[str]) -> Column:
    """Whether a row has all keys of its group."""
    whole = F.lit(True)
    for c in by:
        whole = whole & F.col(c).isNotNull()
    return whole


def _spanning(sliced: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows of groups that lie in several slices; only the first and last group of a slice can."""
    if not by:
        return sliced
    group = F.struct(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)])
    ends = sliced.filter(_grouped(by)).groupBy(SLICE).agg(F.min(group).alias("lo"), F.max(group).alias("hi"))
    several = (
        ends.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("g"))
        .groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("g.*")
    )
    return sliced.join(F.broadcast(several), [F.col(c) == F.col(f"_g{i}") for i, c in enumerate(by)], "left_semi")


def _with_offsets(local: DataFrame, offsets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join the per-slice table: one row per slice, or per slice and spanning group."""
    match = [F.col(SLICE) == F.col("_slice_at")]
    match += [F.col(c) == F.col(f"_by{i}") for i, c in enumerate(by)]
    return local.join(F.broadcast(offsets), match, "left")


def running(
    df: DataFrame,
    order: Sequence[str | Key],
    by: Sequence[str] = (),
    sums: dict[str, Column] | None = None,
    position: str | None = None,
    before: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """Running sums and the 1-based position per group along ``order``.

    ``before=True`` leaves the current row out of the sums. Rows without a group key get nulls.
    """
    keys = as_keys(order)
    by = list(by)
    measures = dict(sums or {})
    if position:
        measures[position] = F.lit(1).cast("bigint")
    staged = df.withColumns({f"_v{i}": c for i, c in enumerate(measures.values())})
    sliced = with_slices(staged, keys, slices, by)

    cell = Window.partitionBy(*by, SLICE).orderBy(*[k.column() for k in keys])
    upto = cell.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    whole = cell.rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.withColumns(
        {
            f"_l{i}": F.coalesce(F.sum(f"_v{i}").over(whole if name == position else upto), F.lit(0))
            for i, name in enumerate(measures)
        }
    )
    totals = _spanning(sliced, by).groupBy(*by, SLICE).agg(
        *[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(measures))]
    )
    earlier = Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)],
        F.col(SLICE).alias("_slice_at"),
        *[F.sum(f"_t{i}").over(earlier).alias(f"_o{i}") for i in range(len(measures))],
    )
    local = _with_offsets(local, offsets, by)
    earlier_sums = [F.coalesce(F.col(f"_o{i}"), F.lit(0)) for i in range(len(measures))]
    return local.select(
        *[c for c in df.columns if c not in measures],
        *[
            F.when(_grouped(by), F.col(f"_l{i}") + earlier_sums[i]).alias(name)
            for i, name in enumerate(measures)
        ],
    )


def positions(
    df: DataFrame,
    order: Sequence[str | Key],
    by: Sequence[str] = (),
    name: str = "position",
    slices: int | None = None,
) -> DataFrame:
    """1-based position of every row, per group or over the whole table."""
    return running(df, order, by, position=name, slices=slices)


def lagged(
    df: DataFrame,
    order: Sequence[str | Key],
    by: Sequence[str],
    value: str,
    steps: int,
    prefix: str,
    slices: int | None = None,
) -> DataFrame:
    """Columns ``prefix1..prefixN`` with the values 1..N rows earlier in the group.

    Each slice hands its last ``steps`` values on; every earlier slice has at least one row, so the
    last ``steps`` slices are enough.
    """
    keys = as_keys(order)
    by = list(by)
    names = [f"{prefix}{k}" for k in range(1, steps + 1)]
    sliced = with_slices(df, keys, slices, by)
    cell = Window.partitionBy(*by, SLICE).orderBy(*[k.column() for k in keys])
    local = sliced.withColumns({f"_in{k}": F.lag(value, k).over(cell) for k in range(1, steps + 1)})
    backwards = [
        F.col(k.name).desc_nulls_first() if k.ascending else F.col(k.name).asc_nulls_first() for k in keys
    ]
    back = Window.partitionBy(*by, SLICE).orderBy(*backwards)
    boxed = F.struct(F.col(value).alias("v"))
    tails = (
        _spanning(sliced, by)
        .withColumn("_from_end", F.row_number().over(back))
        .filter(F.col("_from_end") <= steps)
        .groupBy(*by, SLICE)
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("_from_end")).alias("o"), boxed.alias("b")))).alias("_tail"))
        .withColumn("_tail", F.transform("_tail", lambda t: t["b"]))
    )
    previous = Window.partitionBy(*by).orderBy(SLICE).rowsBetween(-steps, -1)
    carried = tails.select(
        *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)],
        F.col(SLICE).alias("_slice_at"),
        F.flatten(F.collect_list("_tail").over(previous)).alias("_carry"),
    )
    joined = _with_offsets(local.withColumn("_row", F.row_number().over(cell)), carried, by)

    def pick(k: int) -> Column:
        need = F.lit(k) - F.col("_row") + 1
        carry = F.when(F.size("_carry") >= need, F.element_at("_carry", -need)["v"])
        inside = F.col(f"_in{k}")
        return F.when(_grouped(by), F.when((F.col("_row") > k) | F.col("_carry").isNull(), inside).otherwise(carry))

    return joined.select(*df.columns, *[pick(k).alias(n) for k, n in enumerate(names, 1)])


def keys_at(
    df: DataFrame,
    order: Sequence[str | Key],
    at: Sequence[int],
    slices: int | None = None,
) -> tuple[int, dict[int, tuple]]:
    """Row count and the sort-key tuples found at the given 1-based positions.

    Only the slices that hold a wanted position are ranked, and only those few tuples reach the
    driver; a split by position is then a plain comparison on every row, without a shuffle.
    """
    keys = as_keys(order)
    sliced = with_slices(df.select(*dict.fromkeys(k.name for k in keys)), keys, slices)
    counts = sliced.groupBy(SLICE).count().orderBy(SLICE).collect()  # one row per slice
    total = sum(r["count"] for r in counts)
    wanted: dict[int, dict[int, int]] = {}
    start = 0
    for row in counts:
        for p in set(at):
            if start < p <= start + row["count"]:
                wanted.setdefault(row[SLICE], {})[p - start] = p
        start += row["count"]
    if not wanted:
        return total, {}
    cell = Window.partitionBy(SLICE).orderBy(*[k.column() for k in keys])
    pairs = F.lit(False)
    for piece, places in wanted.items():
        pairs = pairs | ((F.col(SLICE) == piece) & F.col("_row").isin(list(places)))
    found = (
        sliced.filter(F.col(SLICE).isin(list(wanted)))
        .withColumn("_row", F.row_number().over(cell))
        .filter(pairs)
        .collect()  # at most one row per wanted position
    )
    return total, {wanted[r[SLICE]][r["_row"]]: tuple(r[k.name] for k in keys) for r in found}


def not_after(keys: Sequence[str | Key], bound: tuple) -> Column:
    """Row sorts at or before ``bound`` along ``keys``, nulls last in both directions, NaN above all numbers."""
    result: Column = F.lit(True)
    for key, value in reversed(list(zip(as_keys(keys), bound))):
        col = F.col(key.name)
        if value is None:
            result = col.isNotNull() | result
            continue
        edge = F.lit(value)
        ahead = (col < edge) if key.ascending else (col > edge)
        result = F.coalesce(ahead, F.lit(False)) | (col.eqNullSafe(edge) & result)
    return result


def _sketched(values: DataFrame, cols: int, probabilities: Sequence[float], width: float) -> tuple[list[int], dict[tuple[int, float], tuple]]:
    """Rows with a value per column, and by (column, probability) values below and above the rank, None where the sketch ends.

    One mergeable sketch per column, off by ``width`` / 2 of the rows at most, so that values within ``width`` of a share hold its rank.
    """
    at = sorted({min(max(p + d, 0.0), 1.0) for p in probabilities for d in (-width, width)})
    parts = [F.struct(F.count(f"_q{c}").alias("n"), F.percentile_approx(f"_q{c}", at, math.ceil(2 / width)).alias("b")) for c in range(cols)]
    found = values.agg(F.array(*parts).alias("f")).first()["f"]
    out = {}
    for c, (n, b) in enumerate(found):
        for p in probabilities if n else ():
            low = b[at.index(p - width)] if p - width > 0 else None
            high = b[at.index(p + width)] if p + width < 1 else None
            out[(c, p)] = (low, high)
    return [n for n, _ in found], out


def _ahead(df: DataFrame, wanted: dict[int, tuple]) -> tuple[DataFrame, Column]:
    """For each wanted bracket number (column, low, high): flags of rows below it, and the values inside, as one array."""
    inside = []
    for i, (c, low, high) in wanted.items():
        x = F.col(f"_q{c}")
        within = (x >= F.lit(low) if low is not None else F.lit(True)) & (x <= F.lit(high) if high is not None else F.lit(True))
        inside.append(F.when(x.isNotNull() & within, F.struct(F.lit(i).alias("i"), x.alias("v"))))
        df = df.withColumn(f"_below{i}", (F.coalesce(x < F.lit(low), F.lit(False)) if low is not None else F.lit(False)).cast("long"))
    return df, F.filter(F.array(*inside), lambda s: s.isNotNull())


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probabilities: Sequence[float], width: float = BRACKET
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of several columns, exact for any number of rows; NaN counts as the largest value.

    Two scans: a mergeable sketch per column brackets every wanted rank, then one aggregate counts
    the rows below each bracket and the values inside. Only the distinct values inside, some ``width`` of all, are ever
    sorted, those of a bracket by themselves. Returns len(cols) * len(probabilities) numbers.
    """
    cols = list(cols)
    values = df.select(*[F.col(c).cast("double").alias(f"_q{i}") for i, c in enumerate(cols)])
    sizes, edges = _sketched(values, len(cols), probabilities, width)
    ends = {(i, p): p * (sizes[i] - 1) for i in range(len(cols)) for p in probabilities if sizes[i]}  # between which two ranks
    found: dict[tuple[int, int], float] = {}
    todo = list(ends)
    while todo:
        wanted = {k: (c, *edges[(c, p)]) for k, (c, p) in enumerate(todo)}
        flagged, inside = _ahead(values, wanted)
        below = [f"_below{k}" for k in wanted]
        each = flagged.select(*below, F.posexplode_outer(inside).alias("at", "s"))
        first = F.coalesce(F.col("at"), F.lit(0)) == 0  # a row is counted once, however many brackets hold its values
        counted = materialize(
            each.groupBy("s.i", "s.v").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.when(first, F.col(b)).otherwise(0)).alias(b) for b in below]), "quantiles"
        )
        start = counted.agg(*[F.sum(b).alias(b) for b in below]).first()
        upto = Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        stepped = counted.filter("i is not null").select("i", "v", "n", F.sum("n").over(upto).alias("end"))
        hit, ranks = F.lit(False), {}
        for k, (c, p) in enumerate(todo):
            for rank in {math.floor(ends[(c, p)]), math.ceil(ends[(c, p)])}:
                ranks[(k, rank)] = rank - start[f"_below{k}"]
                hit |= (F.col("i") == k) & (F.col("end") > ranks[(k, rank)]) & (F.col("end") - F.col("n") <= ranks[(k, rank)])
        rows = stepped.filter(hit).collect()  # at most two rows per quantile
        forget(counted)
        for (k, rank), offset in ranks.items():
            for r in rows:
                if r["i"] == k and r["end"] - r["n"] <= offset < r["end"]:
                    found[(todo[k][0], rank)] = r["v"]
        todo = [(c, p) for c, p in todo if not {(c, math.floor(ends[(c, p)])), (c, math.ceil(ends[(c, p)]))} <= found.keys()]
        edges = dict.fromkeys(todo, (None, None))  # should a sketch ever promise too much, all values are looked at
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        line: list[float | None] = []
        for p in probabilities:
            at = ends.get((i, p))
            if at is None:
                line.append(None)
                continue
            lo, hi = found[(i, math.floor(at))], found[(i, math.ceil(at))]
            line.append(lo if lo == hi else lo + (hi - lo) * (at - math.floor(at)))
        out[c] = line
    return out
