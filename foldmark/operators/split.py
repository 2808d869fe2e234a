"""Train/validation splits that never shuffle a whole class, user or table into one task.

Sides are drawn by a digest of a stable key, so a split is a function of the row and repeats on any
cluster. ``hash`` mode is a plain filter; ``exact`` mode meets the wanted size by finding the one
digest where the cut falls. Time splits find the few rows at the cuts, then compare every row to them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldmark.functions.keys import HASH_SPACE, digest_head, row_digest, row_hash
from foldmark.functions.text import parse_list_literal
from foldmark.operators.clean import keep_valid_ids
from foldmark.operators.ordering import exact_quantiles, keys_at, not_after, positions
from foldmark.session import materialize, small_side

TRAIN, VAL = "train", "val"


def _role(is_val) -> Column:
    return F.when(is_val, F.lit(VAL)).otherwise(F.lit(TRAIN))


def holdout(
    df: DataFrame, key: Sequence[str], frac: float = 0.2, seed: int = 42, mode: str = "hash"
) -> DataFrame:
    """Add ``role``. ``exact`` puts ceil(frac * n) rows in validation, rows of equal key together."""
    if mode == "hash":
        return df.withColumn("role", _role(row_hash(list(key), seed) < int(frac * HASH_SPACE)))
    return stratified_holdout(df.withColumn("_all", F.lit(1)), key, ["_all"], frac, seed).drop("_all")


def stratified_holdout(
    df: DataFrame, key: Sequence[str], strata: Sequence[str], frac: float = 0.2, seed: int = 42
) -> DataFrame:
    """``holdout`` of ceil(frac * n) rows within each stratum.

    Counts per digest head locate the cut of every stratum; only the keys of that one head, some ten
    thousand up to a million heads, are ranked.
    """
    strata = list(strata)
    digits = min(8, max(1, math.ceil(math.log(max(df.count(), 1) / 10_000 + 1, 16))))
    drawn = df.withColumn("_digest", row_digest(list(key), seed))
    lean = drawn.select(*strata, "_digest", digest_head(F.col("_digest"), digits).alias("_head"))
    heads = lean.groupBy(*strata, "_head").agg(F.count(F.lit(1)).alias("_n"))
    stratum = Window.partitionBy(*strata)
    upto = stratum.orderBy("_head").rowsBetween(Window.unboundedPreceding, 0)
    cut_heads = (
        heads.withColumn("_upto", F.sum("_n").over(upto))
        .withColumn("_want", F.ceil(F.sum("_n").over(stratum) * F.lit(frac)))
        .filter((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_n") < F.col("_want")))
        .select(
            *[F.col(s).alias(f"_s{i}") for i, s in enumerate(strata)],
            F.col("_head").alias("_cut_head"),
            (F.col("_want") - F.col("_upto") + F.col("_n")).alias("_rest"),
        )
    )
    same = [F.col(s).eqNullSafe(F.col(f"_s{i}")) for i, s in enumerate(strata)]
    at_cut = lean.join(small_side(cut_heads), same + [F.col("_head") == F.col("_cut_head")])
    rank = stratum.orderBy("_digest").rowsBetween(Window.unboundedPreceding, 0)
    cuts = (
        at_cut.groupBy(*strata, "_digest", "_rest")  # copies of a key count as one entry
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_row", F.sum("_n").over(rank))
        .filter((F.col("_row") >= F.col("_rest")) & (F.col("_row") - F.col("_n") < F.col("_rest")))
        .select(*[F.col(s).alias(f"_s{i}") for i, s in enumerate(strata)], F.col("_digest").alias("_cut"))
    )
    joined = drawn.join(small_side(cuts), same, "left")
    side = _role(F.coalesce(F.col("_digest") <= F.col("_cut"), F.lit(False)))
    return joined.select(*df.columns, side.alias("role"))


def quantile_bins(df: DataFrame, col: str, q: int = 10, out: str = "bin") -> DataFrame:
    """Bin number by exact quantiles, right-closed; equal bounds merge; rows without a value share the bin -1."""
    inner = exact_quantiles(df, [col], [i / q for i in range(q + 1)])[col]
    bounds = sorted({b for b in inner if b is not None})[1:-1]
    number = F.lit(0)
    for b in bounds:
        number = number + (F.col(col) > b).cast("int")
    return df.withColumn(out, F.coalesce(number, F.lit(-1)))


def kfold(df: DataFrame, key: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """Add ``fold``, the fold in which the row is validated."""
    return df.withColumn("fold", F.pmod(row_hash(list(key), seed), F.lit(k)).cast("int"))


def stratified_kfold(
    df: DataFrame, key: Sequence[str], strata: Sequence[str], k: int, seed: int = 42
) -> DataFrame:
    """``kfold`` with the keys of each stratum dealt out in digest order; copies of a key stay together."""
    strata = list(strata)
    drawn = df.withColumn("_digest", row_digest(list(key), seed))
    distinct = drawn.select(*[F.col(s).alias(f"_s{i}") for i, s in enumerate(strata)], F.col("_digest").alias("_d")).distinct()
    by = [f"_s{i}" for i in range(len(strata))]
    boxed = [f"_b{i}" for i in range(len(strata))]  # a null in a struct is a group like any other
    placed = positions(distinct.withColumns(dict(zip(boxed, [F.struct(c) for c in by]))), ["_d"], boxed, "_p")
    dealt = placed.withColumn("fold", ((F.col("_p") - 1) % k).cast("int"))
    same = [F.col(s).eqNullSafe(F.col(f"_s{i}")) for i, s in enumerate(strata)]
    joined = drawn.join(dealt, [*same, F.col("_digest") == F.col("_d")], "left")
    return joined.select(*df.columns, "fold")


def group_kfold(df: DataFrame, group: str, k: int, seed: int = 42, balanced: bool = False) -> DataFrame:
    """``kfold`` that keeps every group in one fold.

    ``balanced`` sorts groups by size and deals them out forth and back over the folds.
    """
    if not balanced:
        return kfold(df, [group], k, seed)
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col(group).isNotNull())
    ranked = positions(sizes, ["-_n", group], name="_p")
    turn = (F.col("_p") - 1) % (2 * k)
    folds = ranked.select(
        F.col(group).alias("_g"),
        F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("int").alias("fold"),
    )
    return df.join(small_side(folds), F.col(group) == F.col("_g"), "left").drop("_g")


def _dealt(loads: Sequence[int], size: int, many: int) -> list[int]:
    """How many of ``many`` groups of one size each fold gets when every next group goes to the lightest fold, the first of equals.

    Water filling: fold f would take its j-th group at load loads[f] + j * size, and the ``many`` least of these are taken.
    """

    def taken(level: int) -> list[int]:
        return [max(0, (level - load) // size + 1) for load in loads]

    low, high = min(loads) - 1, max(loads) + size * many
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if sum(taken(middle)) >= many else (middle, high)
    given = taken(low)
    rest = many - sum(given)
    for f, load in enumerate(loads):
        if rest and load <= high and (high - load) % size == 0:
            given[f] += 1
            rest -= 1
    return given


def group_kfold_lightest(df: DataFrame, group: str, k: int) -> DataFrame:
    """``fold`` that keeps every group in one fold, the groups dealt by falling size, each to the fold with the fewest rows.

    Groups of one size are dealt in one step, so the driver handles the distinct sizes, at most the square root of twice the rows, and
    never the groups; which of them go where follows their order within the size. Rows without a group get no fold.
    """
    sizes = materialize(df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col(group).isNotNull()), "groups")
    loads, parts = [0] * k, []
    for r in sizes.groupBy("_n").agg(F.count(F.lit(1)).alias("_m")).orderBy(F.col("_n").desc()).collect():
        at = 0
        for f, n in enumerate(_dealt(loads, r["_n"], r["_m"])):
            if n:
                parts.append((r["_n"], f, at, at + n))
            at += n
            loads[f] += n * r["_n"]
    dealt = df.sparkSession.createDataFrame(parts, "_size LONG, fold INT, _after LONG, _upto LONG")
    placed = positions(sizes, [group], by=["_n"], name="_p")
    here = (F.col("_n") == F.col("_size")) & (F.col("_p") > F.col("_after")) & (F.col("_p") <= F.col("_upto"))
    folds = placed.join(small_side(dealt), here).select(F.col(group).alias("_g"), "fold")
    return df.join(small_side(folds), F.col(group) == F.col("_g"), "left").drop("_g")


def group_holdout(df: DataFrame, group: str, frac: float = 0.2, seed: int = 42) -> DataFrame:
    """``holdout`` of whole groups."""
    return holdout(df, [group], frac, seed)


def expand_folds(df: DataFrame, k: int) -> DataFrame:
    """One row per (row, fold) with its role, from the validation fold number."""
    long = df.withColumnRenamed("fold", "_val").withColumn(
        "fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    )
    return long.withColumn("role", _role(F.col("fold") == F.col("_val"))).drop("_val")


def _by_cuts(df: DataFrame, order: Sequence[str], starts: Callable[[int], list[int]]) -> DataFrame:
    """Folds from positions: fold i trains on rows up to ``starts[i]``, validates up to ``starts[i+1]``."""
    total = df.count()
    at = starts(total)
    live = 0
    while live + 1 < len(at) and at[live] < at[live + 1]:
        live += 1
    inner = [p for p in at[: live + 1] if 0 < p < total]
    _, found = keys_at(df, order, inner)
    segment = F.lit(0)
    for p in at[: live + 1]:
        if p <= 0:
            segment = segment + 1
        elif p < total:
            segment = segment + (~not_after(order, found[p])).cast("int")
    staged = df.withColumn("_segment", segment).filter(F.col("_segment") <= live)
    if live == 0:
        return staged.withColumns({"fold": F.lit(0), "role": F.lit(TRAIN)}).drop("_segment").limit(0)
    first = F.greatest(F.col("_segment") - 1, F.lit(0))
    long = staged.withColumn("fold", F.explode(F.sequence(first, F.lit(live - 1))))
    return long.withColumn("role", _role(F.col("fold") == F.col("_segment") - 1)).drop("_segment")


def time_expanding(df: DataFrame, time: str, key: Sequence[str], k: int) -> DataFrame:
    """Expanding window: fold i trains on the first (i+1)/(k+1) of the rows, validates on the next part.

    Without the time column the split falls back to ``kfold``.
    """
    if time not in df.columns:
        return expand_folds(kfold(df, key, k), k)
    return _by_cuts(df, [time, *key], lambda n: [n * (i + 1) // (k + 1) for i in range(k + 1)])


def time_series_split(df: DataFrame, time: str, key: Sequence[str], k: int) -> DataFrame:
    """k validation windows of n // (k+1) rows each at the end, training on everything before."""

    def starts(n: int) -> list[int]:
        size = n // (k + 1)
        return [n - (k - i) * size for i in range(k + 1)]

    return _by_cuts(df, [time, *key], starts)


def ordered_holdout(df: DataFrame, order: Sequence[str], frac: float = 0.2) -> DataFrame:
    """The last ceil(frac * n) rows of the order are validation."""
    total = df.count()
    keep = total - math.ceil(frac * total)
    if keep <= 0:
        return df.withColumn("role", F.lit(VAL))
    if keep >= total:
        return df.withColumn("role", F.lit(TRAIN))
    _, found = keys_at(df, order, [keep])
    return df.withColumn("role", _role(~not_after(order, found[keep])))


def last_period_holdout(df: DataFrame, period: str, order: Sequence[str] = ()) -> DataFrame:
    """Rows of the latest period are validation; without the column, the last fifth of the order."""
    if period not in df.columns:
        return ordered_holdout(df, order)
    latest = df.agg(F.max(period).alias("_latest"))
    joined = df.crossJoin(F.broadcast(latest))
    return joined.withColumn("role", _role(F.col(period) == F.col("_latest"))).drop("_latest")


def key_list_split(df: DataFrame, key: str, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is in the one-column list, and the rest; rows of one key stay together."""
    ids = small_side(chosen.select(F.col(chosen.columns[0]).alias(key)).distinct())
    return df.join(ids, key, "left_semi"), df.join(ids, key, "left_anti")


def project_role(
    df: DataFrame,
    target: Sequence[str] | str,
    exclude: Sequence[str] = (),
    weight: str | None = None,
    drop_excluded: bool = False,
    ids: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """Named tables of a split: train, x_val, y_val, and the excluded columns of both sides.

    Excluded and weight columns go to side tables; they stay in X unless ``drop_excluded``. ``ids`` are
    repeated in y_val, as recommendation labels need them.
    """
    targets = [target] if isinstance(target, str) else list(target)
    aside = sorted({*exclude, *([weight] if weight else [])})
    body = df.drop(*aside) if drop_excluded and aside else df
    train, val = F.col("role") == TRAIN, F.col("role") == VAL
    out = {
        "train": body.filter(train).drop("role"),
        "x_val": body.filter(val).drop("role", *targets),
        "y_val": df.filter(val).select(*ids, *targets),
    }
    if aside:
        out["excluded_train"] = df.filter(train).select(*aside)
        out["excluded_val"] = df.filter(val).select(*aside)
    return out


def recommendation_roles(
    df: DataFrame, ids: Sequence[str], target: str, opposite: str | None = None
) -> dict[str, DataFrame]:
    """``project_role`` for interactions: the opposite reaction leaves X together with the target."""
    targets = [target] + ([opposite] if opposite in df.columns else [])
    return project_role(df, targets, ids=ids)


def multi_table_split(
    facts: DataFrame,
    key: Sequence[str],
    dimensions: dict[str, tuple[DataFrame, str, str]],
    lists: dict[str, Sequence[tuple[str, str]]] | None = None,
    frac: float = 0.2,
    seed: int = 42,
) -> dict[str, DataFrame]:
    """Split the facts; each dimension keeps per side the rows seen there.

    ``dimensions`` maps a name to (table, its key, the facts column). ``lists`` maps a name to
    (array column, facts column) pairs whose ids are cut down to those seen on the side.
    """
    lists = lists or {}
    drawn = holdout(facts, key, frac, seed)
    columns = {fact_key for _, _, fact_key in dimensions.values()}
    columns |= {list_key for pairs in lists.values() for _, list_key in pairs}
    kinds: dict[str, list[str]] = {}
    for c in sorted(columns):
        kinds.setdefault(facts.schema[c].dataType.simpleString(), []).append(c)
    seen = {}
    for alike in kinds.values():  # one pass over the facts for all key columns of a type
        each = drawn.select("role", F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).alias("_k")) for i, c in enumerate(alike)])).alias("s"))
        sides = materialize(_key_sides(each.select("role", "s._c", "s._k"), ["_c", "_k"]), "seen-keys", partition_by=("_c",))
        seen |= {c: sides.filter(F.col("_c") == i) for i, c in enumerate(alike)}

    def ids(column: str, side: str, name: str) -> DataFrame:
        return seen[column].filter("_t" if side == TRAIN else "_v").select(F.col("_k").alias(name))

    out: dict[str, DataFrame] = {}
    for side in (TRAIN, VAL):
        out[f"facts_{side}"] = drawn.filter(F.col("role") == side).drop("role")
        for name, (dim, dim_key, fact_key) in dimensions.items():
            kept = dim.join(ids(fact_key, side, dim_key), dim_key, "left_semi")
            for array, list_key in lists.get(name, ()):
                kept = keep_valid_ids(kept, dim_key, array, ids(list_key, side, "_known"))
            out[f"{name}_{side}"] = kept
    return out


def multilabel_holdout(
    df: DataFrame, key: Sequence[str], target: str, frac: float = 0.2, seed: int = 42
) -> DataFrame:
    """``holdout`` with the list-literal target parsed into an array."""
    return holdout(df, key, frac, seed).withColumn(target, parse_list_literal(F.col(target)))


def overlap(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Keys found in both train and validation of the same fold: empty for a leak-free split."""
    return _key_sides(df, by).filter("_t AND _v").drop("_t", "_v")


def _key_sides(df: DataFrame, by: Sequence[str]) -> DataFrame:
    folds = [c for c in ("fold",) if c in df.columns]
    return df.groupBy(*folds, *by).agg(
        F.bool_or(F.col("role") == TRAIN).alias("_t"), F.bool_or(F.col("role") == VAL).alias("_v")
    )


def leak_report(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per fold: distinct keys on each side and those on both."""
    folds = [c for c in ("fold",) if c in df.columns]
    return _key_sides(df, by).groupBy(*folds).agg(
        F.count_if("_t").alias("train_keys"),
        F.count_if("_v").alias("val_keys"),
        F.count_if(F.col("_t") & F.col("_v")).alias("shared_keys"),
    )


def _image_split(df: DataFrame, key, n_splits=1, frac=0.2, seed=42, strata=None, **_) -> DataFrame:
    if strata:
        return expand_folds(stratified_kfold(df, key, strata, n_splits, seed), n_splits)
    return expand_folds(kfold(df, key, n_splits, seed), n_splits)


def _one_split(df: DataFrame, key, frac=0.2, seed=42, strata=None, mode="hash", **_) -> DataFrame:
    if strata:
        out = stratified_holdout(df, key, strata, frac, seed)
    else:
        out = holdout(df, key, frac, seed, mode)
    return out.withColumn("fold", F.lit(0))


def _user_split(df: DataFrame, key, n_splits=1, seed=42, group=None, **_) -> DataFrame:
    if group is None or group not in df.columns:
        return expand_folds(kfold(df, key, n_splits, seed), n_splits)
    return expand_folds(group_kfold(df, group, n_splits, seed), n_splits)


def _time_split(df: DataFrame, key, n_splits=1, time="timestamp", **_) -> DataFrame:
    return time_expanding(df, time, key, n_splits)


def _custom_split(df: DataFrame, key, split_fn=None, **_) -> DataFrame:
    if split_fn is None:
        raise ValueError("the custom strategy needs split_fn")
    return split_fn(df)


# fixed values: strategy names that dataset catalogs use
STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "csv": _one_split,
    "image_folder": _image_split,
    "image_classification": _image_split,
    "recommendation": _user_split,
    "time_series": _time_split,
    "custom": _custom_split,
    "emnist": _one_split,
    "biker_recommender": _one_split,
    "multilabel": _one_split,
    "classify_leaves": _one_split,
    "photo_classification": _one_split,
    "sheep_classification": _one_split,
}


def split(df: DataFrame, key: Sequence[str], strategy: str = "csv", **options) -> DataFrame:
    """Rows with ``fold`` and ``role`` by a named strategy; an unknown name is an error."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown split strategy: {strategy}")
    return STRATEGIES[strategy](df, key, **options)
