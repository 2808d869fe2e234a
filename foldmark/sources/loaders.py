"""From a catalog entry to stored folds, and from the store to the tables a submission gets."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmark.functions.text import parse_ints, parse_list_literal
from foldmark.functions.vectors import flatten_trailing
from foldmark.operators import split
from foldmark.sources import folds
from foldmark.sources.manifest import image_path


def _target(entry: Mapping):
    return entry.get("target_col") or "target"


def prepare_folds(df: DataFrame, entry: Mapping, root: str, comp_id: str, key: Sequence[str], **options) -> None:
    """Split by the entry's strategy and store all folds with one job."""
    target = _target(entry)
    if entry.get("stratified_split") and "strata" not in options:
        options["strata"] = [target] if isinstance(target, str) else list(target)
    if entry.get("time_col"):
        options.setdefault("time", entry["time_col"])
    options.setdefault("n_splits", entry.get("cv_folds") or 1)
    drawn = split.split(df, key, entry.get("split_strategy") or "csv", **options)
    folds.write_split(drawn, root, comp_id)


def _default(parts: dict[str, DataFrame], entry: Mapping, root: str) -> dict[str, DataFrame]:
    return parts


def _multilabel(parts: dict[str, DataFrame], entry: Mapping, root: str) -> dict[str, DataFrame]:
    target = _target(entry)
    for name in ("train", "y_val"):
        parts[name] = parts[name].withColumn(target, parse_list_literal(F.col(target)))
    return parts


def _images(parts: dict[str, DataFrame], entry: Mapping, root: str) -> dict[str, DataFrame]:
    column, folder = entry.get("image_col") or "image", entry.get("image_dir") or "data"
    for name in ("train", "x_val"):
        parts[name] = parts[name].withColumn(column, image_path(F.lit(root), folder, F.col(column)))
    return parts


def _photos(parts: dict[str, DataFrame], entry: Mapping, root: str) -> dict[str, DataFrame]:
    target = _target(entry)
    for name in ("train", "y_val"):
        parts[name] = parts[name].withColumn(target, parse_ints(F.col(target)))
    return _images(parts, entry, root)


def _tensors(parts: dict[str, DataFrame], entry: Mapping, root: str) -> dict[str, DataFrame]:
    column = entry.get("image_col") or "image"
    for name in ("train", "x_val"):
        parts[name] = parts[name].withColumn(column, flatten_trailing(F.col(column)))
    return parts


# fixed values: load strategies of dataset catalogs
LOADERS: dict[str, Callable[[dict[str, DataFrame], Mapping, str], dict[str, DataFrame]]] = {
    "default": _default,
    "emnist": _tensors,
    "multilabel": _multilabel,
    "biker_recommender": _default,
    "classify_leaves": _images,
    "photo_classification": _photos,
    "sheep_classification": _images,
}


def load_fold(
    spark: SparkSession,
    entry: Mapping,
    root: str,
    comp_id: str,
    fold: int,
    ids: Sequence[str] = (),
    tables: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """Tables of one fold: train, x_val, y_val, excluded columns, and the named side tables per role."""
    name = entry.get("load_strategy") or "default"
    if name not in LOADERS:
        raise ValueError(f"unknown load strategy: {name}")
    stored = folds.read_fold(spark, root, comp_id, fold)
    parts = split.project_role(
        stored, _target(entry), entry.get("exclude_cols") or (), entry.get("weight_col"), ids=ids
    )
    for table in tables:
        for side in (split.TRAIN, split.VAL):
            part = f"{table}_{side}"
            parts[part] = folds.read_fold(spark, root, comp_id, fold, part)
    return LOADERS[name](parts, entry, root)
