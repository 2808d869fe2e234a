"""Fold store: tables per competition, fold and role, in versions.

Every write goes to a new folder; when all its tables stand, one appended file names them as the current ones, so
a reader sees a write whole or not at all, a repeated write leaves one copy, and a rerun with fewer folds leaves none of
the old ones behind. ``drop_old_versions`` deletes what no reader is led to any more.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from foldmark.session import delete_path

POINTER = "comp_id STRING, part STRING, fold INT, version STRING, written LONG"


def _publish(spark: SparkSession, root: str, comp_id: str, parts: list[tuple[str, int | None]], version: str) -> None:
    """One file, hence one commit, for all tables of a write; fold NULL stands for all folds."""
    rows = [(comp_id, part, fold, version, time.time_ns()) for part, fold in parts]
    spark.createDataFrame(rows, POINTER).coalesce(1).write.mode("append").parquet(f"{root}/versions")


def _pointers(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(POINTER).parquet(f"{root}/versions")
    except AnalysisException:
        return spark.createDataFrame([], POINTER)


def _current(spark: SparkSession, root: str, comp_id: str, part: str, fold: int | None = None) -> str:
    """Folder of the newest write that holds the part, of one fold or of all at once."""
    found = _pointers(spark, root).filter((F.col("comp_id") == comp_id) & (F.col("part") == part))
    own = F.col("fold").isNull() if fold is None else F.col("fold").isNull() | (F.col("fold") == fold)
    version = found.filter(own).agg(F.max_by("version", F.struct("written", "version")).alias("v")).first()["v"]
    if version is None:
        raise FileNotFoundError(f"no {part} of {comp_id} in {root}")
    return f"{root}/data/{version}/{part}"


def write_folds(parts: Mapping[str, DataFrame], root: str, comp_id: str, fold: int = 0) -> None:
    """Put the named tables of one fold (train, x_val, y_val, excluded_*) into the store, in place of an earlier write."""
    write_fold_set({fold: parts}, root, comp_id)


def write_fold_set(folds: Mapping[int, Mapping[str, DataFrame]], root: str, comp_id: str) -> None:
    """The named tables of several folds as one version; readers see all of them or none."""
    version, spark, done = uuid.uuid4().hex, None, []
    for fold, parts in folds.items():
        for part, df in parts.items():
            df.drop("fold").write.parquet(f"{root}/data/{version}/{part}/fold={fold}")
            spark = df.sparkSession
            done.append((part, fold))
    if spark is not None:
        _publish(spark, root, comp_id, done, version)


def write_split(df: DataFrame, root: str, comp_id: str) -> None:
    """Store a table with ``fold`` and ``role`` columns, all folds in one job and in place of all earlier ones."""
    version = uuid.uuid4().hex
    df.write.partitionBy("fold", "role").parquet(f"{root}/data/{version}/split")
    _publish(df.sparkSession, root, comp_id, [("split", None)], version)


def export_csv(parts: Mapping[str, DataFrame], root: str, fold: int = 0) -> None:
    """The same tables as headed CSV folders below ``fold_<n>``."""
    for part, df in parts.items():
        df.write.options(header=True, escape='"').csv(f"{root}/fold_{fold}/{part}")


def read_split(spark: SparkSession, root: str, comp_id: str) -> DataFrame:
    """All folds of the current split."""
    return spark.read.parquet(_current(spark, root, comp_id, "split"))


def read_fold(spark: SparkSession, root: str, comp_id: str, fold: int, part: str = "split", role: str | None = None) -> DataFrame:
    """One part of a fold; only its partitions are read."""
    df = spark.read.parquet(_current(spark, root, comp_id, part, fold)).filter(F.col("fold") == fold)
    if role is not None:
        df = df.filter(F.col("role") == role).drop("role")
    return df.drop("fold")


def read_excluded(spark: SparkSession, root: str, comp_id: str, fold: int) -> dict[str, DataFrame]:
    """Excluded columns of both sides, or nothing; one side without the other is an error."""
    found = {}
    for side in ("train", "val"):
        try:
            found[side] = read_fold(spark, root, comp_id, fold, f"excluded_{side}")
        except FileNotFoundError:
            continue
    if len(found) == 1:
        raise ValueError(f"excluded columns exist for {next(iter(found))} only")
    return found


def drop_old_versions(spark: SparkSession, root: str) -> list[str]:
    """Delete the versions that are current for no part and fold; no reader should be under way."""
    pointers = _pointers(spark, root)
    whole = pointers.filter("fold is null").groupBy("comp_id", "part").agg(F.max("written").alias("since"))
    newest = pointers.groupBy("comp_id", "part", "fold").agg(F.max("written").alias("at"), F.max_by("version", F.struct("written", "version")).alias("version"))
    live = newest.join(whole, ["comp_id", "part"], "left").filter("since is null or at >= since").select("version").distinct()
    old = [r["version"] for r in pointers.select("version").distinct().join(live, "version", "left_anti").collect()]  # a name per write
    for version in old:
        delete_path(spark, f"{root}/data/{version}")
    return old
