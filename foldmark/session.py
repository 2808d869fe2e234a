"""Session set-up, shared folder and the size check every broadcast goes through."""

from __future__ import annotations

import atexit
import math
import os
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024


def get_spark(cpus: int | str = "*", app: str = "foldmark", **conf: str) -> SparkSession:
    """Local session for tests and the benchmark; a cluster passes in its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings the jobs rely on: UTC timestamps and AQE with skew splitting.

    Zone-less parquet timestamps are read as UTC instants, so that filters on them reach the scan.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def dealt(df: DataFrame, by: Sequence[str], per_task: int) -> DataFrame:
    """Rows dealt by columns to as many tasks as hold ``per_task`` rows each on average, whatever the session's number of partitions."""
    spark = df.sparkSession
    return df.repartition(max(shuffle_partitions(spark), math.ceil(df.count() / per_task)), *by)


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local session may fall back to its own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="foldmark-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
    return root


_SCOPES: list[list[DataFrame | tuple[SparkSession, str]]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Drop at the end all tables, folders and caches that were made inside; consume the results before that."""
    made: list[DataFrame | tuple[SparkSession, str]] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for item in made:
            if isinstance(item, DataFrame):
                item.unpersist()
            else:
                delete_path(*item)


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, not yet created."""
    path = os.path.join(shared_root(spark), f"{label}-{uuid.uuid4().hex}")
    if _SCOPES:
        _SCOPES[-1].append((spark, path))
    return path


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Cut lineage with a table in the shared folder; it outlives a lost executor."""
    path = shared_dir(df.sparkSession, label)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[kept] = path
    return kept


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned, once nothing reads them any more."""
    for table in tables:
        path = _PATHS.pop(table, None)
        if path:
            delete_path(table.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in whatever store holds it."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def _width(field: T.StructField) -> Column:
    """Bytes that a value takes, about."""
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.octet_length(field.name)
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return 2 * F.octet_length(F.to_json(F.struct(F.col(f"`{field.name}`"))))
    return F.lit(16)


def small_side(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Mark ``df`` for broadcast if its measured size allows it, else leave the join to Catalyst.

    ``df`` is an aggregate or a dimension, kept so that the check and the join compute it once.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    if _SCOPES:
        _SCOPES[-1].append(kept)
    wide = [_width(f) for f in df.schema.fields]
    width = sum((F.coalesce(w, F.lit(0)) for w in wide[1:]), F.coalesce(wide[0], F.lit(0)))
    rows, size = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    if rows <= max_rows and size <= max_bytes:
        return F.broadcast(kept)
    return kept
