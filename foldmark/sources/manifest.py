"""File listings: dataset manifests and image folders. Only paths and sizes are read, never contents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmark.functions.text import base_name, parent_name
from foldmark.session import small_side

# fixed values: name parts and suffixes that decide a file's role
SUBMISSION_FILE = "sample_submission|samplesubmission|submission|submit|example_submission|baseline"
SUBMISSION_FOLDER = "submission|sample|baseline|example"
DATA_SUFFIX = r"\.(csv|json|parquet|pkl|pickle|h5|hdf5|jpg|jpeg|png|tiff|bmp|gif|npy|npz|mat)$"
TEXT_SUFFIX = r"\.(txt|md|xml|yml|yaml)$"
DESCRIPTION = "description|readme|info|meta"
IMAGE_SUFFIX = r"\.(jpg|jpeg|png|bmp|tiff)$"


def file_type(name: Column) -> Column:
    """'data', 'metadata' or 'other' by the ending; texts that describe something are metadata."""
    low = F.lower(name)
    return (
        F.when(low.rlike(DATA_SUFFIX), "data")
        .when(low.rlike(TEXT_SUFFIX) & low.rlike(DESCRIPTION), "metadata")
        .when(low.rlike(TEXT_SUFFIX), "data")
        .otherwise("other")
    )


def describe_files(paths: DataFrame, path: str = "path") -> DataFrame:
    """``name``, ``key`` (name without ending), ``file_type`` and ``is_submission`` per path."""
    name = base_name(F.col(path))
    return paths.withColumns(
        {
            "name": name,
            "key": F.regexp_replace(name, r"(?<!^)\.[^.]*$", ""),
            "file_type": file_type(name),
            "is_submission": F.lower(name).rlike(SUBMISSION_FILE),
        }
    )


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Path and size of all files below a folder."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    )


def _below(root: str, path: str = "path") -> Column:
    """The part of a path below a folder, whatever store and scheme stand before it; NULL outside."""
    start = root.rstrip("/") + "/"
    at = F.locate(start, F.col(path))
    return F.when(at > 0, F.substr(F.col(path), at + len(start)))


def folder_entries(files: DataFrame, root: str) -> DataFrame:
    """``key, path, file_type, required`` of the folders right below ``root``, submission-like names left out."""
    parts = F.split(_below(root), "/")
    inside = files.filter(F.size(parts) > 1).select(parts[0].alias("key")).distinct()
    kept = inside.filter(~F.lower("key").rlike(SUBMISSION_FOLDER))
    return kept.select("key", F.concat(F.lit(root.rstrip("/") + "/"), "key").alias("path"), F.lit("data").alias("file_type"), F.lit(False).alias("required"))


def build_manifest(
    files: DataFrame, mapping: Mapping[str, Mapping] | None = None, expected: Mapping[str, Mapping] | None = None, root: str | None = None
) -> DataFrame:
    """Manifest rows ``key, path, file_type, required`` of one dataset folder.

    An explicit mapping names the files; else expected keys are looked up with their endings. Other data
    and metadata files are added as optional, submission-like names are not. With ``root``, files count that lie right in
    that folder, and its sub-folders are entries of their own.
    """
    spark = files.sparkSession
    folders = None
    if root is not None:
        folders = folder_entries(files, root)
        files = files.filter(F.size(F.split(_below(root), "/")) == 1)
    described = describe_files(files)
    # fixed values: what a dataset expects by default
    expected = expected or {"train": {"type": "data", "required": True, "extensions": [".csv"]}}
    if mapping:
        wanted = [(k, m["filename"], 0, m.get("type", "data"), m.get("required", True)) for k, m in mapping.items()]
    else:
        wanted = [
            (k, f"{k}{ext}", i, c.get("type", "data"), c.get("required", True))
            for k, c in expected.items()
            for i, ext in enumerate(c.get("extensions", [".csv"]))
        ]
    rules = spark.createDataFrame(wanted, "key STRING, name STRING, choice INT, file_type STRING, required BOOLEAN")
    found = rules.join(described.select("name", "path"), "name", "left")
    best = found.groupBy("key").agg(
        F.min_by(F.struct("path", "file_type", "required"), F.struct(F.col("path").isNull(), "choice")).alias("b")
    )
    named = best.select("key", "b.path", "b.file_type", "b.required")
    extra = described.filter(~F.col("is_submission") & F.col("file_type").isin("data", "metadata"))
    extra = extra.join(F.broadcast(rules.select("key").distinct()), "key", "left_anti")
    named = named.unionByName(extra.select("key", "path", "file_type", F.lit(False).alias("required")))
    return named if folders is None else named.unionByName(folders.join(named.select("key"), "key", "left_anti"))


def missing_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Required entries whose file is not there."""
    present = small_side(files.select("path").distinct())
    return manifest.filter("required").join(present, "path", "left_anti")


def image_table(paths: DataFrame, path: str = "path") -> DataFrame:
    """Image paths with the class taken from the parent folder."""
    images = paths.filter(F.lower(path).rlike(IMAGE_SUFFIX))
    return images.withColumns({"image": base_name(F.col(path)), "label": parent_name(F.col(path))})


def image_path(root: Column, folder: str, image: Column) -> Column:
    return F.concat_ws("/", root, F.lit(folder), image)


def list_images(spark: SparkSession, root: str) -> DataFrame:
    return image_table(list_files(spark, root).select("path"))
