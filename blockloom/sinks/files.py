"""File listings as rows: caps, staging retention, partition sizes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Output limits per range and staging retention.
MAX_FILES_PER_RANGE = 256
MAX_BYTES_PER_FILE = 512 * 1024 * 1024
MAX_BYTES_PER_RANGE = 2 * 1024 * 1024 * 1024
STAGING_RETENTION_SECONDS = 7 * 24 * 3600


def list_files(spark: SparkSession, *paths: str, glob: str = "*.parquet") -> DataFrame:
    """path, length and modificationTime of every file below ``paths``; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(list(paths))
        .select("path", "length", "modificationTime")
    )


def qualified(spark: SparkSession, root: str) -> str:
    """``root`` with the scheme of the file system that Spark's own writers use for it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    address = path.makeQualified(system.getUri(), system.getWorkingDirectory()).toString()
    return address.replace("file:/", "file:///", 1) if address.startswith("file:/") and not address.startswith("file://") else address


def store_of(address: str):
    """The file system of a qualified path and the path in it, for use by executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(address.replace("s3a://", "s3://", 1))


def list_folders(folders: DataFrame, address: str, column: str = "storage_prefix", suffix: str = ".parquet") -> DataFrame:
    """path (below ``address``), length and modificationTime of the files in each folder.

    Executors list the folders, each by itself; nothing else below ``address`` is looked at and
    the driver sees no name. Folders that do not exist have no rows.
    """

    def listed(batches: Iterable) -> Iterable:
        import pandas as pd
        from pyarrow import fs

        store, base = store_of(address)
        for batch in batches:
            rows = []
            for folder in batch[column]:
                found = store.get_file_info(fs.FileSelector(f"{base}/{folder}", allow_not_found=True))
                rows += [(f"{folder}/{info.base_name}", info.size, info.mtime) for info in found if info.base_name.endswith(suffix)]
            yield pd.DataFrame(rows, columns=["path", "length", "modificationTime"])

    return folders.select(column).mapInPandas(listed, "path string, length bigint, modificationTime timestamp")


def output_caps(
    files: DataFrame,
    group: str = "range_key",
    max_files: int = MAX_FILES_PER_RANGE,
    max_file_bytes: int = MAX_BYTES_PER_FILE,
    max_total_bytes: int = MAX_BYTES_PER_RANGE,
) -> DataFrame:
    """One row per range and exceeded limit."""
    measures = [("files", max_files), ("largest_file", max_file_bytes), ("total_bytes", max_total_bytes)]
    per_range = files.groupBy(group).agg(
        F.count(F.lit(1)).alias("files"),
        F.max("length").cast("bigint").alias("largest_file"),
        F.sum("length").cast("bigint").alias("total_bytes"),
    )
    return (
        per_range.unpivot([group], [name for name, _ in measures], "measure", "value")
        .join(F.broadcast(_limits(files.sparkSession, measures)), "measure")
        .filter(F.col("value") > F.col("limit"))
        .select(group, "measure", "value", "limit")
    )


def _limits(spark: SparkSession, measures: list[tuple[str, int]]) -> DataFrame:
    return spark.createDataFrame(measures, "measure string, limit bigint")


def attempt_folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*/attempt=[^/]+)", 1)


def expired_staging(
    files: DataFrame, committed: DataFrame, now: Column, retention_seconds: int = STAGING_RETENTION_SECONDS
) -> DataFrame:
    """Attempt folders that were never committed and whose newest file is past retention.

    ``committed``: every location ever committed, so versions kept for rollback never show.
    """
    kept = committed.filter("location IS NOT NULL").select(
        _plain(attempt_folder(F.concat("location", F.lit("/")))).alias("attempt")
    )
    return (
        files.withColumn("attempt", _plain(attempt_folder(F.col("path"))))
        .filter(F.col("attempt") != "")
        .groupBy("attempt")
        .agg(
            F.max("modificationTime").alias("newest"),
            F.count(F.lit(1)).alias("files"),
            F.sum("length").cast("bigint").alias("bytes"),
        )
        .filter(F.timestamp_diff("SECOND", F.col("newest"), now) > retention_seconds)
        .join(kept.distinct(), "attempt", "left_anti")
    )


def _plain(uri: Column) -> Column:
    """``file:/x`` and ``file:///x`` name the same folder as ``/x``."""
    return F.regexp_replace(uri, "^file:/+", "/")
