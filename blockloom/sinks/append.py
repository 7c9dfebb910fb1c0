"""Replay-safe append on plain Parquet, with an index of keys.

Layout of a table::

    batch_id=<id>/*.parquet                                 rows
    _keys/<key columns>/gen=<g>/base/bucket=<b>/*.parquet   hashes of keys of earlier generations
    _keys/<key columns>/gen=<g>/tail/batch=<id>/*.parquet   of batches since, sorted

Readers of the table do not see folders that begin with an underscore.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.operators.windows import first_rows
from blockloom.session import is_bounded, materialized

BATCH_COLUMN = "batch_id"
BUCKET_BITS = 6
TAIL_BATCHES = 32  # batches whose hashes lie beside the sorted base before they are merged into it
MANY_BATCHES = 500
FEW_KEYS = 1_000_000  # hashes of 8 bytes: 8 MB
_PLAIN_NAME = r"[A-Za-z0-9_.,@+~ -]+"  # written as a folder name without escaping
KEY_SCHEMA = "_key_hash bigint, _batch string"


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, ascending; none if there is no such folder. Contents are not read."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(target):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(target))


def read_appended(spark: SparkSession, target_path: str) -> DataFrame:
    """Rows of an appended table without its batch bookkeeping column."""
    return spark.read.parquet(target_path).drop(BATCH_COLUMN)


def append_batch(df: DataFrame, target_path: str, batch_id: str) -> None:
    """Rows into the folder of their batch; a replay overwrites what it wrote before.

    For rows that no other batch can bring; the target is not read.
    """
    writer = df.withColumn(BATCH_COLUMN, F.lit(batch_id)).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(BATCH_COLUMN).parquet(target_path)


def append_large_batch(df: DataFrame, target_path: str, batch_id: str, **options: str) -> None:
    """``append_batch`` for very many rows, which go to the batch's folder without being dealt
    to folders one by one. ``options`` are those of the Parquet writer.

    A replay empties the folder first, so readers may miss the batch's rows until it is done. A
    batch without rows leaves a file with the schema alone.
    """
    if re.fullmatch(_PLAIN_NAME, batch_id):
        df.write.mode("overwrite").options(**options).parquet(f"{target_path}/{BATCH_COLUMN}={batch_id}")
    else:
        append_batch(df, target_path, batch_id)


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys)


def hash_bucket(value: Column) -> Column:
    """Bucket of a hash: its highest bits, so that a bucket is a range of hashes."""
    return F.shiftrightunsigned(value, 64 - BUCKET_BITS).cast("int")


class KeyIndex:
    """Hashes of all keys of an appended table, to tell which of its batches may hold a key.

    A lookup opens the buckets of its hashes in the base, and in them only row groups whose
    range of hashes is met, and the tails of at most ``TAIL_BATCHES`` batches. A hash may be
    there without its key, never the other way round.
    """

    def __init__(self, spark: SparkSession, target_path: str, keys: Sequence[str]):
        self.spark, self.target, self.keys = spark, target_path, list(keys)
        self.path = f"{target_path}/_keys/{'+'.join(keys)}"

    def _generation(self) -> int | None:
        names = [int(name[4:]) for name in child_names(self.spark, self.path) if name.startswith("gen=")]
        for number in sorted(names, reverse=True):
            if path_exists(self.spark, f"{self.path}/gen={number}/base/_SUCCESS"):
                return number
        return None

    def _tails(self, generation: int, skip: str | None = None) -> list[str]:
        folder = f"{self.path}/gen={generation}/tail"
        return [f"{folder}/{name}" for name in child_names(self.spark, folder) if name != f"batch={skip}"]

    def _read(self, generation: int, skip: str | None, buckets: Sequence[int] | None = None) -> DataFrame:
        base = self.spark.read.schema(f"{KEY_SCHEMA}, bucket int").parquet(f"{self.path}/gen={generation}/base")
        if buckets is not None:
            base = base.filter(F.col("bucket").isin(*buckets))
        rows, tails = base.drop("bucket"), self._tails(generation, skip)
        return rows.unionByName(self.spark.read.schema(KEY_SCHEMA).parquet(*tails)) if tails else rows

    def _write_base(self, rows: DataFrame, generation: int) -> None:
        """Sorted by hash and split by ranges, so that a bucket's files and row groups do not overlap."""
        rows = rows.withColumn("bucket", hash_bucket(F.col("_key_hash")))
        rows = rows.repartitionByRange("_key_hash").sortWithinPartitions("_key_hash")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/gen={generation}/base")

    def prepare(self) -> int:
        """The generation to append to. Merges a long tail; indexes a table that has no index."""
        generation = self._generation()
        if generation is None:
            rows = self.spark.createDataFrame([], KEY_SCHEMA).coalesce(1)
            if [name for name in child_names(self.spark, self.target) if name.startswith(f"{BATCH_COLUMN}=")]:
                stored = self.spark.read.parquet(self.target)
                rows = stored.select(key_hash(self.keys).alias("_key_hash"), F.col(BATCH_COLUMN).cast("string").alias("_batch"))
            self._write_base(rows, 0)
            return 0
        if len(self._tails(generation)) < TAIL_BATCHES:
            return generation
        self._write_base(self._read(generation, None), generation + 1)
        return generation + 1

    def lookup(
        self, hashes: DataFrame, buckets: Sequence[int], low: int, high: int, generation: int, batch_id: str, count: int | None = None
    ) -> DataFrame:
        """``_key_hash, _batch`` of index rows whose hash is among ``hashes``, but those of the batch itself.

        ``buckets`` and the range ``low .. high`` must cover ``hashes``, of which there are ``count``.
        """
        rows = self._read(generation, batch_id, buckets).filter(F.col("_key_hash").between(F.lit(low), F.lit(high)))
        small = count <= FEW_KEYS if count is not None else is_bounded(hashes, FEW_KEYS)
        wanted = F.broadcast(hashes) if small else hashes
        return rows.filter(F.col("_batch") != batch_id).join(wanted, "_key_hash", "left_semi")

    def add(self, keys: DataFrame, generation: int, batch_id: str, count: int) -> None:
        """Hashes of at most ``count`` keys, sorted; many are split by ranges."""
        rows = keys.select("_key_hash", F.lit(batch_id).alias("_batch"))
        rows = rows.coalesce(1) if count <= FEW_KEYS else rows.repartitionByRange("_key_hash")
        rows = rows.sortWithinPartitions("_key_hash")
        rows.write.mode("overwrite").parquet(f"{self.path}/gen={generation}/tail/batch={batch_id}")


def stored_rows(spark: SparkSession, target_path: str, schema: T.StructType, batches: Sequence[str]) -> DataFrame:
    """Rows of an appended table; of the named batches alone unless they are too many."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(BATCH_COLUMN, T.StringType())])).parquet(target_path)
    return rows if len(batches) > MANY_BATCHES else rows.filter(F.col(BATCH_COLUMN).isin(*batches))


def append_dedupe(
    target_path: str,
    batch: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[Column | str],
    batch_id: str,
    range_column: str | None = None,
) -> None:
    """Insert rows whose key is absent; existing rows win, then the first row in the batch.

    Every batch owns one directory. A replayed batch ignores its own earlier output and
    overwrites it, so a crash at any point leaves no duplicate and no loss. The table has
    one writer at a time.

    Keys are looked up in the table's ``KeyIndex``: only buckets of the batch's hashes are
    opened. Rows themselves are read only of batches in which a hash was found, and only
    their key columns, which then decide; a batch of new keys reads no row of the table,
    however late they are. ``range_column`` (one of ``keys``) also restricts that scan to
    the batch's value range. Hashes are written before the rows: one without a row is harmless.
    """
    spark, keys = batch.sparkSession, list(keys)
    index = KeyIndex(spark, target_path, keys)
    generation = index.prepare()
    first = first_rows(batch, keys, list(order_by))
    first = materialized(first.withColumn("_key_hash", key_hash(keys)), "append", "zstd")
    bounds = [] if range_column is None else [F.min(range_column).alias("_from"), F.max(range_column).alias("_to")]
    own = F.col("_key_hash")
    ends = [F.count("*").alias("keys"), F.min(own).alias("low"), F.max(own).alias("high")]
    seen = first.agg(*ends, F.collect_set(hash_bucket(own)).alias("buckets"), *bounds).first()
    fresh = first
    if seen.buckets:
        found = index.lookup(first.select("_key_hash"), seen.buckets, seen.low, seen.high, generation, batch_id, seen[0])
        # Names of batches that may hold a key; too many of them are not worth a predicate.
        batches = [row[0] for row in found.select("_batch").distinct().limit(MANY_BATCHES + 1).collect()]
        if batches:
            existing = stored_rows(spark, target_path, batch.schema, batches).filter(F.col(BATCH_COLUMN) != batch_id)
            if range_column is not None:
                existing = existing.filter(F.col(range_column).between(F.lit(seen._from), F.lit(seen._to)))
            probe = first.select(*keys)
            probe = F.broadcast(probe) if is_bounded(probe) else probe
            # Their keys alone are stored, and rows go to the table as they come from the join.
            taken = materialized(existing.select(*keys).join(probe, keys, "left_semi"), "taken", "zstd")
            fresh = first.join(taken, keys, "left_anti")
    index.add(fresh, generation, batch_id, seen[0])
    append_batch(fresh.drop("_key_hash"), target_path, batch_id)
