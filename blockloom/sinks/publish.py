"""Publishing block ranges as versioned, manifest-pinned datasets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.functions.ids import dataset_version
from blockloom.operators.intervals import assign_ranges
from blockloom.operators.sets import keys_per_version
from blockloom.session import materialized
from blockloom.sinks.files import list_folders, output_caps, qualified, store_of
from blockloom.sources.manifests import MANIFEST_NAME, MANIFEST_VERSION

# Folder names of the version-addressed layout; the range stays visible in every path. They
# differ from the data columns, because Spark takes folder columns out of the files.
LAYOUT = {"chain": "chain_id", "dataset": "dataset_uuid", "range": "block_range", "version": "dataset_version"}


class OutputCapsExceeded(RuntimeError):
    """A published range has too many or too large files."""


def plan_publications(ranges: DataFrame) -> DataFrame:
    """Adds the deterministic version and the prefix of each range.

    ``ranges``: dataset_uuid, chain_id, range_start, range_end, config_hash.
    """
    bounds = F.concat_ws("_", F.col("range_start").cast("string"), F.col("range_end").cast("string"))
    version = dataset_version("dataset_uuid", "config_hash", "chain_id", "range_start", "range_end")
    folders = [F.concat(F.lit(f"{name}="), F.col(column).cast("string")) for name, column in LAYOUT.items()]
    return ranges.withColumns({"dataset_version": version, "block_range": bounds}).withColumn(
        "storage_prefix", F.concat_ws("/", F.lit("cryo"), *folders)
    )


def publish_ranges(df: DataFrame, ranges: DataFrame, root: str, bucket_size: int | None = None) -> DataFrame:
    """Write each range under its own version prefix, pin its files in a manifest, and
    return the publications to register.

    All ranges are written by one job, beside what is there: nothing that a reader has
    pinned is touched. A version that has its manifest is complete, so publishing it again
    writes nothing. Only the folders of versions to write are listed, by the executors, so a
    call costs as much as it publishes, whatever the dataset holds. The output caps hold for the files of this call; a range over them fails
    before any manifest is written, and its files stay unseen, since only manifests name
    files. Ranges without rows are published with no files and get no manifest.
    """
    spark = df.sparkSession
    planned = plan_publications(ranges)
    if set(LAYOUT) & set(df.columns):
        raise ValueError(f"data columns clash with folder names: {sorted(set(LAYOUT) & set(df.columns))}")
    version = F.regexp_extract("path", r"/version=([^/]+)/", 1)
    address = qualified(spark, root)
    todo = materialized(planned.mapInPandas(_without_manifest(address), planned.schema), "ranges")
    # What earlier calls that failed left in the folders of this call's versions.
    before = materialized(list_folders(todo, address), "files")
    spans = todo.select("chain_id", "range_start", "range_end", *list(LAYOUT.values())[1:])
    tagged = assign_ranges(df, spans, ["chain_id"], bucket_size=bucket_size)
    folders = [F.col(column).alias(name) for name, column in LAYOUT.items()]
    written = tagged.select(*df.columns, *folders).hint("rebalance", *LAYOUT)
    written.write.mode("append").partitionBy(*LAYOUT).parquet(f"{root}/cryo")
    files = list_folders(todo, address).join(before.select("path"), "path", "left_anti")
    files = materialized(files.withColumn("range_key", version), "files")
    broken = output_caps(files).limit(5).collect()
    if broken:
        raise OutputCapsExceeded("; ".join(f"{r.range_key} {r.measure} {r.value} > {r.limit}" for r in broken))
    manifests = manifest_rows(todo, files)
    manifests.select("storage_prefix", "body").foreachPartition(_manifest_writer(address))
    return planned.select(
        "dataset_uuid",
        "dataset_version",
        F.concat(F.lit(f"{root}/"), "storage_prefix", F.lit("/")).alias("storage_prefix"),
        F.lit("*.parquet").alias("storage_glob"),
        "config_hash",
        "range_start",
        "range_end",
    )


def manifest_rows(planned: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest columns and JSON body per published range, keys sorted and de-duplicated.

    One row holds at most one range's file names, which the output caps keep at 256.
    """
    key = F.regexp_extract("path", r"(cryo/chain=.*)$", 1)
    listed = files.select(
        F.regexp_extract("path", r"/version=([^/]+)/", 1).alias("dataset_version"), key.alias("path")
    )
    document = F.struct(
        F.lit(MANIFEST_VERSION).alias("version"), "dataset_uuid", "dataset_version", "parquet_keys"
    )
    return (
        keys_per_version(listed, ["dataset_version"])
        .join(planned.select("dataset_version", "dataset_uuid", "storage_prefix"), "dataset_version")
        .select(
            "storage_prefix",
            F.lit(MANIFEST_VERSION).alias("version"),
            "dataset_uuid",
            "dataset_version",
            "parquet_keys",
            F.to_json(document).alias("body"),
        )
    )


def _without_manifest(root: str):
    """Keeps the ranges that have no manifest yet; Spark's listings hide such file names."""

    def keep(batches: Iterable) -> Iterable:
        store, base = store_of(root)
        for batch in batches:
            found = store.get_file_info([f"{base}/{prefix}/{MANIFEST_NAME}" for prefix in batch["storage_prefix"]])
            yield batch[[info.type.name == "NotFound" for info in found]]

    return keep


def _manifest_writer(root: str):
    """Writes ``_manifest.json`` files from the executors; Spark's writers cannot name files."""

    def write(rows: Iterable) -> None:
        store, base = store_of(root)
        for row in rows:
            with store.open_output_stream(f"{base}/{row.storage_prefix}/{MANIFEST_NAME}") as out:
                out.write(row.body.encode("utf-8"))

    return write
