"""Parquet scans: a prefix with a glob, or exactly the files a manifest pins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.session import materialized
from blockloom.sinks.files import qualified, store_of
from blockloom.sources.manifests import (
    MANIFEST_NAME,
    MAX_MANIFEST_BYTES,
    MAX_MANIFEST_OBJECTS,
    manifest_audit,
    parse_manifests,
)

DATASET_VIEW = "dataset"


class ManifestError(ValueError):
    """The manifest is malformed or breaks a containment rule."""


def attach_prefix(spark: SparkSession, prefix: str, glob: str = "*.parquet") -> DataFrame:
    """Lazy scan of ``prefix/glob``; filters and columns are pushed to the files."""
    if not prefix.strip("/"):
        raise ValueError("dataset prefix must not be empty")
    return spark.read.option("pathGlobFilter", glob).parquet(prefix)


def read_small_text(spark: SparkSession, path: str, max_bytes: int) -> str:
    """One small control document, refused unread when larger than ``max_bytes``.

    Spark's readers skip names that start with ``_``, so the file system is asked directly.
    """
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(target).getLen() > max_bytes:
        raise ManifestError(f"manifest larger than {max_bytes} bytes: {path}")
    stream = fs.open(target)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def pinned_files(
    spark: SparkSession,
    root: str,
    prefix: str,
    dataset_uuid: str,
    dataset_version: str,
    max_objects: int = MAX_MANIFEST_OBJECTS,
    max_bytes: int = MAX_MANIFEST_BYTES,
) -> list[str]:
    """Validated file list of ``root/prefix/_manifest.json``; keys are relative to ``root``."""
    key_prefix = prefix.strip("/")
    if not key_prefix:
        raise ManifestError("dataset prefix must not be empty")
    text = read_small_text(spark, f"{root}/{key_prefix}/{MANIFEST_NAME}", max_bytes)
    documents = spark.createDataFrame([(key_prefix, text)], "storage_prefix string, body string")
    manifest = parse_manifests(documents)
    registry = spark.createDataFrame(
        [(key_prefix, dataset_uuid, dataset_version)],
        "storage_prefix string, dataset_uuid string, dataset_version string",
    )
    broken = manifest_audit(manifest, registry, max_objects).select("rule").distinct().collect()
    if broken:
        raise ManifestError("manifest rejected: " + ", ".join(sorted(r.rule for r in broken)))
    keys = manifest.select(F.explode("parquet_keys").alias("key")).distinct().orderBy("key")
    return [f"{root}/{row.key.lstrip('/')}" for row in keys.collect()]


def read_manifests(prefixes: DataFrame, root: str, max_bytes: int = MAX_MANIFEST_BYTES) -> DataFrame:
    """``storage_prefix, body, oversized`` of each prefix, read by the executors.

    A missing manifest has a null body, which counts as malformed; one over ``max_bytes`` is
    not read and told apart. ``root`` is resolved as Spark resolves it, so executors read the
    file system that Spark writes to.
    """
    address = qualified(prefixes.sparkSession, root)

    def read(batches):
        from pyarrow import fs

        store, base = store_of(address)
        for pdf in batches:
            bodies, large = [], []
            for prefix in pdf["storage_prefix"]:
                path = f"{base}/{prefix.strip('/')}/{MANIFEST_NAME}"
                info = store.get_file_info(path)
                there = info.type == fs.FileType.File
                large.append(there and info.size > max_bytes)
                bodies.append(store.open_input_stream(path).read().decode("utf-8", "replace") if there and not large[-1] else None)
            yield pdf.assign(body=bodies, oversized=large)

    return prefixes.select("storage_prefix").mapInPandas(read, "storage_prefix string, body string, oversized boolean")


def attach_versions(
    publications: DataFrame,
    root: str,
    max_objects: int = MAX_MANIFEST_OBJECTS,
    view: str = DATASET_VIEW,
    max_bytes: int = MAX_MANIFEST_BYTES,
    first: int | None = None,
    last: int | None = None,
) -> DataFrame:
    """Scan the pinned files of many versions as one relation.

    ``publications``: dataset_uuid, dataset_version, storage_prefix (below ``root``). All
    manifests are read and checked by one job; any broken one refuses the whole set.

    With ``first`` or ``last`` (inclusive blocks) only publications whose ``range_start`` and
    ``range_end`` (exclusive) meet them count: the manifests and files of others are never
    opened. Rows inside a met range are not filtered.
    """
    spark = publications.sparkSession
    if first is not None:
        publications = publications.filter(F.col("range_end") > first)
    if last is not None:
        publications = publications.filter(F.col("range_start") <= last)
    relative = F.trim(F.replace("storage_prefix", F.lit(root), F.lit("")), F.lit("/"))
    registry = publications.select(relative.alias("storage_prefix"), "dataset_uuid", "dataset_version")
    manifests = materialized(parse_manifests(read_manifests(registry, root, max_bytes)), "manifests")
    broken = manifest_audit(manifests, registry, max_objects).select("rule").distinct().collect()
    if broken:
        raise ManifestError("manifest rejected: " + ", ".join(sorted(r.rule for r in broken)))
    keys = manifests.select(F.explode("parquet_keys").alias("key")).distinct().orderBy("key")
    names = [f"{root}/{row.key.lstrip('/')}" for row in keys.collect()]
    if not names:
        raise ManifestError("no publication meets the range")
    df = spark.read.parquet(*names)
    df.createOrReplaceTempView(view)
    return df


def attach_pinned(
    spark: SparkSession,
    root: str,
    prefix: str,
    dataset_uuid: str,
    dataset_version: str,
    max_objects: int = MAX_MANIFEST_OBJECTS,
    view: str = DATASET_VIEW,
) -> DataFrame:
    """Scan exactly the files of one dataset version and expose them as a temp view.

    The file list (at most ``max_objects`` names) is fixed here, so a later rewrite of the
    prefix cannot change a running query.
    """
    df = spark.read.parquet(*pinned_files(spark, root, prefix, dataset_uuid, dataset_version, max_objects))
    df.createOrReplaceTempView(view)
    return df
