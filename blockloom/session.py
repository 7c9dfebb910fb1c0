"""Session settings and the shared folder used for durable intermediate files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Settings that keep plans sound when the data grows: AQE re-plans joins from measured
# sizes and splits skewed partitions; shuffle partitions start high and are coalesced.
SCALE_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
}


def get_session(app_name: str = "blockloom", master: str | None = None, **settings: str) -> SparkSession:
    """Session with the scale settings; ``settings`` override them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SCALE_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without the setting gets a temporary folder of its own.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="blockloom-")
    spark.conf.set(CHECKPOINT_KEY, own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; nothing is created or deleted here."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, name: str = "stage", compression: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts lineage, survives lost executors and, unlike a checkpoint, is computed only once.
    The file size also gives the planner a true size for its join choice. ``compression`` is
    that of the session unless given.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


MAX_BROADCAST_BYTES = 64 << 20


def is_bounded(df: DataFrame, max_rows: int = 100_000, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows and, written out, ``max_bytes`` bytes.

    One aggregate that combines per partition, while a limit would send up to ``max_rows``
    rows of every partition to one task. Rows are measured as JSON, which for few rows of
    long texts or lists is what matters.
    """
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long"))
    rows, length = df.agg(F.count("*"), size).first()
    return rows <= max_rows and (length or 0) <= max_bytes


def broadcast_if_bounded(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Hint a broadcast only after counting that ``df`` has at most ``max_rows`` rows.

    A larger side comes back without a hint, so Spark joins it by shuffle and AQE splits
    skewed partitions.
    """
    return F.broadcast(df) if is_bounded(df, max_rows) else df


def bounded_side(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """An aggregated join side, computed once, with a broadcast hint if it is small."""
    return broadcast_if_bounded(materialized(df, "side"), max_rows)
