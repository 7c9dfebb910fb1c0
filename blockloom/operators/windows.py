"""Neighbour and latest-row operators.

Neighbours within one chain are found per block bucket, then across bucket edges, so a
chain that holds most rows is not one window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.operators.intervals import bucket_of
from blockloom.session import broadcast_if_bounded

BUCKET_SIZE = 100_000


def first_rows(df: DataFrame, keys: list[str], order_by: list[Column | str]) -> DataFrame:
    """First row per key. The rank filter is applied before the shuffle too, so each map
    task sends at most one row per key, however many copies a key has."""
    ranked = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("_rank", F.row_number().over(ranked)).filter("_rank = 1").drop("_rank")


def canonical_blocks(df: DataFrame, seen_at: str = "seen_at", tie_break: tuple[str, ...] = ("block_hash",)) -> DataFrame:
    """One row per (chain, block number): the latest observation wins."""
    order = [F.col(seen_at).desc(), *[F.col(c).desc() for c in tie_break]]
    return first_rows(df, ["chain_id", "block_number"], order)


def block_gaps(df: DataFrame, bucket_size: int = BUCKET_SIZE) -> DataFrame:
    """Missing inclusive ranges ``gap_start .. gap_end`` between the blocks of each chain."""
    blocks = df.select("chain_id", "block_number").distinct().withColumn("_bucket", bucket_of("block_number", bucket_size))
    within = Window.partitionBy("chain_id", "_bucket").orderBy("block_number")
    inner = blocks.select("chain_id", "block_number", F.lead("block_number").over(within).alias("_next"))
    # One row per bucket: the window over a whole chain only sees bucket edges.
    across = Window.partitionBy("chain_id").orderBy("_bucket")
    edges = (
        blocks.groupBy("chain_id", "_bucket")
        .agg(F.min("block_number").alias("_low"), F.max("block_number").alias("block_number"))
        .select("chain_id", "block_number", F.lead("_low").over(across).alias("_next"))
    )
    return (
        inner.unionByName(edges)
        .filter(F.col("_next") > F.col("block_number") + 1)
        .select(
            "chain_id",
            (F.col("block_number") + 1).alias("gap_start"),
            (F.col("_next") - 1).alias("gap_end"),
            (F.col("_next") - F.col("block_number") - 1).alias("missing"),
        )
    )


def detect_reorg(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Per chain whose stored hashes differ from the incoming ones.

    ``fork_block`` is the first differing number; everything stored from there up to
    ``old_tip`` is orphaned, which is the invalidated row range. A counted-small batch is
    broadcast, so the stored blocks are scanned without a shuffle.
    """
    new = broadcast_if_bounded(incoming.select("chain_id", "block_number", F.col("block_hash").alias("_new_hash")))
    changed = (
        stored.select("chain_id", "block_number", "block_hash")
        .join(new, ["chain_id", "block_number"])
        .filter(~F.col("block_hash").eqNullSafe(F.col("_new_hash")))
        .groupBy("chain_id")
        .agg(F.min("block_number").alias("fork_block"), F.count_distinct("block_number").alias("changed_blocks"))
    )
    old_tips = stored.groupBy("chain_id").agg(F.max("block_number").alias("old_tip"))
    new_tips = incoming.groupBy("chain_id").agg(F.max("block_number").alias("new_tip"))
    return changed.join(old_tips, "chain_id").join(new_tips, "chain_id").select(
        "chain_id", "fork_block", "old_tip", "new_tip", "changed_blocks"
    )


def reorg_invalidations(
    reorgs: DataFrame, dataset_uuid: str, dataset_version: str, commit_id: str | None = None
) -> DataFrame:
    """Row-range invalidations for detected reorgs, with a deterministic id.

    ``commit_id`` names the update that saw the reorg. With it the id of a replayed update
    stays, while a later reorg between the same tips is an invalidation of its own.
    """
    seen = [] if commit_id is None else [F.lit(commit_id).alias("commit_id")]
    event = F.to_json(F.struct("chain_id", "fork_block", "old_tip", "new_tip", *seen))
    return reorgs.select(
        F.sha2(F.concat_ws(":", F.lit(dataset_uuid), F.lit(dataset_version), event), 256).alias("id"),
        F.lit(dataset_uuid).alias("dataset_uuid"),
        F.lit(dataset_version).alias("dataset_version"),
        "chain_id",
        F.lit("row_range").alias("scope"),
        F.lit(None).cast("string").alias("partition_key"),
        F.struct(F.col("fork_block").alias("gte"), F.col("old_tip").alias("lte")).alias("row_filter"),
        F.lit("reorg").alias("reason"),
        event.alias("source_event"),
        F.array().cast("array<string>").alias("processed_by"),
    )


def _liveliness_status(gap_ms: Column, expected_ms: int, threshold_ms: int) -> Column:
    return F.when(gap_ms <= expected_ms, "ok").when(gap_ms < threshold_ms, "degraded").otherwise("stalled")


def _gap_ms(earlier: Column, later: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", earlier, later)


def liveliness(df: DataFrame, now: Column, expected_block_time_ms: int, alert_threshold_ms: int) -> DataFrame:
    """Time since the last block of each chain at ``now`` and its status."""
    gap = _gap_ms(F.col("last_block_time"), now)
    return (
        df.groupBy("chain_id")
        .agg(F.max("block_number").alias("last_block"), F.max("block_time").alias("last_block_time"))
        .withColumn("gap_ms", gap)
        .withColumn("status", _liveliness_status(F.col("gap_ms"), expected_block_time_ms, alert_threshold_ms))
    )


def liveliness_history(
    df: DataFrame, expected_block_time_ms: int, alert_threshold_ms: int, bucket_size: int = BUCKET_SIZE
) -> DataFrame:
    """Gap between each block and the one before it, with a status per block."""
    blocks = (
        df.groupBy("chain_id", "block_number")
        .agg(F.min("block_time").alias("block_time"))
        .withColumn("_bucket", bucket_of("block_number", bucket_size))
    )
    within = Window.partitionBy("chain_id", "_bucket").orderBy("block_number")
    across = Window.partitionBy("chain_id").orderBy("_bucket")
    edges = (
        blocks.groupBy("chain_id", "_bucket")
        .agg(F.max(F.struct("block_number", "block_time")).alias("_last"))
        .select("chain_id", "_bucket", F.lag("_last.block_time").over(across).alias("_edge_time"))
    )
    return (
        blocks.withColumn("_previous", F.lag("block_time").over(within))
        .join(edges, ["chain_id", "_bucket"])
        .withColumn("gap_ms", _gap_ms(F.coalesce("_previous", "_edge_time"), F.col("block_time")))
        .filter("gap_ms IS NOT NULL")
        .select(
            "chain_id",
            "block_number",
            "gap_ms",
            _liveliness_status(F.col("gap_ms"), expected_block_time_ms, alert_threshold_ms).alias("status"),
        )
    )
