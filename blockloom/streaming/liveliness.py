"""Stall detection driven by a clock, so that silence is reported too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from blockloom.operators.windows import liveliness
from blockloom.session import materialized
from blockloom.sinks.append import append_batch, path_exists
from blockloom.sinks.scopes import is_committed, read_committed, replace_scope
from blockloom.streaming.jobs import start_batches

STATE_SCOPE = "chains"


def clock(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """Processing time as a stream of ``at``; it goes on while no block arrives."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return ticks.select(F.col("timestamp").alias("at"))


def apply_ticks(
    batch: DataFrame,
    commit_id: str,
    state_table: str,
    event_path: str,
    expected_block_time_ms: int,
    alert_threshold_ms: int,
    changes_only: bool = False,
) -> None:
    """Take the blocks of a batch into the state, then judge every known chain at its last tick.

    Rows are blocks (``chain_id, block_number, block_time``) or ticks (``at``). A chain is
    judged by the highest block and the latest block time seen so far, so late and repeated
    blocks change nothing. Each tick gives an event per chain, with ``changes_only`` one per
    chain whose status is another than at the tick before. Ticks that a batch has besides its
    last are missed runs and not made up for; a batch without a tick only moves the state.

    A replay before the commit of the state writes the same events over its own; one after
    it does nothing. The state is one row per chain.
    """
    spark = batch.sparkSession
    if is_committed(spark, state_table, commit_id):
        return
    at = batch.agg(F.max("at")).first()[0]
    blocks = batch.filter("chain_id IS NOT NULL AND block_number IS NOT NULL")
    seen = blocks.select("chain_id", "block_number", "block_time", F.lit(None).cast("string").alias("_before"))
    if path_exists(spark, f"{state_table}/commits"):
        columns = ["chain_id", F.col("last_block").alias("block_number"), F.col("last_block_time").alias("block_time")]
        seen = seen.unionByName(read_committed(spark, state_table).select(*columns, F.col("status").alias("_before")))
    known = seen.groupBy("chain_id").agg(
        F.max("block_number").alias("block_number"), F.max("block_time").alias("block_time"), F.max("_before").alias("_before")
    )
    known = materialized(known, "chains")
    now = F.lit(at).cast(batch.schema["block_time"].dataType)
    judged = liveliness(known, now, expected_block_time_ms, alert_threshold_ms).join(known.select("chain_id", "_before"), "chain_id")
    if at is None:
        judged = judged.withColumn("status", F.col("_before"))
    else:
        events = judged.filter(~F.col("status").eqNullSafe(F.col("_before"))) if changes_only else judged
        events = events.select("chain_id", now.alias("judged_at"), "last_block", "last_block_time", "gap_ms", "status")
        append_batch(events, event_path, commit_id)
    state = judged.select("chain_id", "last_block", "last_block_time", "status")
    replace_scope(state, state_table, STATE_SCOPE, commit_id=commit_id)


def liveliness_stream(
    blocks: DataFrame,
    ticks: DataFrame,
    stream_name: str,
    state_table: str,
    event_path: str,
    checkpoint: str,
    expected_block_time_ms: int,
    alert_threshold_ms: int,
    changes_only: bool = False,
    interval: str | None = None,
) -> StreamingQuery:
    """``apply_ticks`` per micro-batch over a stream of blocks and one of ticks, such as ``clock``.

    Both are one query with one checkpoint, so a tick judges what has arrived before it.
    """
    kind = blocks.schema["block_time"].dataType
    rows = blocks.select("chain_id", "block_number", "block_time", F.lit(None).cast(kind).alias("at"))
    moments = [F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in ("chain_id", "block_number", "block_time")]
    rows = rows.unionByName(ticks.select(*moments, F.col("at").cast(kind).alias("at")))

    def handle(batch: DataFrame, batch_id: int) -> None:
        apply_ticks(
            batch, f"{stream_name}-{batch_id}", state_table, event_path,
            expected_block_time_ms, alert_threshold_ms, changes_only,
        )

    return start_batches(rows, handle, checkpoint, interval)
