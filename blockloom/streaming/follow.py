"""Following the chain tip into a hot table of committed block scopes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from blockloom.operators.intervals import bucket_of
from blockloom.operators.windows import first_rows, reorg_invalidations
from blockloom.session import materialized
from blockloom.sinks.append import append_batch, append_dedupe, path_exists
from blockloom.sinks.compact import scope_block_range
from blockloom.sinks.scopes import current_scopes, extend_scopes, is_committed, read_committed, scope_states
from blockloom.sources.unify import hot_cold_union
from blockloom.streaming.jobs import start_batches

BLOCK = ["chain_id", "block_number"]


def hot_scope(scope_size: int) -> Column:
    """``<chain>_<first>-<last>``: the fixed-size block range a row is stored under."""
    start = bucket_of("block_number", scope_size) * scope_size
    text = [F.col("chain_id").cast("string"), F.lit("_"), start.cast("string"), F.lit("-"), (start + scope_size - 1).cast("string")]
    return F.concat(*text)


def _stored_tips(spark, hot_table: str) -> dict[int, int]:
    """Highest stored block per chain, from the pointers; one row per chain.

    Only a last scope whose pointer does not know it is read.
    """
    chain, first, _ = scope_block_range(F.col("scope"))
    pointers = current_scopes(spark, hot_table).filter("row_count > 0")
    last = pointers.groupBy(chain.alias("chain_id")).agg(F.max_by(F.struct("scope", "high"), first).alias("last")).collect()
    unknown = [row.last.scope for row in last if row.last.high is None]
    tips = {row.chain_id: row.last.high for row in last}
    if unknown:
        read = read_committed(spark, hot_table, unknown).groupBy("chain_id").agg(F.max("block_number").alias("tip"))
        tips |= {row.chain_id: row.tip for row in read.collect()}
    return tips


def apply_blocks(
    batch: DataFrame,
    commit_id: str,
    hot_table: str,
    invalidation_path: str,
    event_path: str,
    dataset_uuid: str,
    dataset_version: str,
    scope_size: int,
    threshold_blocks: int | None = None,
    row_key: Sequence[str] = (),
) -> None:
    """Merge one batch of observed blocks, or of rows inside blocks, exactly once per ``commit_id``.

    ``row_key`` are the columns that tell the rows of one block apart, such as ``log_index``.
    Which hash a block has is decided for the block as a whole: the latest ``seen_at`` wins,
    in the batch and against the table, so a late redelivery of an abandoned block changes
    nothing. ``seen_at`` is kept in the table for that.

    New blocks are appended to their scope as a piece of its own; only blocks from the lowest
    changed one on are written again. Stored rows are read between the batch's lowest and
    highest block alone, which file statistics turn into skipped files.

    Order: detected reorgs are stored next to the table, then data and pointers are
    committed, then invalidations and the cursor event go out. A replay of a committed
    batch only repeats the last step, from what was stored.
    """
    spark = batch.sparkSession
    pending = f"{hot_table}/pending/{commit_id}"
    if not is_committed(spark, hot_table, commit_id):
        rows = first_rows(_of_latest(batch), [*BLOCK, *row_key], [F.desc("seen_at")])
        rows = rows.withColumn("partition_key", hot_scope(scope_size))
        observed = batch.select("chain_id", "block_number", hot_scope(scope_size).alias("partition_key"))
        _commit_blocks(rows, commit_id, hot_table, pending, row_key, observed)
    reorgs = spark.read.schema(_REORG_SCHEMA).parquet(pending)
    # Ids of invalidations hold the commit id, so no other batch can bring them.
    found = reorg_invalidations(reorgs.filter("fork_block IS NOT NULL"), dataset_uuid, dataset_version, commit_id)
    append_batch(found, invalidation_path, commit_id)
    step = threshold_blocks or 1
    cursor = F.floor((F.col("new_tip") + 1) / F.lit(step)).cast("bigint") * step - 1
    events = reorgs.select(
        F.lit(dataset_uuid).alias("dataset_uuid"),
        F.lit(dataset_version).alias("dataset_version"),
        "chain_id",
        cursor.alias("cursor"),
    ).filter("cursor >= 0")
    append_dedupe(event_path, events, ["dataset_uuid", "dataset_version", "chain_id", "cursor"], ["cursor"], commit_id)


_REORG_SCHEMA = "chain_id bigint, new_tip bigint, fork_block bigint, old_tip bigint, changed_blocks bigint"


def _latest(rows: DataFrame) -> DataFrame:
    """Hash of every block: the one seen last, ties by the hash itself."""
    newest = rows.groupBy(*BLOCK).agg(F.max(F.struct("seen_at", "block_hash")).alias("_newest"))
    return newest.select(*BLOCK, "_newest.block_hash", "_newest.seen_at")


def _of_latest(rows: DataFrame) -> DataFrame:
    """Rows that carry the hash ``_latest`` gives their block; rows without a block or hash go.

    One shuffle by block, which serves what is ranked or joined by block afterwards too.
    """
    newest_first = Window.partitionBy(*BLOCK).orderBy(F.desc("seen_at"), F.desc("block_hash"))
    named = rows.filter(F.col("chain_id").isNotNull() & F.col("block_number").isNotNull())
    judged = named.withColumn("_newest", F.first("block_hash").over(newest_first))
    return judged.filter(F.col("block_hash") == F.col("_newest")).drop("_newest")


def _commit_blocks(
    rows: DataFrame, commit_id: str, hot_table: str, pending: str, row_key: Sequence[str], observed: DataFrame
) -> None:
    spark = rows.sparkSession
    # Scopes and the block range of one micro-batch; stored data is read for these only.
    low, high = F.min("block_number").alias("low"), F.max("block_number").alias("high")
    reach = observed.groupBy("partition_key").agg(low, high).collect()
    names = [row.partition_key for row in reach]
    if path_exists(spark, f"{hot_table}/commits"):
        ends = F.lit(min((row.low for row in reach), default=0)), F.lit(max((row.high for row in reach), default=-1))
        stored = read_committed(spark, hot_table, names).filter(F.col("block_number").between(*ends))
        old_tips = _stored_tips(spark, hot_table)
    else:
        stored, old_tips = spark.createDataFrame([], rows.schema), {}
    known = _latest(stored).select(*BLOCK, F.col("block_hash").alias("_hash"), F.struct("seen_at", "block_hash").alias("_seen"))
    outdated = (F.col("block_hash") != F.col("_hash")) & (F.struct("seen_at", "block_hash") < F.col("_seen"))
    changed = F.col("_hash").isNotNull() & (F.col("block_hash") != F.col("_hash"))
    news = rows.join(known, BLOCK, "left").filter(~F.coalesce(outdated, F.lit(False)))
    news = materialized(news.withColumn("_changed", changed).select(*rows.columns, "_changed"), "news")
    # The fork of a chain is its lowest block whose stored hash differs; everything stored
    # from there to the old tip is orphaned, also in later scopes. One row per changed scope.
    differing = F.when(F.col("_changed"), F.col("block_number"))
    changes = news.groupBy("chain_id", "partition_key").agg(
        low, high, F.min(differing).alias("fork"), F.count_distinct(differing).alias("changed")
    )
    changes = changes.collect()
    notes = []
    for chain in {row.chain_id for row in changes}:
        mine = [row for row in changes if row.chain_id == chain]
        fork = min((row.fork for row in mine if row.fork is not None), default=None)
        found = (fork, old_tips.get(chain), sum(row.changed for row in mine)) if fork is not None else (None, None, None)
        notes.append((chain, max(row.high for row in mine), *found))
    reorgs = [(chain, fork, tip) for chain, _, fork, tip, _ in notes if fork is not None]
    spark.createDataFrame(notes, _REORG_SCHEMA).coalesce(1).write.mode("overwrite").parquet(pending)
    cuts = {row.partition_key: row.low for row in changes}
    for row in _orphaned(spark, hot_table, reorgs):
        cuts[row.partition_key] = min(row.cut_from, cuts.get(row.partition_key, row.cut_from))
    states = scope_states(spark, hot_table, cuts)
    fresh = news.drop("_changed")
    met = {n: cuts[n] for n, row in states.items() if row.row_count and (row.high is None or row.high >= cuts[n])}
    if met:  # else all blocks are new ones at the end of their scopes
        stored = read_committed(spark, hot_table, list(met)).filter(F.col("block_number") >= min(met.values()))
        bounds = spark.createDataFrame(list(met.items()), "partition_key string, _cut bigint")
        kept = stored.join(F.broadcast(bounds), "partition_key").filter(F.col("block_number") >= F.col("_cut"))
        old = F.broadcast(spark.createDataFrame(reorgs, "chain_id bigint, _fork bigint, _tip bigint"))  # a row per chain
        on_old_branch = F.col("block_number").between(F.col("_fork"), F.col("_tip"))
        kept = kept.join(old, "chain_id", "left").filter(~F.coalesce(on_old_branch, F.lit(False))).select(*fresh.columns)
        fresh = hot_cold_union(fresh, kept, [*BLOCK, *row_key])
    # A batch of outdated rows only has no cuts: an empty commit keeps its replay short.
    extend_scopes(fresh, hot_table, cuts, "block_number", commit_id=commit_id)


def _orphaned(spark, hot_table: str, reorgs: list[tuple[int, int, int]]) -> list:
    """``partition_key, cut_from`` of the stored scopes that a reorg reaches."""
    if not reorgs:
        return []
    chain, first, last = scope_block_range(F.col("scope"))
    stored = current_scopes(spark, hot_table).filter("row_count > 0")
    stored = stored.select(chain.alias("chain_id"), first.alias("_first"), last.alias("_last"), F.col("scope").alias("partition_key"))
    forks = F.broadcast(spark.createDataFrame(reorgs, "chain_id bigint, _fork bigint, _tip bigint"))  # a row per chain
    reached = (F.col("_last") >= F.col("_fork")) & (F.col("_first") <= F.col("_tip"))
    cut = F.greatest("_first", "_fork").alias("cut_from")
    return stored.join(forks, "chain_id").filter(reached).select("partition_key", cut).collect()


def follow_blocks(
    stream: DataFrame,
    stream_name: str,
    hot_table: str,
    invalidation_path: str,
    event_path: str,
    checkpoint: str,
    dataset_uuid: str,
    dataset_version: str,
    scope_size: int = 100_000,
    threshold_blocks: int | None = None,
    interval: str | None = None,
    row_key: Sequence[str] = (),
) -> StreamingQuery:
    """Blocks (chain_id, block_number, block_hash, ..., seen_at) into the hot table.

    With ``row_key``, logs or transactions: several rows per block, told apart by these columns.

    ``stream_name`` names the checkpoint: with a new checkpoint, use a new name. A cursor
    event goes out per update, or per ``threshold_blocks`` blocks when set.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():  # an interval may pass without a block
            apply_blocks(
                batch, f"{stream_name}-{batch_id}", hot_table, invalidation_path, event_path,
                dataset_uuid, dataset_version, scope_size, threshold_blocks, row_key,
            )

    return start_batches(stream, handle, checkpoint, interval)
