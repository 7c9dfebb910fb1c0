"""Moving finalized hot rows to cold storage and out of hot storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.operators.filters import finalized_only
from blockloom.sinks.scopes import current_scopes, read_committed, replace_scope, replace_scopes


def scope_block_range(scope: Column) -> tuple[Column, Column, Column]:
    """``(chain, first, last)`` of a scope named ``first-last`` or ``<chain>_first-last``."""
    pattern = r"^(?:(\d+)_)?(\d+)-(\d+)$"
    chain, first, last = (F.regexp_extract(scope, pattern, i).try_cast("bigint") for i in (1, 2, 3))
    return chain, first, last


def _bounds(key: str) -> tuple[int, int]:
    first, last = key.split("-")
    return int(first), int(last)


def compact_finalized(
    hot: DataFrame, cold_table: str, partition: str, finality_depth: int, chunk_size: int, tips: DataFrame | None = None
) -> int:
    """Write the finalized rows of one partition to cold, at most ``chunk_size`` rows per file.

    The tip is that of the whole hot table; running it again replaces the same scope.
    """
    first, last = _bounds(partition)
    done = finalized_only(hot, finality_depth, tips).filter(F.col("block_number").between(first, last))
    return replace_scope(done, cold_table, partition, max_records_per_file=chunk_size)


def purge_range(spark: SparkSession, hot_table: str, partition: str, cold_table: str | None = None) -> int:
    """Remove the inclusive block range from hot storage.

    With ``cold_table`` only rows whose block is committed there are removed, so a row that
    arrived after compaction stays. Scopes outside the range are not read or rewritten; all
    changed scopes flip in one commit.
    """
    first, last = _bounds(partition)
    _, scope_first, scope_last = scope_block_range(F.col("scope"))
    overlaps = (scope_first <= last) & (scope_last >= first) & (F.col("row_count") > 0)
    hit = current_scopes(spark, hot_table).filter(overlaps).select(F.col("scope").alias("partition_key"))
    rows = read_committed(spark, hot_table, [row.partition_key for row in hit.collect()])
    inside = F.col("block_number").between(first, last)
    kept = rows.filter(~inside)
    if cold_table is not None:
        blocks = read_committed(spark, cold_table, [partition]).select("chain_id", "block_number").distinct()
        late = rows.filter(inside).join(blocks, ["chain_id", "block_number"], "left_anti")
        kept = kept.unionByName(late)
    return replace_scopes(kept, hot_table, scopes=hit)
