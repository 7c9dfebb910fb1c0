"""Incremental runs: what is new, what was invalidated, and how the output is written."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions.ids import chain_of_key, parse_partition_key
from blockloom.operators.filters import read_since
from blockloom.operators.intervals import few_spans, in_spans, merged_spans
from blockloom.operators.joins import FEW_BOUNDS, invalidated_rows, missing_partitions, open_invalidations, usable_invalidations
from blockloom.session import materialized
from blockloom.sinks.append import append_dedupe
from blockloom.sinks.scopes import commit_log, current_scopes, read_committed, replace_scopes

Transform = Callable[[DataFrame], DataFrame]


def mark_processed(invalidations: DataFrame, done: DataFrame) -> DataFrame:
    """Adds the job to ``processed_by`` of every processed ``(id, job_id)`` pair."""
    jobs = done.groupBy("id").agg(F.collect_set("job_id").alias("_jobs"))
    merged = F.array_sort(
        F.array_union(
            F.coalesce("processed_by", F.array().cast("array<string>")),
            F.coalesce("_jobs", F.array().cast("array<string>")),
        )
    )
    return invalidations.join(jobs, "id", "left").withColumn("processed_by", merged).drop("_jobs")


def reprocess_invalidations(
    spark: SparkSession,
    invalidations: DataFrame,
    edges: DataFrame,
    job_id: str,
    input_df: DataFrame,
    transform: Transform,
    output_table: str,
    output_uuid: str,
    output_version: str,
    scope_of_row,
) -> tuple[DataFrame, DataFrame]:
    """Recompute what open invalidations of this job hit, and hand the invalidation on.

    Only output scopes that hold a hit input row, or an output row inside the bounds, are
    recomputed as a whole and replaced in one commit. Returns ``(invalidations with this
    job marked, downstream invalidations of the replaced scopes)``; both are to be written
    after the commit. ``scope_of_row`` maps a row to its output partition key.

    An invalidation that names no rows stays open and unmarked. Downstream ids follow from
    the invalidations that were applied, so a replay gives the same ids and a later
    correction of the same scope new ones. Where all scopes are block ranges, the input is
    read within their range only.
    """
    open_ones = open_invalidations(invalidations, edges.filter(F.col("job_id") == job_id))
    mine = materialized(usable_invalidations(open_ones)[0].drop("first", "last", "chain"), "invalidations")
    hit = invalidated_rows(input_df, mine).select(scope_of_row.alias("partition_key"))
    if commit_log(spark, output_table).isEmpty():
        scopes = hit.distinct()
    else:
        stale = invalidated_rows(read_committed(spark, output_table), mine).select("partition_key")
        scopes = hit.unionByName(stale).distinct()
    # Scope names only. Fixed before the commit, which changes what the table shows.
    names = materialized(scopes.select("partition_key"), "scopes")
    scoped = _within_scopes(input_df, names).withColumn("partition_key", scope_of_row)
    replace_scopes(transform(scoped.join(names, "partition_key", "left_semi")), output_table, scopes=names)
    applied = mine.agg(F.count("id"), F.sum(F.xxhash64("id").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("id"))).first()
    source = ":".join(map(str, applied))
    downstream = names.select(
        F.sha2(F.concat_ws(":", F.lit(output_uuid), F.lit(output_version), "partition_key", F.lit(source)), 256).alias("id"),
        F.lit(output_uuid).alias("dataset_uuid"),
        F.lit(output_version).alias("dataset_version"),
        F.lit("partition").alias("scope"),
        "partition_key",
        F.lit(None).cast("struct<gte:bigint,lte:bigint>").alias("row_filter"),
        F.lit("correction").alias("reason"),
        F.array().cast("array<string>").alias("processed_by"),
    )
    return mark_processed(invalidations, mine.select("id", "job_id")), downstream


def _within_scopes(df: DataFrame, names: DataFrame, block: str = "block_number", chain: str = "chain_id") -> DataFrame:
    """``df`` within the block ranges of the scopes, if every name is a block range.

    Names become ranges per chain, merged; up to ``FEW_BOUNDS`` of them are predicates that
    the scan sees one by one, so scopes far apart do not open what lies between. More are
    joined with their neighbours, which only reads more.
    """
    first, end = parse_partition_key("partition_key")
    own = chain_of_key("partition_key") if chain in df.columns else F.lit(None).cast("bigint")
    spans = names.select(own.alias("chain"), first.alias("first"), (end - 1).alias("last"))
    count, unknown = names.agg(F.count("*"), F.count_if(first.isNull() | end.isNull())).first()
    if unknown or not count or block not in df.columns:
        return df
    merged = materialized(merged_spans(spans, "chain"), "spans")
    merged = few_spans(merged, FEW_BOUNDS)
    return df.filter(in_spans(F.col(block), F.col(chain) if chain in df.columns else None, merged.collect()))


def run_cursor(
    df: DataFrame,
    cursor_column: str,
    cursor,
    transform: Transform,
    output_path: str,
    keys: list[str],
    order_by: list,
    batch_id: str,
    where: Mapping | None = None,
    allow: Iterable[str] = (),
) -> DataFrame:
    """Cursor mode: append what lies above the cursor; returns the one-row next cursor.

    The caller stores the next cursor after this returns. A crash in between repeats the
    same batch, which the append ignores.
    """
    rows, next_cursor = read_since(df, cursor_column, cursor, where, allow)
    append_dedupe(output_path, transform(rows), keys, order_by, batch_id)
    return next_cursor


def run_partitions(spark: SparkSession, upstream: DataFrame, transform: Transform, output_table: str) -> int:
    """Partition mode: materialize upstream partitions that the output does not have yet.

    ``upstream`` rows carry ``partition_key``. Events may be lost; the difference is found
    from the tables themselves. Returns the commit number, 0 when there was nothing to do.
    """
    have = current_scopes(spark, output_table).select(F.col("scope").alias("partition_key"))
    todo = missing_partitions(upstream.select("partition_key").distinct(), have, ("partition_key",))
    if todo.isEmpty():
        return 0
    rows = upstream.join(todo, "partition_key", "left_semi")
    return replace_scopes(transform(rows), output_table, scopes=todo)


def run_full(spark: SparkSession, df: DataFrame, transform: Transform, output_table: str) -> int:
    """Full mode: recompute everything; scopes that no longer appear are emptied."""
    out = transform(df)
    old = current_scopes(spark, output_table).select(F.col("scope").alias("partition_key"))
    return replace_scopes(out, output_table, scopes=out.select("partition_key").unionByName(old).distinct())


def run_incremental(mode: str, spark: SparkSession, df: DataFrame, transform: Transform, output: str, **options):
    """One entry for the three modes: ``partition``, ``cursor`` and ``full``."""
    if mode == "partition":
        return run_partitions(spark, df, transform, output)
    if mode == "full":
        return run_full(spark, df, transform, output)
    if mode == "cursor":
        return run_cursor(df, transform=transform, output_path=output, **options)
    raise ValueError(f"unknown mode: {mode}")
