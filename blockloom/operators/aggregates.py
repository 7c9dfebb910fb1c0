"""Summaries, counts and quality aggregates; all combine map-side before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions.values import day_of, schema_hash
from blockloom.session import bounded_side

MONEY = "decimal(38,2)"


def exact_sum(value, scale_type: str = "decimal(18,2)") -> Column:
    """Sum of doubles as decimals: the result does not depend on the order of rows."""
    column = value if isinstance(value, Column) else F.col(value)
    return F.sum(column.cast(scale_type))


def daily_summary(df: DataFrame, timestamp: str, value: str) -> DataFrame:
    """Row count and total value per day."""
    return df.groupBy(day_of(timestamp).alias("day")).agg(
        F.count(F.lit(1)).alias("tx_count"), exact_sum(value).alias("total_value")
    )


def duplicate_keys(df: DataFrame, key: list[str], block: str = "block_number", approximate: bool = False) -> DataFrame:
    """Keys seen in more than one block.

    The exact form groups by (key, block) first, so one hot key is spread over its blocks;
    the approximate form keeps one sketch per key.
    """
    if approximate:
        per_key = df.groupBy(*key).agg(
            F.min(block).alias("first_block"),
            F.max(block).alias("last_block"),
            F.approx_count_distinct(block).alias("num_blocks"),
        )
        # min and max are exact, so the filter never drops or adds a key.
        return per_key.filter("first_block < last_block").withColumn("num_blocks", F.greatest("num_blocks", F.lit(2)))
    return (
        df.groupBy(*key)
        .agg(
            F.min(block).alias("first_block"),
            F.max(block).alias("last_block"),
            F.count_distinct(block).alias("num_blocks"),
        )
        .filter("num_blocks > 1")
    )


def range_counts(ranges: DataFrame) -> DataFrame:
    """In-flight and completed ranges per stream."""
    return ranges.groupBy("job_id", "dataset_key").agg(
        F.count_if(F.col("status") != "completed").alias("inflight"),
        F.count_if(F.col("status") == "completed").alias("completed"),
    )


def partition_stats(df: DataFrame, files: DataFrame, partition: str = "partition_key") -> DataFrame:
    """Rows, bytes and schema hash per partition.

    ``files``: partition, length and modificationTime of each data file.
    """
    sizes = files.groupBy(partition).agg(
        F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("files"), F.max("modificationTime").alias("materialized_at")
    )
    return (
        df.groupBy(partition)
        .agg(F.count(F.lit(1)).alias("row_count"))
        .join(sizes, partition, "left")
        .withColumn("schema_hash", schema_hash(df))
    )


def validator_stats(duties: DataFrame, epoch_lookback: int, current_epoch: int | None = None) -> DataFrame:
    """Missed slots, mean inclusion distance and reward rate per validator and epoch.

    Covers the current epoch and ``epoch_lookback`` epochs before it. ``duties``:
    validator, epoch, missed, inclusion_distance, reward.
    """
    if current_epoch is None:
        current_epoch = duties.agg(F.max("epoch")).first()[0]
    recent = duties if current_epoch is None else duties.filter(F.col("epoch") >= current_epoch - epoch_lookback)
    return (
        recent.groupBy("validator", "epoch")
        .agg(
            F.count(F.lit(1)).alias("duties"),
            F.count_if("missed").alias("missed_slots"),
            F.sum("inclusion_distance").alias("_distance"),
            F.count("inclusion_distance").alias("_attested"),
            exact_sum("reward", "decimal(18,6)").alias("total_reward"),
        )
        .select(
            "validator",
            "epoch",
            "duties",
            "missed_slots",
            (F.col("_distance") / F.nullif(F.col("_attested"), F.lit(0))).alias("avg_inclusion_distance"),
            "total_reward",
            (F.col("total_reward").cast("double") / F.col("duties")).alias("reward_rate"),
        )
    )


def provider_quorum(observations: DataFrame, checks: list[str], min_agreement: int) -> DataFrame:
    """Blocks and fields on which providers disagree.

    ``observations``: chain_id, block_number, provider and the checked fields. Blocks with
    any difference are found first by min and max per field; only their answers are spread
    out by field and value. The lists hold at most one entry per provider and value.
    """
    block = ["chain_id", "block_number"]
    differs = F.lit(False)
    for check in checks:
        answered = F.count(check)
        some_missing = (answered > 0) & (answered < F.count(F.lit(1)))
        differs = differs | F.coalesce(F.min(check) != F.max(check), F.lit(False)) | some_missing
    suspects = observations.groupBy(*block).agg(differs.alias("_differs")).filter("_differs").select(*block)
    answers = (
        observations.join(bounded_side(suspects), block, "left_semi")
        .unpivot(
            ["chain_id", "block_number", "provider"],
            [F.col(c).cast("string").alias(c) for c in checks],
            "field",
            "value",
        )
        .groupBy("chain_id", "block_number", "field", "value")
        .agg(F.sort_array(F.collect_set("provider")).alias("providers"))
        .withColumn("votes", F.size("providers").cast("bigint"))
    )
    entry = F.struct("value", "votes", F.array_join("providers", ",").alias("providers"))
    return (
        answers.groupBy("chain_id", "block_number", "field")
        .agg(
            F.count(F.lit(1)).alias("variants"),
            F.max("votes").alias("top_votes"),
            F.sum("votes").alias("answers"),
            F.sort_array(F.collect_list(entry)).alias("_entries"),
        )
        .filter("variants > 1")
        .select(
            "chain_id",
            "block_number",
            "field",
            "variants",
            "answers",
            "top_votes",
            (F.col("top_votes") >= min_agreement).alias("agreement_met"),
            F.array_join(
                F.transform("_entries", lambda e: F.concat(F.coalesce(e.value, F.lit("null")), F.lit("="), e.providers)),
                ";",
            ).alias("differing_values"),
        )
    )


def query_metrics(results: DataFrame, keys: tuple[str, ...] = ("org_id", "user_id")) -> DataFrame:
    """Queries, failures, rows, bytes and duration per principal."""
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("query_count"),
        F.count_if(F.col("error_code").isNotNull()).alias("query_errors"),
        F.sum("row_count").alias("result_rows"),
        F.sum("bytes").alias("result_bytes"),
        F.max("duration_ms").alias("max_duration_ms"),
    )


def query_errors(results: DataFrame) -> DataFrame:
    """Failures by error code."""
    return results.filter("error_code IS NOT NULL").groupBy("error_code").agg(F.count(F.lit(1)).alias("query_errors"))


def histogram(df: DataFrame, value: str, low: float, high: float, buckets: int) -> DataFrame:
    """Equal-width histogram; bucket 0 is below ``low``, ``buckets + 1`` from ``high`` up."""
    bucket = F.width_bucket(F.col(value).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(buckets))
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(bucket.cast("int").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    )


def quantiles(df: DataFrame, keys: list[str], value: str, at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Quantiles per key, interpolated between the values next to a rank.

    Exact: Spark counts distinct values per key, so what is merged grows with these and not
    with the rows. Durations in milliseconds have few.
    """
    return df.groupBy(*keys).agg(*[F.percentile(value, q).alias(f"p{int(q * 100)}") for q in at])


def latest_heads(observations: DataFrame) -> DataFrame:
    """Newest head per (org, chain, pool); a tie in time keeps the higher block."""
    newest = F.max(F.struct("observed_at", "head_block"))
    return (
        observations.groupBy("org_id", "chain_id", "rpc_pool")
        .agg(newest.alias("_newest"))
        .select("org_id", "chain_id", "rpc_pool", "_newest.head_block", "_newest.observed_at")
    )


def sync_lag(jobs: DataFrame, streams: DataFrame, cursors: DataFrame, heads: DataFrame) -> DataFrame:
    """Blocks between the observed head and the next block of each stream."""
    return (
        streams.select("job_id", "dataset_key", "rpc_pool")
        .join(jobs.select("job_id", "org_id", "chain_id"), "job_id")
        .join(cursors.select("job_id", "dataset_key", "next_block"), ["job_id", "dataset_key"])
        .join(latest_heads(heads), ["org_id", "chain_id", "rpc_pool"], "left")
        .select(
            "job_id",
            "dataset_key",
            "chain_id",
            "head_block",
            "next_block",
            F.when(
                F.col("head_block").isNotNull(), F.greatest(F.col("head_block") + 1 - F.col("next_block"), F.lit(0))
            ).alias("lag_blocks"),
        )
    )


def reorg_counts(invalidations: DataFrame) -> DataFrame:
    """Reorgs recorded per dataset."""
    return invalidations.groupBy("dataset_uuid").agg(
        F.count_if(F.col("reason") == "reorg").alias("reorgs"), F.count(F.lit(1)).alias("invalidations")
    )


def job_completion(jobs: DataFrame, streams: DataFrame, cursors: DataFrame, ranges: DataFrame) -> DataFrame:
    """fixed_target jobs are complete when every stream reached the target and none is in flight.

    Following jobs never complete; a job without streams or target is not complete.
    """
    counts = range_counts(ranges).select("job_id", "dataset_key", "inflight")
    reached = (
        (F.col("mode") == "fixed_target")
        & (F.col("next_block") >= F.col("to_block"))
        & (F.coalesce("inflight", F.lit(0)) == 0)
    )
    return (
        jobs.select("job_id", "mode", "to_block")
        .join(streams.select("job_id", "dataset_key"), "job_id", "left")
        .join(cursors.select("job_id", "dataset_key", "next_block"), ["job_id", "dataset_key"], "left")
        .join(counts, ["job_id", "dataset_key"], "left")
        .groupBy("job_id", "mode")
        .agg(
            F.count("dataset_key").alias("streams"),
            F.count_if(F.coalesce(reached, F.lit(False))).alias("streams_done"),
            F.bool_and(F.coalesce(reached, F.lit(False))).alias("complete"),
        )
    )
