"""Enrichment, status, repair and routing joins."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions.ids import chain_of_key, content_key, parse_partition_key, partition_key
from blockloom.operators.aggregates import latest_heads, range_counts
from blockloom.operators.filters import edge_where, fresh_only, sample_blocks
from blockloom.operators.intervals import HIGHEST, LOWEST, bucket_of, in_spans, merged_spans, pick_bucket_size, spread_over_buckets
from blockloom.session import bounded_side, broadcast_if_bounded, is_bounded, materialized

FEW_BOUNDS = 100  # merged ranges that are written out as predicates

DELIVERY_STATUSES = ("pending", "sending", "retrying", "delivered", "failed")


def enrich_labels(df: DataFrame, labels: DataFrame, address_columns: Iterable[str] = ("address",)) -> DataFrame:
    """Left join of address labels; each address column gets a ``<column>_label``.

    An address with several labels gives one row per label, so no label list is ever
    gathered in one place. Labels are broadcast only when counted small.
    """
    known = materialized(labels.select("address", "label").distinct(), "labels")
    small = is_bounded(known)
    for column in address_columns:
        side = known.select(F.col("address").alias(column), F.col("label").alias(f"{column}_label"))
        df = df.join(F.broadcast(side) if small else side, column, "left")
    return df


def combine_offchain(df: DataFrame, feed: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """On-chain rows joined to an off-chain feed by key."""
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join: {how}")
    return df.join(feed, keys, how)


def sync_status(
    jobs: DataFrame, streams: DataFrame, cursors: DataFrame, ranges: DataFrame, heads: DataFrame, now: Column
) -> DataFrame:
    """Per stream: cursor, in-flight and completed counts, observed head, eligible end.

    Streams without a cursor are not started and give no row. A missing tail lag or head
    age counts as zero here; a stale head leaves the eligible end empty.
    """
    follows = F.col("mode") == "follow_head"
    max_age = F.greatest(F.coalesce("max_head_age_seconds", F.lit(0)), F.lit(0))
    lag = F.greatest(F.coalesce("tail_lag", F.lit(0)), F.lit(0))
    age = F.greatest(F.timestamp_diff("SECOND", F.col("observed_at"), now), F.lit(0))
    eligible = F.greatest("from_block", F.col("head_block") + 1 - lag)
    return (
        streams.join(jobs.select("job_id", "org_id", "chain_id", "mode", "from_block", "tail_lag", "max_head_age_seconds"), "job_id")
        .join(cursors.select("job_id", "dataset_key", "next_block"), ["job_id", "dataset_key"])
        .join(range_counts(ranges), ["job_id", "dataset_key"], "left")
        .join(latest_heads(heads), ["org_id", "chain_id", "rpc_pool"], "left")
        .select(
            "job_id",
            "dataset_key",
            "rpc_pool",
            "next_block",
            F.coalesce("inflight", F.lit(0)).cast("bigint").alias("inflight"),
            F.coalesce("completed", F.lit(0)).cast("bigint").alias("completed"),
            F.when(follows, F.col("head_block")).alias("observed_head"),
            F.when(follows & F.col("head_block").isNotNull() & (age <= max_age), eligible).alias("eligible_end"),
        )
    )


def alert_status(events: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Delivery counts per status of every alert event, zero when nothing was routed."""
    counts = deliveries.groupBy("alert_event_id").agg(
        F.count(F.lit(1)).alias("deliveries"),
        *[F.count_if(F.col("status") == s).alias(s) for s in DELIVERY_STATUSES],
        F.max("attempt").alias("max_attempt"),
    )
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("deliveries", *DELIVERY_STATUSES)]
    return events.join(counts, "alert_event_id", "left").select(
        *events.columns, *zero, F.coalesce("max_attempt", F.lit(0)).cast("bigint").alias("max_attempt")
    )


def missing_partitions(
    upstream: DataFrame, downstream: DataFrame, keys: tuple[str, ...] = ("dataset_version", "partition_key")
) -> DataFrame:
    """Upstream partitions without a downstream materialization."""
    return upstream.join(downstream.select(*keys), list(keys), "left_anti")


def usable_invalidations(
    invalidations: DataFrame, dataset_uuid: str | None = None, dataset_version: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(invalidations with bounds, the others)`` of a dataset, or of all.

    The first have inclusive ``first, last`` and ``chain`` added; a null bound is open and a
    null chain means every chain. A partition key may carry its chain (``1_0-999``); a row
    filter takes it from ``chain_id`` if the table has that column. The others have a scope
    or key that names no rows. A null dataset version stands for every version.
    """
    rows = invalidations
    if dataset_uuid is not None:
        rows = rows.filter(F.col("dataset_uuid") == dataset_uuid)
    if dataset_version is not None:
        rows = rows.filter(F.coalesce(F.col("dataset_version") == dataset_version, F.lit(True)))
    start, end = parse_partition_key("partition_key")
    by_key = F.col("scope") == "partition"
    own_chain = F.col("chain_id").cast("bigint") if "chain_id" in rows.columns else F.lit(None).cast("bigint")
    judged = rows.withColumns(
        {
            "first": F.when(by_key, start).otherwise(F.col("row_filter.gte")),
            "last": F.when(by_key, end - 1).otherwise(F.col("row_filter.lte")),
            "chain": F.when(by_key, F.coalesce(chain_of_key("partition_key"), own_chain)).otherwise(own_chain),
        }
    )
    bounded = F.col("scope").isin("partition", "row_range") & (F.col("first").isNotNull() | F.col("last").isNotNull())
    usable = F.coalesce(bounded, F.lit(False))
    return judged.filter(usable), judged.filter(~usable).select(*rows.columns)


def invalidation_bounds(usable: DataFrame, rows_a_part: int = 500_000) -> DataFrame:
    """``chain, first, last`` of usable invalidations, overlapping and touching ones merged."""
    spans = usable.select(
        "chain", F.coalesce("first", F.lit(LOWEST)).alias("first"), F.coalesce("last", F.lit(HIGHEST)).alias("last")
    )
    return merged_spans(spans.filter("last >= first"), "chain", rows_a_part)


def invalidated_rows(
    df: DataFrame,
    invalidations: DataFrame,
    block: str = "block_number",
    bucket_size: int | None = None,
    chain: str = "chain_id",
    dataset_uuid: str | None = None,
    dataset_version: str | None = None,
) -> DataFrame:
    """Rows hit by any of the given invalidations; each row comes once.

    Give ``dataset_uuid`` and ``dataset_version`` of ``df`` when the invalidations are of
    several datasets. Merged bounds that are few become plain range predicates, which reach
    the scan; more are joined on block buckets, below the overall range, which does too.
    Invalidations without bounds hit nothing; ``usable_invalidations`` tells them.
    """
    usable, _ = usable_invalidations(invalidations, dataset_uuid, dataset_version)
    bounds = materialized(invalidation_bounds(usable), "bounds")
    count, low, high, chained = bounds.agg(F.count("*"), F.min("first"), F.max("last"), F.count("chain")).first()
    if not count:
        return df.limit(0)
    if chained and chain not in df.columns:
        raise ValueError(f"invalidations name chains, but the rows have no column {chain}")
    number = F.col(block)
    if count <= FEW_BOUNDS:
        return df.filter(in_spans(number, F.col(chain) if chained else None, bounds.collect()))
    if low == LOWEST or high == HIGHEST:
        edge = df.agg(F.min(block).alias("low"), F.max(block).alias("high")).first()
        if edge.low is None:
            return df.limit(0)
        low, high = max(low, edge.low), min(high, edge.high)
        bounds = bounds.select("chain", F.greatest("first", F.lit(low)).alias("first"), F.least("last", F.lit(high)).alias("last"))
        bounds = bounds.filter("last >= first")
    size = bucket_size or pick_bucket_size(bounds, "first", "last")
    spread = spread_over_buckets(bounds, "first", "last", size, "_bucket")
    rows = df.filter(number.between(low, high)).withColumn("_bucket", bucket_of(block, size)).alias("r")
    hit = (F.col("r._bucket") == F.col("b._bucket")) & F.col(f"r.{block}").between(F.col("b.first"), F.col("b.last"))
    if chained:
        hit &= F.coalesce(F.col("b.chain") == F.col(f"r.{chain}"), F.col("b.chain").isNull())
    return rows.join(bounded_side(spread).alias("b"), hit, "left_semi").drop("_bucket")


def integrity_check(cold: DataFrame, canonical: DataFrame, sample_rate: float | None = None) -> DataFrame:
    """Stored block hashes against canonical ones: match, mismatch or missing on a side.

    Both sides are aggregated together by block instead of an outer join: one shuffle with
    map-side combine, so repeated copies of one block cost nothing extra. Copies that
    disagree with each other count as a mismatch.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        sampled = df if sample_rate is None else sample_blocks(df, sample_rate)
        other = "canonical" if name == "cold" else "cold"
        return sampled.select(
            "chain_id",
            "block_number",
            F.col("block_hash").alias(f"{name}_hash"),
            F.lit(None).cast("string").alias(f"{other}_hash"),
            F.lit(name).alias("_side"),
        )

    agreed = (F.col("_cold_min") == F.col("_cold_max")) & (F.col("_canonical_min") == F.col("_canonical_max"))
    return (
        side(cold, "cold")
        .unionByName(side(canonical, "canonical"))
        .groupBy("chain_id", "block_number")
        .agg(
            *[f(f"{s}_hash").alias(f"_{s}_{n}") for s in ("cold", "canonical") for n, f in (("min", F.min), ("max", F.max))],
            F.count_if(F.col("_side") == "cold").alias("_cold_rows"),
            F.count_if(F.col("_side") == "canonical").alias("_canonical_rows"),
        )
        .select(
            "chain_id",
            "block_number",
            F.col("_cold_min").alias("cold_hash"),
            F.col("_canonical_min").alias("canonical_hash"),
            F.when(F.col("_cold_rows") == 0, "missing_cold")
            .when(F.col("_canonical_rows") == 0, "missing_canonical")
            .when(F.coalesce(agreed & (F.col("_cold_min") == F.col("_canonical_min")), F.lit(False)), "match")
            .otherwise("mismatch")
            .alias("status"),
        )
    )


def recompaction_requests(
    checked: DataFrame, partition_size: int, dataset_uuid: str | None = None, dataset_version: str | None = None
) -> DataFrame:
    """Partition invalidations for every block range that holds a failed check.

    They carry all columns of an invalidation, so they can be appended to the ledger and
    reprocessed. The id follows from the dataset, the range and what failed in it, so the
    same findings give the same request and new findings a new one.
    """
    start = bucket_of("block_number", partition_size) * partition_size
    finding = F.xxhash64("block_number", "cold_hash", "canonical_hash", "status")
    key = partition_key(start, start + partition_size)
    found = checked.filter(F.col("status") != "match").groupBy("chain_id", key.alias("partition_key"))
    requests = found.agg(F.count(F.lit(1)).alias("bad_blocks"), F.bit_xor(finding).alias("_found"))
    dataset, version = F.lit(dataset_uuid).cast("string"), F.lit(dataset_version).cast("string")
    return requests.select(
        content_key(dataset.alias("d"), version.alias("v"), "chain_id", "partition_key", "bad_blocks", "_found").alias("id"),
        dataset.alias("dataset_uuid"),
        version.alias("dataset_version"),
        "chain_id",
        F.lit("partition").alias("scope"),
        "partition_key",
        F.lit(None).cast("struct<gte:bigint,lte:bigint>").alias("row_filter"),
        F.lit("correction").alias("reason"),
        F.array().cast("array<string>").alias("processed_by"),
        "bad_blocks",
    )


def orphan_refs(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose soft reference is set but has no parent."""
    known = parent.select(F.col(parent_key).alias(child_key))
    return child.filter(F.col(child_key).isNotNull()).join(known, child_key, "left_anti")


def route_alerts(
    events: DataFrame,
    definitions: DataFrame,
    now: Column,
    max_age_seconds: int,
    where: Mapping | None = None,
    allow: Iterable[str] = ("severity", "chain_id"),
) -> DataFrame:
    """Pending deliveries, one per ``(org_id, alert_event_id, channel)``.

    Events are filtered by ``where`` and freshness before the join; channels come from the
    enabled definitions of the event's org. Definitions that are counted small are
    broadcast, so an alert that fires for a third of all events stays spread out.
    """
    wanted = fresh_only(edge_where(events, where or {}, allow), now, max_age_seconds)
    channels = definitions.filter(F.coalesce("enabled", F.lit(True))).select(
        "org_id", F.col("id").alias("alert_definition_id"), F.array_distinct("channels").alias("_channels")
    )
    return (
        wanted.select("org_id", "alert_event_id", "alert_definition_id")
        .join(broadcast_if_bounded(channels), ["org_id", "alert_definition_id"])
        .select("org_id", "alert_event_id", F.explode("_channels").alias("channel"))
        .distinct()
        .select(
            content_key("org_id", "alert_event_id", "channel").alias("id"),
            "org_id",
            "alert_event_id",
            "channel",
            F.lit("pending").alias("status"),
            F.lit(0).alias("attempt"),
            now.alias("next_attempt_at"),
        )
    )


def open_invalidations(invalidations: DataFrame, edges: DataFrame) -> DataFrame:
    """``(invalidation, dependent job)`` pairs that were not processed yet.

    ``edges``: dataset_uuid, job_id. ``invalidations.processed_by`` may be null.
    """
    done = F.coalesce(F.array_contains("processed_by", F.col("job_id")), F.lit(False))
    return invalidations.join(edges.select("dataset_uuid", "job_id").distinct(), "dataset_uuid").filter(~done)


def closed_invalidations(invalidations: DataFrame, edges: DataFrame) -> DataFrame:
    """Invalidations all of whose dependent jobs have processed them."""
    pending = open_invalidations(invalidations, edges).select("id")
    return invalidations.join(pending, "id", "left_anti")
