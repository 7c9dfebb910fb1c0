"""Range helpers shared by joins, planning and publishing.

A range join is written as an equi join on ``floor(block / bucket_size)`` plus the exact
bounds check, so it shuffles on a key instead of comparing every row with every range.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.session import bounded_side, materialized

LOWEST, HIGHEST = -(2**63), 2**63 - 1

# Bucket rows a set of ranges may be spread over, before per-range edges.
TARGET_BUCKETS = 50_000
_INNER_STEPS = 4096


def explode_starts(
    df: DataFrame, start: Column, end: Column, step: Column, name: str, keep_empty: bool = False
) -> DataFrame:
    """One row per ``start, start + step, ...`` below ``end``.

    Two nested sequences keep every generated array short, however long the range is. With
    ``keep_empty`` a row with an empty range stays, with null.
    """
    explode = F.explode_outer if keep_empty else F.explode
    blocks = F.when(F.col("_end") > F.col("_start"), F.sequence("_start", F.col("_end") - 1, "_wide"))
    block_end = F.least(F.col("_outer") + F.col("_wide"), F.col("_end"))
    return (
        df.withColumns({"_start": start, "_end": end, "_step": step, "_wide": step * _INNER_STEPS})
        .withColumn("_outer", explode(blocks))
        .withColumn(name, explode(F.sequence("_outer", block_end - 1, "_step")))
        .drop("_start", "_end", "_step", "_wide", "_outer")
    )


def bucket_of(value, bucket_size: int) -> Column:
    column = value if isinstance(value, Column) else F.col(value)
    return F.floor(column / F.lit(bucket_size)).cast("bigint") if bucket_size > 1 else column.cast("bigint")


def pick_bucket_size(ranges: DataFrame, first: str, last: str) -> int:
    """Width so that the ranges cover about ``TARGET_BUCKETS`` buckets in total."""
    row = ranges.agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col(last) - F.col(first) + 1).cast("decimal(38,0)")).alias("width")
    ).first()
    if not row.n:
        return 1
    return max(1, int(row.width) // max(TARGET_BUCKETS, 4 * row.n))


def spread_over_buckets(ranges: DataFrame, first: str, last: str, bucket_size: int, name: str) -> DataFrame:
    """One row per bucket each inclusive range ``[first, last]`` touches."""
    low, high = bucket_of(first, bucket_size), bucket_of(last, bucket_size)
    return explode_starts(ranges, low, high + 1, F.lit(1).cast("bigint"), name)


def assign_ranges(
    df: DataFrame, ranges: DataFrame, keys: list[str], block: str = "block_number", bucket_size: int | None = None
) -> DataFrame:
    """Rows joined to the end-exclusive ``[range_start, range_end)`` that holds their block."""
    inclusive = ranges.withColumn("_last", F.col("range_end") - 1)
    size = bucket_size or pick_bucket_size(inclusive, "range_start", "_last")
    spread = spread_over_buckets(inclusive, "range_start", "_last", size, "_bucket").drop("_last")
    inside = (F.col(block) >= F.col("range_start")) & (F.col(block) < F.col("range_end"))
    bucketed = df.withColumn("_bucket", bucket_of(block, size))
    return bucketed.join(bounded_side(spread), [*keys, "_bucket"]).filter(inside).drop("_bucket")


def merged_spans(spans: DataFrame, key: str, rows_a_part: int = 500_000) -> DataFrame:
    """``key, first, last`` with overlapping and touching inclusive spans of a key merged.

    Spans are dealt by ranges of ``key, first`` and merged inside each part; of a part only its
    size, its reach and its number of merged runs meet in a window over the key. So a key that
    has most spans is spread over as many tasks as parts. Null is a key like any other.
    """
    spans = spans.select(key, "first", "last").distinct()
    parts = -(-spans.count() // rows_a_part)
    if parts > 1:
        dealt = spans.repartitionByRange(parts, key, "first", "last").withColumn("_part", F.spark_partition_id())
        spans = materialized(dealt, "spans")
    else:
        spans = spans.withColumn("_part", F.lit(0))
    inside = Window.partitionBy(key, "_part").orderBy("first", "last")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)

    def before(rows: DataFrame, what: Column, name: str) -> DataFrame:
        """Adds ``what`` over the earlier parts of the key; one row per key and part is small."""
        edges = rows.groupBy(key, "_part").agg(what.alias("_edge"))
        over = F.max("_edge") if name == "_carried" else F.sum("_edge")
        edges = edges.select(F.col(key).alias("_key"), F.col("_part").alias("_at"), over.over(across).alias(name))
        edges = bounded_side(edges)
        same = rows[key].eqNullSafe(edges["_key"]) & (rows["_part"] == edges["_at"])
        return rows.join(edges, same).drop("_key", "_at")

    reached = spans.withColumn("_reach", F.max("last").over(earlier))
    if parts > 1:
        reached = before(reached, F.max("last"), "_carried")
        reached = reached.withColumn("_reach", F.greatest("_reach", "_carried")).drop("_carried")
    begins = F.col("_reach").isNull() | (F.col("first") - 1 > F.col("_reach"))
    runs = reached.withColumn("_begins", begins.cast("int")).withColumn("_run", F.sum("_begins").over(inside))
    if parts > 1:
        runs = before(runs, F.sum("_begins"), "_earlier")
        runs = runs.withColumn("_run", F.col("_run") + F.coalesce("_earlier", F.lit(0)))
    return runs.groupBy(key, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_run")


def few_spans(merged: DataFrame, most: int) -> DataFrame:
    """At most ``most`` spans ``chain, first, last`` that cover the merged ones.

    With more, spans that begin in the same stretch of their chain are joined, else all of a
    chain, else all.
    """
    count, low, high = merged.agg(F.count("*"), F.min("first"), F.max("last")).first()
    if count <= most:
        return merged
    width = max(1, (high - low) // most)
    bucket = F.floor((F.col("first") - F.lit(low)) / F.lit(width))
    joined = merged.groupBy("chain", bucket.alias("_bucket")).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    joined = materialized(joined.drop("_bucket"), "spans")
    if joined.count() <= most:
        return joined
    chains = joined.groupBy("chain").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    if chains.count() <= most:
        return chains
    return chains.agg(F.min("first").alias("first"), F.max("last").alias("last")).withColumn("chain", F.lit(None).cast("bigint"))


def in_spans(number: Column, chain: Column | None, spans: Sequence) -> Column:
    """Whether ``number`` lies in one of few spans ``(chain, first, last)``, as plain predicates
    that reach the scan; a null chain stands for every one, and ends may be open."""

    def within(span) -> Column:
        terms = [] if span.chain is None or chain is None else [chain == span.chain]
        terms += [] if span.first == LOWEST else [number >= span.first]
        terms += [] if span.last == HIGHEST else [number <= span.last]
        return reduce(lambda a, b: a & b, terms) if terms else number.isNotNull()

    return reduce(lambda a, b: a | b, map(within, spans)) if spans else F.lit(False)
