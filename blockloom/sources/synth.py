"""Deterministic block rows for a range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.functions.ids import block_hash


def synth_blocks(ranges: DataFrame) -> DataFrame:
    """First, second and last block of each ``[range_start, range_end)``, as a set."""
    start = F.col("range_start")
    last = F.greatest(F.col("range_end") - 1, start)
    return ranges.select(
        "chain_id",
        F.explode(F.array_distinct(F.array(start, F.least(start + 1, last), last))).alias("block_number"),
    ).withColumn("block_hash", block_hash("block_number"))
