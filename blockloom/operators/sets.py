"""Key sets and range differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

STREAM_RANGE = ["job_id", "dataset_key", "range_start", "range_end"]


def distinct_keys(df: DataFrame, key: str = "path") -> DataFrame:
    """File keys, each once, in order."""
    return df.select(key).distinct().orderBy(key)


def keys_per_version(df: DataFrame, group: list[str], key: str = "path") -> DataFrame:
    """Sorted distinct file keys of each dataset version, as a manifest lists them."""
    return df.groupBy(*group).agg(F.sort_array(F.collect_set(key)).alias("parquet_keys"))


def unscheduled_ranges(expected: DataFrame, recorded: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Ranges that should exist minus the ranges on record."""
    on = keys or STREAM_RANGE
    return expected.join(recorded.select(*on), on, "left_anti")


def capped_rows(df: DataFrame, max_rows: int) -> tuple[list[Row], bool]:
    """``(first max_rows rows, truncated)``: one row more is read to tell."""
    rows = df.take(max_rows + 1)
    return rows[:max_rows], len(rows) > max_rows
