"""One virtual table over hot rows and cold files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_cold_union(hot: DataFrame, cold: DataFrame, keys: list[str], range_column: str | None = None) -> DataFrame:
    """Cold rows whose key is absent from hot, then all hot rows.

    With ``range_column`` (one of ``keys``) only cold rows inside the hot key range enter
    the anti join; the rest streams through with a filter pushed to the files, so cold data
    is not shuffled for keys that cannot overlap.
    """
    hot_keys = hot.select(*keys)
    if range_column is None:
        kept = cold.join(hot_keys, keys, "left_anti")
        return kept.unionByName(hot, allowMissingColumns=True)
    bounds = hot.agg(F.min(range_column).alias("low"), F.max(range_column).alias("high")).first()
    if bounds.low is None:
        return cold.unionByName(hot, allowMissingColumns=True)
    column = F.col(range_column)
    inside = column.between(bounds.low, bounds.high)
    overlapping = cold.filter(inside).join(hot_keys, keys, "left_anti")
    apart = cold.filter((column < bounds.low) | (column > bounds.high) | column.isNull())
    return apart.unionByName(overlapping).unionByName(hot, allowMissingColumns=True)
