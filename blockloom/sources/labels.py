"""User-supplied address labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABEL_SCHEMA = "id string, org_id string, user_id string, address string, label string, visibility string"
LABEL_KEYS = ["org_id", "user_id", "address", "label"]


def unique_labels(rows: DataFrame) -> DataFrame:
    """One row per ``(org, user, address, label)``; the smallest id wins."""
    first = F.min(F.struct("id", F.coalesce("visibility", F.lit("private")).alias("visibility")))
    return (
        rows.filter(F.col("address").isNotNull() & F.col("label").isNotNull())
        .groupBy(*LABEL_KEYS)
        .agg(first.alias("_first"))
        .select("_first.id", *LABEL_KEYS, "_first.visibility")
    )


def load_labels(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Labels from CSV (with header) or JSON files with a fixed schema."""
    if fmt not in ("csv", "json"):
        raise ValueError(f"unsupported label format: {fmt}")
    reader = spark.read.schema(LABEL_SCHEMA)
    rows = reader.csv(path, header=True) if fmt == "csv" else reader.json(path)
    return unique_labels(rows)
