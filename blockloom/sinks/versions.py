"""Version registry, pointer sets, cutover and rollback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION_FIELDS = ["dataset_uuid", "storage_prefix", "storage_glob", "config_hash", "range_start", "range_end"]


def register_versions(registry: DataFrame, publications: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(new registry rows, conflicts)``.

    The same publication may come any number of times. One version with different metadata,
    on record or within the batch, is a conflict and is never written.
    """
    batch = publications.select("dataset_version", *VERSION_FIELDS).distinct()
    variants = batch.groupBy("dataset_version").agg(F.count(F.lit(1)).alias("_variants"))
    known = registry.select("dataset_version", F.struct(*VERSION_FIELDS).alias("_known"))
    differs = F.lit(False)
    for field in VERSION_FIELDS:
        differs = differs | ~F.col(field).eqNullSafe(F.col(f"_known.{field}"))
    judged = batch.join(variants, "dataset_version").join(known, "dataset_version", "left")
    recorded = F.col("_known").isNotNull()
    new = judged.filter(~recorded & (F.col("_variants") == 1)).select("dataset_version", *VERSION_FIELDS)
    conflicts = judged.filter((F.col("_variants") > 1) | (recorded & differs)).select(
        "dataset_version",
        *VERSION_FIELDS,
        F.when(recorded & differs, "differs from registry").otherwise("differs within batch").alias("reason"),
    )
    return new, conflicts


def current_pointers(history: DataFrame) -> DataFrame:
    """Newest complete pointer set of each DAG. ``history``: seq, dag_name, dag_version,
    dataset_uuid, dataset_version."""
    newest = history.groupBy("dag_name").agg(F.max("seq").alias("seq"))
    return history.join(newest, ["dag_name", "seq"])


def cutover(history: DataFrame, staged: DataFrame) -> DataFrame:
    """Next complete pointer set of every staged DAG, as rows to append in one write.

    A staged dataset replaces its pointer, other datasets keep theirs, and all rows carry
    the new ``dag_version``; ``seq`` goes up by one, so the old set stays for rollback.
    """
    key = ["dag_name", "dataset_uuid"]
    plan = staged.select("dag_name", "dag_version").distinct()
    current = current_pointers(history)
    last = current.select("dag_name", F.col("seq").alias("_last")).distinct()
    kept = (
        current.join(staged.select(*key), key, "left_anti")
        .drop("dag_version", "seq")
        .join(plan, "dag_name")
        .select("dag_name", "dag_version", "dataset_uuid", "dataset_version")
    )
    return (
        staged.select("dag_name", "dag_version", "dataset_uuid", "dataset_version")
        .unionByName(kept)
        .join(last, "dag_name", "left")
        .select(
            (F.coalesce("_last", F.lit(0)) + 1).cast("bigint").alias("seq"),
            "dag_name",
            "dag_version",
            "dataset_uuid",
            "dataset_version",
        )
    )


def rollback(history: DataFrame, dag_name: str) -> DataFrame:
    """The set before the current one as a new set on top; nothing when there is none.

    Both numbers come from partial maxima, so the history of a DAG is never gathered.
    """
    mine = history.filter(F.col("dag_name") == dag_name)
    top = mine.agg(F.max("seq")).first()[0]
    before = None if top is None else mine.filter(F.col("seq") < top).agg(F.max("seq")).first()[0]
    chosen = mine.limit(0) if before is None else mine.filter(F.col("seq") == before)
    return chosen.select(
        F.lit(0 if top is None else top + 1).cast("bigint").alias("seq"), "dag_name", "dag_version", "dataset_uuid", "dataset_version"
    )
