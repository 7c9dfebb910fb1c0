"""Audit rows of queries and of reads that touch personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions.values import sql_hash
from blockloom.operators.windows import first_rows
from blockloom.plans.query import QueryResult

AUDIT_SCHEMA = (
    "org_id string, task_id string, user_sub string, dataset_id string, query_time timestamp, "
    "columns_accessed array<string>, result_row_count bigint"
)


def audit_row(
    spark: SparkSession,
    result: QueryResult,
    org_id: str,
    dataset_id: str,
    query_time,
    task_id: str | None = None,
    user_sub: str | None = None,
) -> DataFrame:
    """One row for a successful query: who, which dataset, how many rows; never the SQL."""
    if (task_id is None) == (user_sub is None):
        raise ValueError("exactly one of task_id and user_sub must be set")
    row = (org_id, task_id, user_sub, dataset_id, query_time, None, len(result.rows))
    return spark.createDataFrame([row], AUDIT_SCHEMA)


def query_audit(runs: DataFrame) -> DataFrame:
    """Audit rows of successful runs. ``runs``: org_id, task_id, user_sub, dataset_id,
    query_time, status, row_count."""
    one_principal = F.col("task_id").isNull() != F.col("user_sub").isNull()
    return runs.filter((F.col("status") == "Succeeded") & one_principal).select(
        "org_id",
        "task_id",
        "user_sub",
        "dataset_id",
        "query_time",
        F.lit(None).cast("array<string>").alias("columns_accessed"),
        F.col("row_count").alias("result_row_count"),
    )


def query_results(runs: DataFrame) -> DataFrame:
    """Ledger view: the latest row of each run, with a hash in place of its SQL."""
    latest = first_rows(runs, ["id"], [F.col("updated_at").desc(), F.col("status").desc()])
    return latest.withColumn("sql_hash", sql_hash("sql")).drop("sql")


def accessed_columns(df: DataFrame, dataset: DataFrame) -> list[str]:
    """Columns of ``dataset`` that the scans of ``df`` read after column pruning."""
    used = df._jdf.queryExecution().sparkPlan().collectLeaves()
    names: set[str] = set()
    for i in range(used.size()):
        output = used.apply(i).output()
        names.update(output.apply(j).name() for j in range(output.size()))
    return [c for c in dataset.columns if c in names]


def pii_access(reads: DataFrame, classification: DataFrame) -> DataFrame:
    """Log rows for reads of datasets with PII columns.

    ``reads``: org_id, user_id, task_id, dataset, columns (array, null when unknown),
    record_id, accessed_at. ``classification``: dataset, column_name. Known columns give
    one row per PII column read; unknown ones one row with a null column.
    """
    one_principal = F.col("user_id").isNull() != F.col("task_id").isNull()
    sensitive = classification.groupBy("dataset").agg(F.collect_set("column_name").alias("_pii"))
    named = F.array_sort(F.array_intersect("columns", "_pii"))
    touched = F.when(F.col("columns").isNull(), F.array(F.lit(None).cast("string"))).otherwise(named)
    return (
        reads.filter(one_principal)
        .join(sensitive, "dataset")
        .select(
            "org_id",
            "user_id",
            "task_id",
            "dataset",
            F.explode(touched).alias("column_name"),
            "record_id",
            F.lit("read").alias("action"),
            "accessed_at",
        )
    )


def audit_report(audit: DataFrame, dataset: str = "dataset_id", time: str = "query_time", unit: str = "day") -> DataFrame:
    """Accesses and rows read per org, dataset and time bucket."""
    bucket: Column = F.date_trunc(unit, F.col(time)).cast(audit.schema[time].dataType)
    return audit.groupBy("org_id", dataset, bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("accesses"), F.sum("result_row_count").alias("rows_read")
    )
