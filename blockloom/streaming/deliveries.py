"""The delivery ledger: applying send outcomes to delivery rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions.values import (
    DELIVERY_BASE_SECONDS,
    DELIVERY_CAP_SECONDS,
    DELIVERY_MAX_ATTEMPTS,
    backoff,
    clip_message,
)


def delivery_outcomes(
    deliveries: DataFrame, outcomes: DataFrame, jitter: Column | None = None, max_attempts: int = DELIVERY_MAX_ATTEMPTS
) -> DataFrame:
    """Deliveries after the outcomes; one row per delivery, whatever the order or repeats.

    ``outcomes``: delivery_id, attempt (1-based), delivered, provider_message_id,
    error_message, attempted_at. Only attempts beyond the recorded one count, so applying
    the same outcomes again changes nothing; delivered and failed rows are final. The delay
    before the next try is ``min(cap, base * 2^(attempt - 1))``, the first retry after base.
    """
    open_rows = deliveries.filter(~F.col("status").isin("delivered", "failed")).select(
        F.col("id").alias("delivery_id"), F.col("attempt").alias("_recorded")
    )
    detail = F.struct("delivered", "attempt", "attempted_at", "provider_message_id", "error_message")
    latest = (
        outcomes.join(open_rows, "delivery_id")
        .filter(F.col("attempt") > F.col("_recorded"))
        .groupBy("delivery_id")
        # A delivered outcome sorts above any failure; then the latest attempt.
        .agg(F.max(detail).alias("_last"), F.max("attempt").alias("_attempt"))
        .withColumnRenamed("delivery_id", "id")
    )
    updated, ok = F.col("_attempt").isNotNull(), F.col("_last.delivered")
    status = (
        F.when(~updated, F.col("status"))
        .when(ok, "delivered")
        .when(F.col("_attempt") >= max_attempts, "failed")
        .otherwise("retrying")
    )
    delay = backoff(F.col("_attempt") - 1, DELIVERY_BASE_SECONDS, DELIVERY_CAP_SECONDS, jitter)
    next_at = F.col("_last.attempted_at") + F.make_dt_interval(secs=delay.cast("decimal(18,6)"))
    joined = deliveries.join(latest, "id", "left").withColumn("_status", status)
    retrying = updated & (F.col("_status") == "retrying")
    changes = {
        "status": F.col("_status"),
        "attempt": F.coalesce("_attempt", "attempt"),
        "next_attempt_at": F.when(retrying, next_at).otherwise(F.col("next_attempt_at")),
        "last_attempt_at": F.when(updated, F.col("_last.attempted_at")).otherwise(F.col("last_attempt_at")),
        "error_message": F.when(updated, F.when(~ok, clip_message("_last.error_message"))).otherwise(F.col("error_message")),
        "provider_message_id": F.when(updated, F.col("_last.provider_message_id")).otherwise(F.col("provider_message_id")),
        "delivered_at": F.when(updated & ok, F.col("_last.attempted_at")).otherwise(F.col("delivered_at")),
    }
    return joined.select(*[changes.get(c, F.col(c)).cast(deliveries.schema[c].dataType).alias(c) for c in deliveries.columns])
