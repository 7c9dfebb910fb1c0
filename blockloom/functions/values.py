"""Small value functions: back-off, clipping, severity order, provenance hashes, day buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions.ids import _col

# Message cap, severity order, delivery retry limits.
MAX_MESSAGE_BYTES = 1024
SEVERITIES = ("info", "warning", "critical")
DELIVERY_BASE_SECONDS = 5
DELIVERY_CAP_SECONDS = 1800
DELIVERY_MAX_ATTEMPTS = 12


def backoff(attempt, base_seconds: float, cap_seconds: float, jitter=None) -> Column:
    """``min(cap, base * 2^attempt)`` seconds, times a jitter factor column when given."""
    delay = F.least(F.lit(float(cap_seconds)), F.lit(float(base_seconds)) * F.pow(F.lit(2.0), _col(attempt)))
    return delay if jitter is None else delay * _col(jitter)


def clip_message(text, max_bytes: int = MAX_MESSAGE_BYTES) -> Column:
    """At most ``max_bytes`` UTF-8 bytes, never cutting inside a character."""
    value = _col(text)
    raw = F.encode(value, "UTF-8")
    # A UTF-8 character has at most four bytes, so one of four cut points is a boundary.
    cuts = [F.try_validate_utf8(F.substring(raw, 1, max_bytes - back).cast("string")) for back in range(4)]
    return F.when(F.octet_length(value) <= max_bytes, value).otherwise(F.coalesce(*cuts))


def severity_rank(severity) -> Column:
    """0 for info, 1 for warning, 2 for critical; anything else gives null."""
    rank = F.array_position(F.lit(list(SEVERITIES)), _col(severity)).cast("int")
    return F.when(rank > 0, rank - 1)


def schema_hash(df: DataFrame) -> Column:
    """SHA-256 of the column names and types in order."""
    text = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    return F.sha2(F.lit(text), 256)


def config_hash(dataset_name) -> Column:
    """Provenance tag of an ingest stream."""
    return F.concat(F.lit("cryo_ingest."), _col(dataset_name), F.lit(":v1"))


def sql_hash(sql) -> Column:
    """SHA-256 of query text; the text itself is never stored."""
    return F.sha2(_col(sql), 256)


def day_of(timestamp) -> Column:
    """Start of the day, keeping a timestamp without time zone as such."""
    return F.date_trunc("day", _col(timestamp)).cast("timestamp_ntz")
