"""Deterministic identifiers: v5 UUIDs, block hashes, de-duplication and partition keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespaces and name formats of the derived ids.
TASK_NAMESPACE = "906c0c0c-342d-472f-97a1-2c9b3d4eaab1"
DATASET_NAMESPACE = "1f55c495-7e91-4433-8b4a-0c088c5a5c7f"
VERSION_NAMESPACE = "6e484f2c-567a-44f3-8a5e-c0650b2a169f"
TASK_NAME_PREFIX = "chain_sync"
DATASET_NAME_PREFIX = "chain_sync"
VERSION_NAME_PREFIX = "cryo_ingest"
ALERT_KEY_PREFIX = "alert_eval"


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def uuid5(namespace: str, name) -> Column:
    """RFC 4122 version 5 UUID of a text column, as lower-case text with hyphens."""
    raw = F.unhex(F.lit(uuid.UUID(namespace).hex))
    digest = F.sha1(F.concat(raw, F.encode(_col(name), "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 8))
    # concat, unlike concat_ws, gives null for a null name.
    return F.concat(
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-5"),
        F.substring(digest, 14, 3),
        F.lit("-"),
        variant,
        F.substring(digest, 18, 3),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )


def _colon_name(prefix: str, *parts) -> Column:
    # concat, not concat_ws: a null part must give a null name, never a shorter one.
    out = F.lit(prefix)
    for part in parts:
        out = F.concat(out, F.lit(":"), _col(part).cast("string"))
    return out


def task_id(job_id, dataset_key, range_start, range_end) -> Column:
    return uuid5(TASK_NAMESPACE, _colon_name(TASK_NAME_PREFIX, job_id, dataset_key, range_start, range_end))


def dataset_uuid(org_id, chain_id, dataset_key) -> Column:
    return uuid5(DATASET_NAMESPACE, _colon_name(DATASET_NAME_PREFIX, org_id, chain_id, dataset_key))


def dataset_version(dataset, config_hash, chain_id, range_start, range_end) -> Column:
    name = _colon_name(VERSION_NAME_PREFIX, dataset, config_hash, chain_id, range_start, range_end)
    return uuid5(VERSION_NAMESPACE, name)


def _hex16(number) -> Column:
    return F.lpad(F.lower(F.hex(_col(number).cast("bigint"))), 16, "0")


def block_hash(number) -> Column:
    """``0x`` and the block number as 16 hex digits."""
    return F.concat(F.lit("0x"), _hex16(number))


def tx_hash(number) -> Column:
    """Placeholder transaction hash of a block-level alert."""
    return F.concat(F.lit("0xtx"), _hex16(number))


def hex_to_bigint(text) -> Column:
    """Hex text, optional ``0x``, to bigint; malformed or out of range gives null."""
    digits = F.regexp_extract(_col(text), r"^\s*(?:0x)?\+?([0-9a-fA-F]+)\s*$", 1)
    significant = F.regexp_replace(digits, "^0+", "")
    value = (
        F.when(digits == "", F.lit(None))
        .when(significant == "", F.lit("0"))
        .when(F.length(significant) <= 16, F.conv(significant, 16, 10))
    )
    return value.try_cast("bigint")


def dedupe_key(*columns) -> Column:
    """Stable key: the canonical text of each part, joined by ``:``."""
    return F.concat_ws(":", *[_col(c).cast("string") for c in columns])


def content_key(*columns) -> Column:
    """SHA-256 of the canonical JSON content, for rows without a natural identity."""
    return F.sha2(F.to_json(F.struct(*[_col(c) for c in columns])), 256)


def alert_key(definition, version, block_number, hash_column=None) -> Column:
    """Alert event key. With ``hash_column`` a reorged block makes a new event."""
    parts = [definition, version, block_number] + ([] if hash_column is None else [hash_column])
    return _colon_name(ALERT_KEY_PREFIX, *parts)


def partition_key(range_start, range_end) -> Column:
    """End-exclusive ``[start, end)`` to the inclusive text key ``start-last``."""
    return F.concat(_col(range_start).cast("string"), F.lit("-"), (_col(range_end) - 1).cast("string"))


KEY_PATTERN = r"^(?:(\d+)_)?(\d+)-(\d+)$"


def parse_partition_key(key) -> tuple[Column, Column]:
    """Inclusive ``start-last`` text, with or without a chain in front, to end-exclusive
    ``(start, end)``; malformed gives null."""
    first = F.regexp_extract(_col(key), KEY_PATTERN, 2).try_cast("bigint")
    last = F.regexp_extract(_col(key), KEY_PATTERN, 3).try_cast("bigint")
    return first, last + 1


def chain_of_key(key) -> Column:
    """Chain of a ``chain_start-last`` key; null for other keys."""
    return F.regexp_extract(_col(key), KEY_PATTERN, 1).try_cast("bigint")
