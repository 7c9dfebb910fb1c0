"""Validation predicates as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from blockloom.functions.ids import _col

# Accepted text forms.
DATASET_NAME_PATTERN = r"^[a-z][a-z0-9_]{0,127}$"
SLUG_PATTERN = r"^[a-z0-9_]{1,64}$"
RFC3339_PATTERN = (
    r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
)
UUID_PATTERN = r"^(?:urn:uuid:|\{)?[0-9a-fA-F]{8}(-?)[0-9a-fA-F]{4}\1[0-9a-fA-F]{4}\1[0-9a-fA-F]{4}\1[0-9a-fA-F]{12}\}?$"


def strict_json(text) -> Column:
    """Text as a variant, null unless it is exactly one JSON value.

    Spark's parser stops after the first value and ignores what follows. Text followed by
    anything but blanks cannot be read both as an object member and as an array element.
    """
    body = _col(text)
    member = F.try_parse_json(F.concat(F.lit('{"v":'), body, F.lit("}")))
    element = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    return F.when(element.isNotNull(), F.try_variant_get(member, "$.v", "variant"))


def is_json_object(text) -> Column:
    """True only for valid JSON whose top level is an object; null text gives false."""
    shape = F.schema_of_variant(strict_json(text))
    return F.coalesce(shape.startswith("OBJECT"), F.lit(False))


def parse_rfc3339(text) -> Column:
    """Strict RFC 3339 to timestamp; no offset, no time or a bad date gives null."""
    value = F.trim(_col(text))
    iso = F.concat(F.substring(value, 1, 10), F.lit("T"), F.upper(value.substr(F.lit(12), F.length(value))))
    return F.when(value.rlike(RFC3339_PATTERN), iso.try_cast("timestamp"))


def is_dataset_name(text) -> Column:
    return _col(text).rlike(DATASET_NAME_PATTERN)


def is_slug(text) -> Column:
    return _col(text).rlike(SLUG_PATTERN)


def is_uuid(text) -> Column:
    return _col(text).rlike(UUID_PATTERN)


def canonical_uuid(text) -> Column:
    """Any accepted UUID form as 36 lower-case characters; anything else gives null."""
    value = F.lower(_col(text))
    digits = F.regexp_replace(F.regexp_replace(value, r"^urn:uuid:", ""), r"[-{}]", "")
    parts = [F.substring(digits, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(is_uuid(text), F.concat_ws("-", *parts))


def under_prefix(uri, prefix) -> Column:
    """Same bucket, and the key lies below the prefix read as a directory."""

    def bucket_and_key(value: Column) -> tuple[Column, Column]:
        pattern = r"^s3://([^/]*)/(.*)$"
        key = F.regexp_replace(F.regexp_extract(value, pattern, 2), "^/+", "")
        return F.when(value.rlike(pattern), F.regexp_extract(value, pattern, 1)), key

    uri_bucket, uri_key = bucket_and_key(_col(uri))
    granted_bucket, granted_key = bucket_and_key(prefix if isinstance(prefix, Column) else F.lit(prefix))
    directory = F.when((granted_key == "") | granted_key.endswith("/"), granted_key).otherwise(
        F.concat(granted_key, F.lit("/"))
    )
    return F.coalesce((uri_bucket == granted_bucket) & uri_key.startswith(directory), F.lit(False))


def is_distinct(left, right) -> Column:
    """Null-safe inequality."""
    return ~_col(left).eqNullSafe(_col(right))
