"""Dataset manifests as rows: parsing and catalog-wide rule checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.functions.checks import strict_json

# Manifest format and default limits.
MANIFEST_VERSION = 1
MANIFEST_NAME = "_manifest.json"
MAX_MANIFEST_OBJECTS = 1024
MAX_MANIFEST_BYTES = 1024 * 1024
MANIFEST_FIELDS = ["version", "dataset_uuid", "dataset_version", "parquet_keys"]
MANIFEST_KEYS_ALIAS = "parquet_objects"

_MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("version", T.IntegerType()),
        T.StructField("dataset_uuid", T.StringType()),
        T.StructField("dataset_version", T.StringType()),
        T.StructField("parquet_keys", T.ArrayType(T.StringType())),
        T.StructField(MANIFEST_KEYS_ALIAS, T.ArrayType(T.StringType())),
    ]
)


def parse_manifests(documents: DataFrame, body: str = "body") -> DataFrame:
    """JSON text column to manifest columns plus ``malformed``; unknown fields are malformed."""
    parsed = F.from_json(F.col(body), _MANIFEST_SCHEMA)
    names = F.json_object_keys(F.col(body))
    allowed = F.lit([*MANIFEST_FIELDS, MANIFEST_KEYS_ALIAS])
    both = F.array_contains(names, "parquet_keys") & F.array_contains(names, MANIFEST_KEYS_ALIAS)
    return (
        documents.withColumn("_doc", parsed)
        .withColumn(
            "malformed",
            F.coalesce(
                strict_json(body).isNull()
                | (F.size(F.array_except(names, allowed)) > 0)
                | both
                | F.col("_doc.version").isNull()
                | F.col("_doc.dataset_uuid").isNull()
                | F.col("_doc.dataset_version").isNull()
                | F.coalesce("_doc.parquet_keys", f"_doc.{MANIFEST_KEYS_ALIAS}").isNull(),
                F.lit(True),
            ),
        )
        .withColumns(
            {
                "version": F.col("_doc.version"),
                "dataset_uuid": F.lower("_doc.dataset_uuid"),
                "dataset_version": F.lower("_doc.dataset_version"),
                "parquet_keys": F.coalesce("_doc.parquet_keys", f"_doc.{MANIFEST_KEYS_ALIAS}"),
            }
        )
        .drop("_doc", body)
    )


def _violation(failed: Column, rule: str, key: Column) -> Column:
    return F.when(failed, F.struct(F.lit(rule).alias("rule"), key.alias("parquet_key")))


def manifest_audit(
    manifests: DataFrame, registry: DataFrame, max_objects: int = MAX_MANIFEST_OBJECTS
) -> DataFrame:
    """One row per broken rule of every manifest; key rules give one row per offending key.

    ``manifests``: storage_prefix (where it was found), version, dataset_uuid,
    dataset_version, parquet_keys and optionally malformed and oversized. ``registry``: storage_prefix,
    dataset_uuid, dataset_version. All rules run in one pass over the joined rows.
    """
    for flag in ("malformed", "oversized"):
        if flag not in manifests.columns:
            manifests = manifests.withColumn(flag, F.lit(False))
    known = registry.select(
        "storage_prefix",
        F.col("dataset_uuid").alias("_uuid"),
        F.col("dataset_version").alias("_version"),
    )
    directory = F.trim("storage_prefix", F.lit("/"))
    no_key = F.lit(None).cast("string")
    count = F.size("parquet_keys")
    registered = F.col("dataset_uuid").eqNullSafe(F.col("_uuid")) & F.col("dataset_version").eqNullSafe(
        F.col("_version")
    )
    whole = F.array(
        _violation(F.col("oversized"), "oversized", no_key),
        _violation(F.col("malformed") & ~F.col("oversized"), "malformed", no_key),
        _violation(F.col("version") != MANIFEST_VERSION, "unsupported_version", no_key),
        _violation(~registered, "registry_mismatch", no_key),
        _violation(count == 0, "no_objects", no_key),
        _violation(count > max_objects, "too_many_objects", no_key),
        _violation(directory == "", "empty_prefix", no_key),
    )

    def key_rules(key: Column) -> Column:
        relative = F.regexp_replace(key, "^/+", "")
        return F.array(
            _violation(F.contains(key, F.lit("\\")), "backslash", key),
            _violation(~relative.startswith(F.concat(directory, F.lit("/"))), "outside_prefix", key),
            _violation(~F.lower(relative).endswith(".parquet"), "not_parquet", key),
        )

    per_key = F.coalesce(F.flatten(F.transform("parquet_keys", key_rules)), F.array().cast(
        "array<struct<rule:string,parquet_key:string>>"))
    return (
        manifests.join(known, "storage_prefix", "left")
        .withColumn("_broken", F.explode(F.array_compact(F.concat(whole, per_key))))
        .select("storage_prefix", "dataset_uuid", "dataset_version", "_broken.rule", "_broken.parquet_key")
    )
