"""Strict JSON Lines alert batches: one bad line rejects its whole file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions.checks import canonical_uuid, parse_rfc3339, strict_json
from blockloom.session import broadcast_if_bounded, materialized

# Fields of an alert event line and their JSON types.
ALERT_FIELDS = {
    "alert_definition_id": "STRING",
    "dedupe_key": "STRING",
    "event_time": "STRING",
    "chain_id": "BIGINT",
    "block_number": "BIGINT",
    "block_hash": "STRING",
    "tx_hash": "STRING",
    "payload": "OBJECT",
}


def _field(document: Column, name: str) -> Column:
    return F.variant_get(document, f"$.{name}", "variant")


def _text(document: Column, name: str, sql_type: str = "string") -> Column:
    return F.try_variant_get(document, f"$.{name}", sql_type)


def alert_line_error(line: str = "line", document: str = "document") -> Column:
    """Reason a line is not a valid alert event, or null; ``document`` is its strict JSON."""
    doc = F.col(document)
    names = F.map_keys(F.try_variant_get(doc, "$", "map<string,variant>"))
    allowed = F.lit(list(ALERT_FIELDS))
    wrong = F.lit(False)
    for name, kind in ALERT_FIELDS.items():
        if name != "payload":
            wrong = wrong | ~F.schema_of_variant(_field(doc, name)).eqNullSafe(F.lit(kind))
    payload_shape = F.schema_of_variant(_field(doc, "payload"))
    return (
        F.when(~F.is_valid_utf8(F.col(line)), "not utf-8")
        .when(doc.isNull(), "not json")
        .when(~F.schema_of_variant(doc).startswith("OBJECT"), "not an object")
        .when(F.size(F.array_except(names, allowed)) > 0, "unknown field")
        .when(F.size(F.array_except(allowed, names)) > 0, "missing field")
        .when(wrong, "wrong type")
        .when(canonical_uuid(_text(doc, "alert_definition_id")).isNull(), "bad alert_definition_id")
        .when(parse_rfc3339(_text(doc, "event_time")).isNull(), "bad event_time")
        .when(~F.coalesce(payload_shape.startswith("OBJECT"), F.lit(False)), "payload must be an object")
    )


def alert_columns(document: str = "document") -> list[Column]:
    """Typed alert event columns of a valid line."""
    doc = F.col(document)
    return [
        canonical_uuid(_text(doc, "alert_definition_id")).alias("alert_definition_id"),
        _text(doc, "dedupe_key").alias("dedupe_key"),
        parse_rfc3339(_text(doc, "event_time")).alias("event_time"),
        _text(doc, "chain_id", "bigint").alias("chain_id"),
        _text(doc, "block_number", "bigint").alias("block_number"),
        _text(doc, "block_hash").alias("block_hash"),
        _text(doc, "tx_hash").alias("tx_hash"),
        F.to_json(_field(doc, "payload")).alias("payload"),
    ]


def split_batches(lines: DataFrame, file: str = "file") -> tuple[DataFrame, DataFrame]:
    """``(file, line)`` rows to accepted events and one dead-letter row per rejected file.

    Every line is parsed once, into its error or its typed columns, which are written to the
    shared folder. The verdict per file is a map-side-combined count over these; accepted
    lines are kept by an anti join against the rejected files, broadcast when counted small,
    so the lines themselves are not shuffled and a file of any size stays spread out.
    """
    parsed = lines.filter(~F.col("line").rlike(r"^\s*$")).withColumn("document", strict_json("line"))
    judged = parsed.withColumn("error", alert_line_error())
    typed = [F.when(F.col("error").isNull(), c).alias(name) for name, c in zip(ALERT_FIELDS, alert_columns())]
    judged = materialized(judged.select(file, "error", *typed), "judged")
    verdict = judged.groupBy(file).agg(F.count("error").alias("bad_lines"), F.min("error").alias("error"))
    rejected = materialized(verdict.filter("bad_lines > 0"), "rejected")
    good = judged.join(broadcast_if_bounded(rejected.select(file)), file, "left_anti").select(file, *ALERT_FIELDS)
    return good, rejected


def read_jsonl_batches(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Accepted alert events and dead letters of every batch file below ``path``."""
    lines = (
        spark.read.option("recursiveFileLookup", "true")
        .option("lineSep", "\n")
        .text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    )
    return split_batches(lines)
