"""User rules: SQL or Python over a pinned dataset, and validation of what they emit."""

from __future__ import annotations

import itertools

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions.checks import canonical_uuid, is_json_object
from blockloom.functions.ids import alert_key
from blockloom.plans.query import gated_sql

EVENT_COLUMNS = [
    "alert_definition_id",
    "dedupe_key",
    "event_time",
    "chain_id",
    "block_number",
    "block_hash",
    "tx_hash",
    "payload",
]
OUT_ROWS = 10_000  # of a rule's frames that go out together, as many as Arrow batches have


class InvalidRuleOutput(ValueError):
    """A rule emitted rows that do not fit the alert event format."""


def rule_events(
    hits: DataFrame,
    definition_id: str,
    dataset_uuid: str,
    dataset_version: str,
    event_time: Column,
    hash_in_key: bool = True,
) -> DataFrame:
    """``(chain_id, block_number, block_hash)`` rows to alert events.

    The key depends only on the rule, the dataset version and the block, and on the
    transaction where the rule names one, never on the attempt. With ``hash_in_key`` a
    reorged block raises a new event. A rule's own ``tx_hash`` and ``payload`` (JSON object
    text) are kept; without them the transaction is empty and the payload says where the
    block is from. A ``severity`` of the rule is added to its payload's fields.
    """
    payload = F.to_json(
        F.struct(
            F.lit(dataset_uuid).alias("dataset_uuid"), F.lit(dataset_version).alias("dataset_version"), "block_hash"
        )
    )
    definition, version = F.lit(definition_id), F.lit(dataset_version)
    key = alert_key(definition, version, "block_number", "block_hash" if hash_in_key else None)
    if "payload" in hits.columns:
        payload = F.coalesce(F.col("payload").cast("string"), payload)
    if "severity" in hits.columns:
        merged = _merged_object(F.to_json(F.struct("severity")), payload)
        payload = F.when(F.col("severity").isNull(), payload).otherwise(merged)
    tx_hash = F.lit("")
    if "tx_hash" in hits.columns:
        tx_hash = F.coalesce("tx_hash", tx_hash)
        key = F.when(tx_hash == "", key).otherwise(F.concat_ws(":", key, tx_hash))
    return hits.select(
        definition.alias("alert_definition_id"),
        key.alias("dedupe_key"),
        event_time.alias("event_time"),
        F.col("chain_id").cast("bigint").alias("chain_id"),
        F.col("block_number").cast("bigint").alias("block_number"),
        "block_hash",
        tx_hash.alias("tx_hash"),
        payload.alias("payload"),
    )


def _merged_object(first: Column, second: Column) -> Column:
    """Two JSON objects as one; an empty second leaves the first."""
    rest = F.regexp_extract(second, r"(?s)^\s*\{(.*)\}\s*$", 1)
    both = F.concat(first.substr(F.lit(1), F.length(first) - 1), F.lit(","), rest, F.lit("}"))
    return F.when(F.trim(rest) == "", first).otherwise(both)


def evaluate_rule(
    df: DataFrame,
    rule: str | Callable[[DataFrame], DataFrame],
    definition_id: str,
    dataset_uuid: str,
    dataset_version: str,
    now: Column,
    hash_in_key: bool = True,
) -> DataFrame:
    """Events of a rule: read-only SQL over ``dataset``, or a function that returns its hits.

    An ``event_time`` column in the hits is the domain time; otherwise it is ``now``.
    """
    hits = gated_sql(df, rule) if isinstance(rule, str) else rule(df)
    missing = {"chain_id", "block_number", "block_hash"} - set(hits.columns)
    if missing:
        raise InvalidRuleOutput(f"rule result lacks {sorted(missing)}")
    time = F.col("event_time") if "event_time" in hits.columns else now
    return rule_events(hits, definition_id, dataset_uuid, dataset_version, time, hash_in_key)


def sql_rule(df: DataFrame, sql: str, *args, **options) -> DataFrame:
    """Events of a SQL rule; see ``evaluate_rule``."""
    return evaluate_rule(df, sql, *args, **options)


def python_rule(df: DataFrame, function: Callable[[Iterable], Iterable], schema: str) -> DataFrame:
    """Row rule in Python: ``function`` maps an iterator of pandas batches of a partition.

    Batches stream through Arrow, so a partition is never held as a whole.
    """
    return df.mapInPandas(function, schema)


def python_group_rule(df: DataFrame, keys: list[str], function: Callable, schema: str) -> DataFrame:
    """Per-key rule in Python: ``function(key, frames)`` yields pandas frames.

    ``frames`` iterates over pieces of the key's rows, so a key may have any number of them:
    the rows are dealt and sorted by key and stream through a task, which holds one batch.
    A function that does not need all pieces may stop early. The order inside a key is open;
    ``sorted_group_rule`` fixes it.
    """
    return sorted_group_rule(df, keys, [], function, schema)


def sorted_group_rule(
    df: DataFrame, keys: list[str], order_within: list, function: Callable, schema: str
) -> DataFrame:
    """``python_group_rule`` with the rows of a key in the order of ``order_within``."""

    def run(batches: Iterable) -> Iterable:
        read = 0

        def pieces():
            nonlocal read
            for read, batch in enumerate(batches, 1):
                # The batch is sorted by the keys; a piece begins where they change.
                marks = batch[keys].ne(batch[keys].shift()) & ~(batch[keys].isna() & batch[keys].shift().isna())
                starts = [0, *(marks.any(axis=1).to_numpy()[1:].nonzero()[0] + 1).tolist()] if len(batch) else []
                firsts = batch[keys].iloc[starts]
                found = zip(*[[None if gone else value for value, gone in zip(firsts[k], firsts[k].isna())] for k in keys])
                for start, end, key in zip(starts, [*starts[1:], len(batch)], found):
                    yield key, batch.iloc[start:end].reset_index(drop=True)

        def frames():
            for key, found in itertools.groupby(pieces(), key=lambda pair: pair[0]):
                yield from function(key, (piece for _, piece in found))

        # Frames made of one batch go out as one: each that is sent costs far more than its rows.
        # They may be views of the batch, so none is held while later ones are read.
        held, rows, form = [], 0, None
        for frame in frames():
            own = read, frame.columns.tolist(), frame.dtypes.tolist()
            if held and (own != form or rows >= OUT_ROWS or len(held) >= OUT_ROWS):
                yield _joined(held)
                held, rows = [], 0
            held.append(frame)
            rows, form = rows + len(frame), own
        if held:
            yield _joined(held)

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order_within)
    return dealt.mapInPandas(run, schema)


def _joined(frames: list):
    import pandas as pd

    return frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)


def event_error() -> Column:
    """Reason a typed event row is invalid, or null."""
    out = F.when(canonical_uuid("alert_definition_id").isNull(), "bad alert_definition_id")
    for name in EVENT_COLUMNS:
        out = out.when(F.col(name).isNull(), f"missing {name}")
    return out.when(~is_json_object("payload"), "payload must be an object")


def validate_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid rows, rejects with error)``; columns must be exactly the event columns."""
    unknown = set(events.columns) ^ set(EVENT_COLUMNS)
    if unknown:
        raise InvalidRuleOutput(f"unknown or missing columns: {sorted(unknown)}")
    judged = events.withColumn("error", event_error())
    return judged.filter("error IS NULL").drop("error"), judged.filter("error IS NOT NULL")


def strict_events(events: DataFrame) -> DataFrame:
    """Events whose job fails on the first invalid row, so no part of a bad batch is written."""
    validate_events(events)
    message = F.concat(F.lit("invalid rule output: "), event_error())
    return events.withColumn(
        "dedupe_key", F.when(event_error().isNull(), F.col("dedupe_key")).otherwise(F.raise_error(message))
    )
