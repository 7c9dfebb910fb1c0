"""Alert evaluation, routing and de-duplication over streams of updates."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from blockloom.operators.filters import fresh_only
from blockloom.operators.joins import route_alerts
from blockloom.plans.rules import evaluate_rule, strict_events
from blockloom.sinks.append import append_dedupe
from blockloom.streaming.jobs import start_batches

DELIVERY_KEY = ["org_id", "alert_event_id", "channel"]


def alert_evaluate(
    df: DataFrame,
    rule: str | Callable[[DataFrame], DataFrame],
    definition_id: str,
    dataset_uuid: str,
    dataset_version: str,
    now: Column,
    target_path: str,
    batch_id: str,
    time_column: str | None = None,
    max_lookback_seconds: int | None = None,
    hash_in_key: bool = True,
) -> None:
    """Run a SQL or Python rule over pinned rows and append its events; a replay adds nothing.

    With ``max_lookback_seconds`` rows older than that at ``now`` are not evaluated. One
    invalid event fails the batch before anything is written.
    """
    if max_lookback_seconds is not None:
        df = fresh_only(df, now, max_lookback_seconds, time_column or "block_time")
    events = strict_events(evaluate_rule(df, rule, definition_id, dataset_uuid, dataset_version, now, hash_in_key))
    append_dedupe(target_path, events, ["dedupe_key"], ["event_time", "chain_id", "block_hash"], batch_id)


def alert_evaluate_stream(
    stream: DataFrame, stream_name: str, checkpoint: str, interval: str | None = None, **rule
) -> StreamingQuery:
    """``alert_evaluate`` per micro-batch; ``rule`` holds its other arguments."""
    return start_batches(
        stream, lambda df, n: alert_evaluate(df, batch_id=f"{stream_name}-{n}", **rule), checkpoint, interval
    )


def alert_route_stream(
    events: DataFrame,
    stream_name: str,
    definitions: Callable[[], DataFrame],
    deliveries_path: str,
    checkpoint: str,
    now: Column,
    max_age_seconds: int,
    where: Mapping | None = None,
    allow: Iterable[str] = ("severity", "chain_id"),
    interval: str | None = None,
) -> StreamingQuery:
    """Pending deliveries per micro-batch; ``definitions`` is read anew for each batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = route_alerts(batch, definitions(), now, max_age_seconds, where, allow)
        append_dedupe(deliveries_path, rows, DELIVERY_KEY, ["id"], f"{stream_name}-{batch_id}")

    return start_batches(events, handle, checkpoint, interval)


def dedupe_stream(
    stream: DataFrame,
    stream_name: str,
    keys: list[str],
    order_by: list,
    target_path: str,
    checkpoint: str,
    interval: str | None = None,
) -> StreamingQuery:
    """At-least-once events to a table with one row per key.

    The append alone decides, over the whole table: a key that is first seen late is kept
    like any other, and of the rows of a batch the first by ``order_by`` is. No state is
    held, so nothing depends on how late an event may be.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        append_dedupe(target_path, batch, keys, order_by, f"{stream_name}-{batch_id}")

    return start_batches(stream, handle, checkpoint, interval)
