"""Streams must equal the batch result, whatever the split into batches, and survive replays."""

import datetime

import pytest
from pyspark.sql import functions as F

from blockloom.functions.values import DELIVERY_MAX_ATTEMPTS
from blockloom.sinks.append import read_appended
from blockloom.sinks.scopes import commit_log, read_committed
from blockloom.streaming.alerts import alert_evaluate, dedupe_stream
from blockloom.streaming.deliveries import delivery_outcomes
from blockloom.streaming.follow import apply_blocks, follow_blocks

SEEN = "chain_id bigint, block_number bigint, block_hash string, seen_at int"
UUID = "906c0c0c-342d-472f-97a1-2c9b3d4eaab1"


def observed(spark, numbers, branch, seen_at, chain=1):
    return spark.createDataFrame([(chain, n, f"{branch}{n}", seen_at) for n in numbers], SEEN)


def table(spark, folder):
    return {(r.chain_id, r.block_number): r.block_hash for r in read_committed(spark, f"{folder}/hot").collect()}


def apply(spark, folder, batch, commit_id, **options):
    apply_blocks(batch, commit_id, f"{folder}/hot", f"{folder}/inv", f"{folder}/events", "ds", "v1", scope_size=10, **options)


def test_reorg_rewrites_and_replays_change_nothing(spark, folder):
    apply(spark, folder, observed(spark, range(25), "a", 1), "s-0")
    apply(spark, folder, observed(spark, range(5), "x", 1, chain=2), "s-1")
    apply(spark, folder, observed(spark, range(8, 21), "b", 2), "s-2")
    expected = {(1, n): f"a{n}" for n in range(8)} | {(1, n): f"b{n}" for n in range(8, 21)} | {(2, n): f"x{n}" for n in range(5)}
    assert table(spark, folder) == expected
    commits = commit_log(spark, f"{folder}/hot").count()
    for _ in range(2):
        apply(spark, folder, observed(spark, range(8, 21), "b", 2), "s-2")
    assert table(spark, folder) == expected and commit_log(spark, f"{folder}/hot").count() == commits
    invalidations = [(r.row_filter.gte, r.row_filter.lte, r.reason) for r in read_appended(spark, f"{folder}/inv").collect()]
    assert invalidations == [(8, 24, "reorg")]
    events = sorted((r.chain_id, r.cursor) for r in read_appended(spark, f"{folder}/events").collect())
    assert events == [(1, 20), (1, 24), (2, 4)]


def test_crash_between_commit_and_invalidation(spark, folder, monkeypatch):
    import blockloom.streaming.follow as module

    apply(spark, folder, observed(spark, range(20), "a", 1), "s-0")
    with monkeypatch.context() as patch:
        patch.setattr(module, "append_dedupe", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError):
            apply(spark, folder, observed(spark, range(15, 18), "b", 2), "s-1")
    apply(spark, folder, observed(spark, range(15, 18), "b", 2), "s-1")
    assert [tuple(r.row_filter) for r in read_appended(spark, f"{folder}/inv").collect()] == [(15, 19)]
    assert table(spark, folder) == {(1, n): f"a{n}" for n in range(15)} | {(1, n): f"b{n}" for n in range(15, 18)}


def test_latest_observation_wins_within_a_batch(spark, folder):
    apply(spark, folder, observed(spark, [1], "old", 1).unionByName(observed(spark, [1], "new", 2)), "s-0")
    assert table(spark, folder) == {(1, 1): "new1"}


def test_threshold_events(spark, folder):
    for n, block in enumerate((3, 7, 12, 19, 20)):
        apply(spark, folder, observed(spark, [block], "a", n), f"s-{n}", threshold_blocks=10)
    assert sorted(r.cursor for r in read_appended(spark, f"{folder}/events").collect()) == [9, 19]


@pytest.mark.parametrize("files", [1, 4])
def test_stream_equals_batch(spark, folder, files):
    rows = observed(spark, range(40), "a", 1)
    for part in range(files):
        rows.filter(F.col("block_number") % files == part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = follow_blocks(
        stream, "s", f"{folder}/hot", f"{folder}/inv", f"{folder}/events", f"{folder}/offsets", "ds", "v1", scope_size=10
    )
    query.awaitTermination()
    assert table(spark, folder) == {(1, n): f"a{n}" for n in range(40)}


def test_dedupe_stream_across_batches(spark, folder):
    start = datetime.datetime(2025, 1, 1)
    rows = [(i % 10, i, start + datetime.timedelta(days=i)) for i in range(30)]
    for day in range(3):
        part = spark.createDataFrame(rows[day * 10 : day * 10 + 10], "k int, n int, ts timestamp_ntz")
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema("k int, n int, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    dedupe_stream(stream, "s", ["k"], ["n"], f"{folder}/out", f"{folder}/offsets").awaitTermination()
    assert sorted(r.k for r in read_appended(spark, f"{folder}/out").collect()) == list(range(10))


def test_dedupe_stream_keeps_late_first_rows_and_orders_a_batch(spark, folder):
    """Late first-seen keys stay; of a batch's copies the first by the given order does."""
    batches = [[("a", 10, "x"), ("a", 10, "w")], [("b", 11, "x"), ("a", 9, "late copy")], [("c", 1, "late"), ("c", 1, "early"), ("b", 0, "y")]]
    for n, rows in enumerate(batches):
        part = spark.createDataFrame(rows, "k string, day int, payload string")
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{folder}/in")
        dedupe_stream(stream, "s", ["k"], ["day", "payload"], f"{folder}/out", f"{folder}/offsets").awaitTermination()
    got = sorted(tuple(r) for r in read_appended(spark, f"{folder}/out").collect())
    assert got == [("a", 10, "w"), ("b", 11, "x"), ("c", 1, "early")]


def test_outdated_redelivery_changes_nothing(spark, folder):
    apply(spark, folder, observed(spark, range(10), "a", 1), "s-0")
    apply(spark, folder, observed(spark, range(5, 10), "b", 3), "s-1")
    apply(spark, folder, observed(spark, range(5, 10), "a", 2), "s-2")
    assert table(spark, folder) == {(1, n): f"a{n}" for n in range(5)} | {(1, n): f"b{n}" for n in range(5, 10)}
    apply(spark, folder, observed(spark, range(5, 10), "a", 2), "s-2")
    assert read_appended(spark, f"{folder}/inv").count() == 1


def test_every_reorg_has_an_invalidation_of_its_own(spark, folder):
    for n, branch in enumerate("abab"):
        apply(spark, folder, observed(spark, range(3, 6) if n else range(6), branch, n), f"s-{n}")
    rows = read_appended(spark, f"{folder}/inv").collect()
    assert [tuple(r.row_filter) for r in rows] == [(3, 5)] * 3 and len({r.id for r in rows}) == 3
    assert {r.chain_id for r in rows} == {1}


def test_logs_of_a_block_are_kept_apart(spark, folder):
    def logs(block, branch, numbers, seen_at):
        rows = [(1, block, f"{branch}{block}", n, seen_at) for n in numbers]
        return spark.createDataFrame(rows, "chain_id bigint, block_number bigint, block_hash string, log_index int, seen_at int")

    def stored():
        return sorted((r.block_number, r.block_hash, r.log_index) for r in read_committed(spark, f"{folder}/hot").collect())

    first = logs(1, "a", [0, 1, 2], 1).unionByName(logs(2, "a", [0, 1], 1)).unionByName(logs(2, "a", [1], 2))
    apply(spark, folder, first, "s-0", row_key=["log_index"])
    apply(spark, folder, logs(1, "a", [2, 3], 2), "s-1", row_key=["log_index"])
    assert stored() == [(1, "a1", n) for n in range(4)] + [(2, "a2", 0), (2, "a2", 1)]
    apply(spark, folder, logs(2, "b", [0], 3).unionByName(logs(2, "a", [5], 2)), "s-2", row_key=["log_index"])
    assert stored() == [(1, "a1", n) for n in range(4)] + [(2, "b2", 0)]


def evaluate(blocks, folder, batch_id, rule="SELECT chain_id, block_number, block_hash FROM dataset", **options):
    now = F.lit(datetime.datetime(2025, 1, 2)).cast("timestamp_ntz")
    alert_evaluate(blocks, rule, UUID, UUID, "v1", now, f"{folder}/alerts", batch_id, **options)


def test_alert_rules_sql_python_and_bad_output(spark, folder):
    blocks = spark.createDataFrame([(1, n, f"h{n}") for n in range(3)], "chain_id bigint, block_number bigint, block_hash string")
    evaluate(blocks, folder, "a")
    evaluate(blocks, folder, "b")
    assert read_appended(spark, f"{folder}/alerts").count() == 3

    def python_rule(df):
        return df.mapInPandas(lambda it: (p[p.block_number > 1] for p in it), df.schema)

    reorged = blocks.withColumn("block_hash", F.concat("block_hash", F.lit("z")))
    evaluate(reorged, folder, "c", rule=python_rule)
    assert read_appended(spark, f"{folder}/alerts").count() == 4
    broken = blocks.withColumn("block_hash", F.when(F.col("block_number") == 2, None).otherwise(F.lit("q")))
    with pytest.raises(Exception, match="missing"):
        evaluate(broken, folder, "d")
    assert read_appended(spark, f"{folder}/alerts").count() == 4


def test_alert_lookback(spark, folder):
    times = [datetime.datetime(2025, 1, 1, h) for h in (0, 12, 23)]
    rows = [(1, n, "h", t) for n, t in enumerate(times)]
    blocks = spark.createDataFrame(rows, "chain_id bigint, block_number bigint, block_hash string, block_time timestamp_ntz")
    evaluate(blocks, folder, "a", max_lookback_seconds=3600)
    assert [r.block_number for r in read_appended(spark, f"{folder}/alerts").collect()] == [2]


DELIVERY = (
    "id string, status string, attempt int, next_attempt_at timestamp_ntz, last_attempt_at timestamp_ntz, error_message string, "
    "provider_message_id string, delivered_at timestamp_ntz"
)
OUTCOME = "delivery_id string, attempt int, delivered boolean, provider_message_id string, error_message string, attempted_at timestamp_ntz"
T0 = datetime.datetime(2025, 1, 1)


def test_delivery_outcomes(spark):
    rows = [(i, "pending", 0, T0, None, None, None, None) for i in ("ok", "retry", "late", "none")]
    rows += [("last", "retrying", 11, T0, T0, "x", None, None), ("done", "delivered", 1, T0, T0, None, "m", T0)]
    deliveries = spark.createDataFrame(rows, DELIVERY)
    outcomes = spark.createDataFrame(
        [
            ("ok", 1, True, "m1", None, T0), ("retry", 1, False, None, "e" * 2000, T0), ("retry", 1, False, None, "e" * 2000, T0),
            ("late", 2, False, None, "e2", T0), ("late", 1, True, "m2", None, T0), ("last", 12, False, None, "end", T0),
            ("done", 2, False, None, "ignored", T0),
        ],
        OUTCOME,
    )
    once = delivery_outcomes(deliveries, outcomes)
    got = {r.id: r for r in once.collect()}
    assert {i: (r.status, r.attempt) for i, r in got.items()} == {
        "ok": ("delivered", 1), "retry": ("retrying", 1), "late": ("delivered", 2), "none": ("pending", 0),
        "last": ("failed", DELIVERY_MAX_ATTEMPTS), "done": ("delivered", 1),
    }
    assert got["retry"].next_attempt_at == T0 + datetime.timedelta(seconds=5) and len(got["retry"].error_message) == 1024
    assert got["ok"].provider_message_id == "m1" and got["ok"].delivered_at == T0
    assert {tuple(r) for r in delivery_outcomes(once, outcomes).collect()} == {tuple(r) for r in once.collect()}


def test_rows_of_the_latest_hash_take_one_shuffle(spark):
    """All rows with the newest hash of their block stay, those seen earlier too; then one per row key."""
    import re

    from blockloom.operators.windows import first_rows
    from blockloom.streaming.follow import _of_latest

    seen = [
        (1, 5, "a", 1, 0), (1, 5, "b", 2, 0), (1, 5, "b", 1, 1), (1, 5, "b", 2, 1),  # b is newest, its row 1 came twice
        (1, 6, "c", 3, 0), (1, 6, "d", 3, 0), (1, 7, "e", None, 0), (1, 7, "f", 1, 0),  # a tie; a null time is oldest
        (1, 8, None, 9, 0), (1, 8, "g", 1, 0), (None, 9, "h", 1, 0), (1, None, "i", 1, 0),  # newest hash or block unknown
    ]
    rows = spark.createDataFrame(seen, "chain_id bigint, block_number bigint, block_hash string, seen_at int, log_index int")
    kept = first_rows(_of_latest(rows), ["chain_id", "block_number", "log_index"], [F.desc("seen_at")])
    got = sorted((r.block_number, r.block_hash, r.seen_at, r.log_index) for r in kept.collect())
    assert got == [(5, "b", 2, 0), (5, "b", 2, 1), (6, "d", 3, 0), (7, "f", 1, 0)]
    plan = kept._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
