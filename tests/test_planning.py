import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from blockloom.functions import ids
from blockloom.operators import ranges as rg
from blockloom.operators.joins import sync_status
from blockloom.plans.closure import downstream_closure

NOW = datetime.datetime(2025, 1, 1, 12, 0, 0)
JOB = "job_id string, org_id string, chain_id bigint, enabled boolean, mode string, from_block bigint, to_block bigint, tail_lag bigint, max_head_age_seconds int"
STREAM = "job_id string, dataset_key string, cryo_dataset_name string, rpc_pool string, config_hash string, chunk_size bigint, max_inflight bigint"


class State:
    def __init__(self, spark, mode="fixed_target", from_block=0, to_block=3000, tail_lag=None, max_age=None, chunk=1000, inflight=10, enabled=True):
        self.spark = spark
        self.jobs = spark.createDataFrame([("j", "o", 1, enabled, mode, from_block, to_block, tail_lag, max_age)], JOB)
        self.streams = spark.createDataFrame([("j", "blocks", "blocks", "p", "cfg", chunk, inflight)], STREAM)
        self.cursors = spark.createDataFrame([], "job_id string, dataset_key string, next_block bigint")
        self.ranges = spark.createDataFrame([], "job_id string, dataset_key string, range_start bigint, range_end bigint, task_id string, status string")
        self.heads = spark.createDataFrame([], "org_id string, chain_id bigint, rpc_pool string, head_block bigint, observed_at timestamp_ntz")

    def with_ranges(self, *rows):
        self.ranges = self.spark.createDataFrame([("j", "blocks", s, e, "t", status) for s, e, status in rows], self.ranges.schema)
        return self

    def with_cursor(self, block):
        self.cursors = self.spark.createDataFrame([("j", "blocks", block)], self.cursors.schema)
        return self

    def with_head(self, block, age_seconds=0.0):
        seen = NOW - datetime.timedelta(seconds=age_seconds)
        self.heads = self.spark.createDataFrame([("o", 1, "p", block, seen)], self.heads.schema)
        return self

    def plan(self):
        new, cursors = rg.plan_ranges(self.jobs, self.streams, self.cursors, self.ranges, self.heads, F.lit(NOW).cast("timestamp_ntz"))
        return sorted((r.range_start, r.range_end) for r in new.collect()), [r.next_block for r in cursors.collect()], new

    def window(self):
        row = rg.eligible_window(self.jobs, self.streams, self.heads, F.lit(NOW).cast("timestamp_ntz")).first()
        return row.eligible_end, row.error_kind


def test_fixed_target_plans_once(spark):
    state = State(spark)
    ranges, cursor, new = state.plan()
    assert (ranges, cursor) == ([(0, 1000), (1000, 2000), (2000, 3000)], [3000])
    task = new.filter("range_start = 0").first()
    assert task.task_id == str(uuid.uuid5(uuid.UUID(ids.TASK_NAMESPACE), "chain_sync:j:blocks:0:1000"))
    again = state.with_ranges(*[(s, e, "scheduled") for s, e in ranges]).with_cursor(3000)
    assert again.plan()[:2] == ([], [3000])


def test_slots_limit_and_last_range_is_short(spark):
    assert State(spark, to_block=2500, inflight=2).plan()[:2] == ([(0, 1000), (1000, 2000)], [2000])
    assert State(spark, to_block=2500).with_cursor(2000).plan()[:2] == ([(2000, 2500)], [2500])
    busy = State(spark, inflight=2).with_ranges((0, 1000, "scheduled"), (1000, 2000, "running")).with_cursor(2000)
    assert busy.plan()[:2] == ([], [2000])
    done = State(spark, inflight=2).with_ranges((0, 1000, "completed"), (1000, 2000, "running")).with_cursor(2000)
    assert done.plan()[:2] == ([(2000, 3000)], [3000])


def test_recorded_ranges_move_the_cursor_without_a_slot(spark):
    state = State(spark, to_block=6000, inflight=3).with_ranges((0, 1000, "completed"), (1000, 2000, "completed"), (3000, 4000, "running"))
    # Two slots are free: 2000 and 4000 are new, 3000 is passed over.
    assert state.plan()[:2] == ([(2000, 3000), (4000, 5000)], [5000])
    # The last slot stops planning before a recorded range behind it.
    state = State(spark, to_block=6000, inflight=2).with_ranges((1000, 2000, "running"))
    assert state.plan()[:2] == ([(0, 1000)], [1000])
    # All remaining ranges on record: the cursor reaches the end.
    state = State(spark, to_block=2000).with_ranges((0, 1000, "completed"), (1000, 2000, "completed"))
    assert state.plan()[:2] == ([], [2000])


def brute_force(cursor, eligible, chunk, slots, recorded):
    out = []
    while slots > 0 and cursor < eligible:
        step = (cursor, min(eligible, cursor + chunk))
        if step not in recorded:
            out.append(step)
            slots -= 1
        cursor = step[1]
    return out, [cursor]


@pytest.mark.parametrize("seed", range(6))
def test_planning_equals_brute_force(spark, seed):
    import random

    rng = random.Random(seed)
    eligible, chunk, inflight, cursor = rng.randint(0, 120), rng.randint(1, 9), rng.randint(1, 9), rng.randint(0, 40)
    steps = [(s, min(eligible, s + chunk)) for s in range(cursor, eligible, chunk)]
    recorded = [(s, e, rng.choice(["completed", "completed", "running"])) for s, e in steps if rng.random() < 0.4]
    state = State(spark, to_block=eligible, chunk=chunk, inflight=inflight).with_ranges(*recorded).with_cursor(cursor)
    slots = inflight - sum(1 for r in recorded if r[2] != "completed")
    assert state.plan()[:2] == brute_force(cursor, eligible, chunk, slots, {(s, e) for s, e, _ in recorded})


def test_defaults_and_disabled(spark):
    ranges, cursor, _ = State(spark, to_block=50_000, chunk=None, inflight=None).plan()
    assert len(ranges) == 10 and ranges[-1] == (9000, 10_000) and cursor == [10_000]
    assert State(spark, enabled=False).plan()[:2] == ([], [])
    assert State(spark, mode="paused").plan()[:2] == ([], [])


def test_follow_head_window(spark):
    def follow(**kw):
        return State(spark, mode="follow_head", to_block=None, **kw)

    assert follow(tail_lag=5, max_age=60).with_head(100).window() == (96, None)
    assert follow(tail_lag=500, max_age=60, from_block=7).with_head(100).window() == (7, None)
    assert follow(tail_lag=5, max_age=60).window() == (None, rg.MISSING_HEAD)
    assert follow(tail_lag=5, max_age=60).with_head(100, 61).window() == (None, rg.STALE_HEAD)
    # Age counts in whole seconds.
    assert follow(tail_lag=5, max_age=60).with_head(100, 60.9).window() == (96, None)
    assert follow(tail_lag=None, max_age=60).with_head(100).window() == (None, rg.INVALID_CONFIG)
    assert follow(tail_lag=5, max_age=None).with_head(100).window() == (None, rg.INVALID_CONFIG)
    assert State(spark, to_block=None).window() == (None, rg.INVALID_CONFIG)


def test_status_of_follow_head(spark):
    state = State(spark, mode="follow_head", to_block=None, tail_lag=5, max_age=60).with_head(100).with_cursor(0)
    now = F.lit(NOW).cast("timestamp_ntz")
    row = sync_status(state.jobs, state.streams, state.cursors, state.ranges, state.heads, now).first()
    assert (row.next_block, row.inflight, row.completed, row.observed_head, row.eligible_end) == (0, 0, 0, 100, 96)


def test_split_then_aggregate_is_identity(spark):
    events = spark.createDataFrame([("0-9999", None, None), ("x", 10_000, 19_999)], "partition_key string, start bigint, end bigint")
    parts = rg.range_split(events, 1000)
    assert parts.count() == 20 and parts.filter("end - start <> 999").count() == 0
    cursors = parts.select(F.lit("s").alias("stream_key"), F.col("end").alias("cursor"))
    joined, state = rg.range_aggregate(cursors, 10_000)
    assert sorted(r.partition_key for r in joined.collect()) == ["0-9999", "10000-19999"]
    assert state.first().last_emitted_end == 20_000
    again, same = rg.range_aggregate(cursors, 10_000, state)
    assert again.count() == 0 and same.first().last_emitted_end == 20_000


def test_aggregate_waits_for_full_ranges(spark):
    one = spark.createDataFrame([("s", 5), ("s", 8)], "stream_key string, cursor bigint")
    events, state = rg.range_aggregate(one, 10)
    assert events.count() == 0 and state.first().last_emitted_end == 0
    later = spark.createDataFrame([("s", 9)], "stream_key string, cursor bigint")
    events, state = rg.range_aggregate(later, 10, state)
    assert [tuple(r) for r in events.collect()] == [("s", "0-9", 0, 9)] and state.first().last_emitted_end == 10


def test_events_of_long_leaps_are_dealt_by_their_blocks(spark):
    """Streams that start anywhere, with few rows in one task: events come from many tasks, each range from few."""
    starts = {f"s{n}": 37 * n - 50 for n in range(6)}
    cursors = spark.createDataFrame([(k, 41_000 + 3 * n) for n, k in enumerate(starts)] + [("t", -7), ("t", 12_345)], "stream_key string, cursor bigint").coalesce(1)
    state = spark.createDataFrame([*starts.items(), ("idle", 5)], "stream_key string, last_emitted_end bigint").coalesce(1)
    events, after = rg.range_aggregate(cursors, 10, state)
    rows = events.withColumn("task", F.spark_partition_id()).collect()
    highest = {k: 41_000 + 3 * n for n, k in enumerate(starts)}
    want = [(k, s, s + 9) for k, first in starts.items() for s in range(first, highest[k] + 1 - 9, 10)]
    want += [("t", s, s + 9) for s in range(-10, 12_345 + 1 - 9, 10)]
    assert sorted((r.stream_key, r.start, r.end) for r in rows) == sorted(want)
    assert all(r.partition_key == f"{r.start}-{r.end}" for r in rows)
    assert {r.stream_key: r.last_emitted_end for r in after.collect()} == {"idle": 5} | {k: max(e for s, _, e in want if s == k) + 1 for k in [*starts, "t"]}
    places = {(r.task, r.start // 5120) for r in rows}
    assert len({task for task, _ in places}) >= 4 and len(places) <= 9 + 8


def test_ranges_of_streams_that_are_alike_are_made_together(spark):
    """More streams than one list holds, two without a name, some that start off the others' ranges."""
    first = {n: 3 if n % 50 == 0 else 0 for n in range(300)}
    seen = [(n, 12_000 + n % 7) for n in first] + [(None, 10_239)]
    state = spark.createDataFrame([*first.items(), (None, 20)], "stream_key bigint, last_emitted_end bigint")
    events, after = rg.range_aggregate(spark.createDataFrame(seen, "stream_key bigint, cursor bigint"), 10, state)
    rows = events.withColumn("task", F.spark_partition_id()).collect()
    want = [(n, s, s + 9) for n, low in first.items() for s in range(low, 12_000 + n % 7 + 1 - 9, 10)]
    want += [(None, s, s + 9) for s in range(10_230, 10_240 - 9, 10)]
    found = [(r.stream_key, r.start, r.end) for r in rows]
    assert sorted(found, key=str) == sorted(want, key=str) and all(r.partition_key == f"{r.start}-{r.end}" for r in rows)
    assert after.filter("stream_key IS NULL").count() == 2 and after.count() == 302
    changes = sum((a.task, a.partition_key) != (b.task, b.partition_key) for a, b in zip(rows, rows[1:]))
    assert changes < len(rows) / 5  # a range's rows lie together, so its text is made for many streams at once


def test_long_ranges_split_without_long_arrays(spark):
    event = spark.createDataFrame([("0-45999999", None, None)], "partition_key string, start bigint, end bigint")
    parts = rg.range_split(event, 5000)
    assert parts.count() == 9200 and parts.agg(F.max("end")).first()[0] == 45_999_999


def test_closure_with_diamond_and_cycle(spark):
    edges = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("x", "y")]
    df = spark.createDataFrame(edges, "src string, dst string")
    changed = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.depth) for r in downstream_closure(df, changed).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
