"""Stored state: scopes as stacks, commit logs, key indexes, keyed streams, epochs, closures, spans."""

import glob
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from blockloom.operators import intervals, joins
from blockloom.plans import closure, epochs, incremental
from blockloom.sinks import append, scopes
from blockloom.sinks.append import append_dedupe, read_appended
from blockloom.sinks.publish import publish_ranges
from blockloom.sinks.scopes import commit_log, current_scopes, extend_scopes, is_committed, read_committed, replace_scopes
from blockloom.sources.attach import ManifestError, attach_versions
from blockloom.streaming.follow import apply_blocks
from blockloom.streaming.liveliness import apply_ticks, clock, liveliness_stream
from blockloom.streaming.ranges import apply_cursors, range_aggregate_stream

UUID = "906c0c0c-342d-472f-97a1-2c9b3d4eaab1"
ROW = "partition_key string, block_number bigint, v string"


def rows(spark, numbers, value, size=100):
    return spark.createDataFrame([(f"s{n // size}", n, value) for n in numbers], ROW).coalesce(1)


def content(df):
    return {r.block_number: r.v for r in df.collect()}


# Scopes as stacks of pieces


def test_pieces_cut_add_and_merge(spark, folder):
    rng, want, history = random.Random(3), {}, []
    for n in range(6):
        low = 0 if n == 0 else rng.randrange(0, 180)
        cut = {f"s{k}": max(low, 100 * k) for k in range(low // 100, 2)}
        numbers = [k for k in range(low, 200) if rng.random() < (0.9 if n == 0 else 0.3)]
        extend_scopes(rows(spark, numbers, f"c{n}"), folder, cut, "block_number", commit_id=f"w-{n}", merge_depth=4)
        want = {k: v for k, v in want.items() if k < low} | {k: f"c{n}" for k in numbers}
        history.append(dict(want))
        assert content(read_committed(spark, folder)) == want
        counts = {r.scope: (r.row_count, r.depth) for r in current_scopes(spark, folder).collect()}
        for k in range(2):
            inside = [b for b in want if b // 100 == k]
            assert counts.get(f"s{k}", (0, 0))[0] == len(inside)
            assert counts.get(f"s{k}", (0, 0))[1] < 4
    for n, then in enumerate(history, 1):
        assert content(read_committed(spark, folder, as_of=n)) == then
    assert content(read_committed(spark, folder, ["s1"])) == {k: v for k, v in want.items() if k >= 100}
    extend_scopes(rows(spark, [], "x"), folder, {"s0": 50, "s1": 100}, "block_number")
    assert content(read_committed(spark, folder)) == {k: v for k, v in want.items() if k < 50}
    replace_scopes(rows(spark, [120], "whole"), folder)
    assert content(read_committed(spark, folder)) == {k: v for k, v in want.items() if k < 50} | {120: "whole"}


def test_many_cuts_are_a_join(spark, folder, monkeypatch):
    monkeypatch.setattr(scopes, "_MANY_CUTS", 0)
    extend_scopes(rows(spark, range(200), "a"), folder, {"s0": 0, "s1": 100}, "block_number")
    extend_scopes(rows(spark, [90, 150], "b"), folder, {"s0": 90, "s1": 120}, "block_number")
    assert content(read_committed(spark, folder)) == {k: "a" for k in [*range(90), *range(100, 120)]} | {90: "b", 150: "b"}


def test_rows_outside_the_changed_scopes_are_refused(spark, folder):
    with pytest.raises(ValueError):
        extend_scopes(rows(spark, [150], "a"), folder, {"s0": 0}, "block_number")
    with pytest.raises(ValueError):
        extend_scopes(rows(spark, [], "a"), folder, {"a:b": 0}, "block_number")
    assert not os.path.exists(f"{folder}/commits")


def test_readers_open_a_bounded_number_of_log_files(spark, folder, monkeypatch):
    """A thousand commits by their pointers alone; snapshots keep the log short and ``as_of`` exact."""
    monkeypatch.setattr(scopes, "SEGMENT", 8)
    replace_scopes(rows(spark, range(200), "a"), folder, commit_id="first")
    for n in range(1, 30):
        replace_scopes(rows(spark, [n % 2 * 100 + 5], f"c{n}"), folder, commit_id=f"w-{n}")
    log = scopes.recent_log(spark, folder)
    files = [f for f in log.inputFiles() if "/commits/" in f]
    assert commit_log(spark, folder).count() >= 30 and len(files) <= 8 and len(log.inputFiles()) <= 16
    assert len(scopes.recent_log(spark, folder, as_of=11).inputFiles()) <= 16
    assert content(read_committed(spark, folder)) == {5: "c28", 105: "c29"}
    for as_of in (1, 2, 8, 9, 16, 17, 23):
        then = content(read_committed(spark, folder, as_of=as_of))
        last = {k: max((n for n in range(1, as_of) if n % 2 == k), default=None) for k in (0, 1)}
        assert then.get(5) == (f"c{last[0]}" if last[0] else "a") and then.get(105) == (f"c{last[1]}" if last[1] else "a")
    for name, there in (("first", True), ("w-1", True), ("w-17", True), ("w-29", True), ("w-30", False), ("w-", False), ("w-05", False), ("w-5", True), ("v-1", False)):
        assert is_committed(spark, folder, name) == there, name
    assert len(glob.glob(f"{folder}/schemas/*/_SUCCESS")) == 1


# The follower writes what is new


def observed(spark, numbers, branch, seen_at):
    schema = "chain_id bigint, block_number bigint, block_hash string, seen_at int"
    return spark.createDataFrame([(1, n, f"{branch}{n}" * 20, seen_at) for n in numbers], schema)


def written(folder):
    return sum(os.path.getsize(f) for f in glob.glob(f"{folder}/hot/data/**/*.parquet", recursive=True))


def test_bytes_written_follow_the_wave(spark, folder):
    def wave(numbers, branch, seen_at, commit):
        before = written(folder)
        apply_blocks(
            observed(spark, numbers, branch, seen_at), commit, f"{folder}/hot", f"{folder}/inv", f"{folder}/events",
            "ds", "v1", scope_size=100_000,
        )
        return written(folder) - before

    large = wave(range(40_000), "a", 1, "s-0")
    small = [wave(range(40_000 + 50 * n, 40_050 + 50 * n), "a", 1, f"s-{n + 1}") for n in range(3)]
    fork = wave(range(40_140, 40_160), "b", 2, "s-4")
    again = wave(range(40_140, 40_145), "a", 1, "s-5")  # outdated: nothing is written
    assert max(small) < large / 50 and fork < large / 50 and again == 0
    got = {r.block_number: r.block_hash[0] for r in read_committed(spark, f"{folder}/hot").collect()}
    assert got == {n: "a" for n in range(40_140)} | {n: "b" for n in range(40_140, 40_160)}
    assert [tuple(r.row_filter) for r in read_appended(spark, f"{folder}/inv").collect()] == [(40_140, 40_149)]


# The key index


def keyed(spark, pairs):
    return spark.createDataFrame(pairs, "k bigint, v string")


def test_index_lookup_opens_only_buckets_of_the_batch(spark, folder, monkeypatch):
    monkeypatch.setattr(append, "TAIL_BATCHES", 2)
    for n in range(4):
        append_dedupe(folder, keyed(spark, [(k, f"b{n}") for k in range(200 * n, 200 * n + 300)]), ["k"], ["v"], f"b{n}")
    got = {r.k: r.v for r in read_appended(spark, folder).collect()}
    assert got == {k: f"b{min(3, max(0, (k - 100) // 200))}" for k in range(900)}
    index = append.KeyIndex(spark, folder, ["k"])
    generation = index.prepare()
    assert generation >= 1
    hashes = keyed(spark, [(7, ""), (850, "")]).select(append.key_hash(["k"]).alias("_key_hash")).collect()
    values = [r[0] for r in hashes]
    buckets = sorted({(v & (1 << 64) - 1) >> 64 - append.BUCKET_BITS for v in values})
    frame = spark.createDataFrame([(v,) for v in values], "_key_hash bigint")
    found = index.lookup(frame, buckets, min(values), max(values), generation, "new")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan
    scanned = {f.split("bucket=")[1].split("/")[0] for f in found.inputFiles() if "/base/" in f}
    assert "GreaterThanOrEqual(_key_hash" in plan and scanned
    assert {r._batch for r in found.collect()} == {"b0", "b3"}


def test_new_keys_read_no_rows_and_late_ones_are_found(spark, folder, monkeypatch):
    append_dedupe(folder, keyed(spark, [(k, "old") for k in range(100)]), ["k"], ["v"], "b0")
    append_dedupe(folder, keyed(spark, [(k, "mid") for k in range(100, 200)]), ["k"], ["v"], "b1")
    read = []
    real = append.stored_rows
    monkeypatch.setattr(append, "stored_rows", lambda *a: read.append(a[3]) or real(*a))
    append_dedupe(folder, keyed(spark, [(k, "new") for k in range(200, 250)]), ["k"], ["v"], "b2")
    assert not read  # no row of the table is read
    append_dedupe(folder, keyed(spark, [(3, "late"), (150, "late"), (-5, "first seen late"), (-5, "copy")]), ["k"], ["v"], "b3")
    assert [sorted(names) for names in read] == [["b0", "b1"]]
    got = {r.k: r.v for r in read_appended(spark, folder).collect()}
    assert (got[3], got[150], got[-5], len(got)) == ("old", "mid", "copy", 251)


def test_a_table_without_index_gets_one(spark, folder):
    append.append_batch(keyed(spark, [(1, "a"), (2, "a")]), folder, "b0")
    append_dedupe(folder, keyed(spark, [(2, "b"), (3, "b")]), ["k"], ["v"], "b1")
    append_dedupe(folder, keyed(spark, [(2, "b"), (3, "b")]), ["k"], ["v"], "b1")
    assert {r.k: r.v for r in read_appended(spark, folder).collect()} == {1: "a", 2: "a", 3: "b"}


def test_equal_hashes_of_other_keys_do_not_drop_rows(spark, folder, monkeypatch):
    monkeypatch.setattr(append, "key_hash", lambda keys: F.lit(5).cast("bigint"))
    for n in range(3):
        append_dedupe(folder, keyed(spark, [(n, "x"), (n + 1, "y")]), ["k"], ["v"], f"b{n}")
    assert {r.k: r.v for r in read_appended(spark, folder).collect()} == {0: "x", 1: "y", 2: "y", 3: "y"}


def test_rows_of_an_append_are_stored_once_beside_the_table(spark, folder, monkeypatch):
    """Rows of a batch of which half are known: of the rest only keys are written again."""
    names = []
    kept = append.materialized

    def noted(df, name, *options):
        names.append((name, sorted(df.columns)))
        return kept(df, name, *options)

    monkeypatch.setattr(append, "materialized", noted)
    append_dedupe(folder, keyed(spark, [(k, "old") for k in range(40)]), ["k"], ["v"], "b0")
    append_dedupe(folder, keyed(spark, [(k, "new") for k in range(20, 60)] + [(50, "a copy"), (None, "x")]), ["k"], ["v"], "b1")
    want = {k: "old" if k < 40 else "new" for k in range(60)} | {50: "a copy", None: "x"}
    assert {r.k: r.v for r in read_appended(spark, folder).collect()} == want and read_appended(spark, folder).count() == 61
    assert [columns for name, columns in names if "v" in columns] == [["_key_hash", "k", "v"]] * 2


# Keyed streams


def cursors(spark, pairs):
    return spark.createDataFrame(pairs, "stream_key string, cursor bigint")


def events_of(spark, folder):
    return sorted((r.stream_key, r.start, r.end, r.partition_key) for r in read_appended(spark, f"{folder}/events").collect())


def test_ranges_across_waves_restarts_and_replays(spark, folder):
    waves = [
        [("a", 5), ("a", 12), ("b", 7), (None, 3), ("b", None)],
        [("a", 11), ("a", 29), ("c", 100)],  # out of order
        [("a", 12), ("b", 7), ("c", 100)],  # redelivered
        [("a", 2), ("b", 40), ("c", 95)],  # lower than the start, and a leap
        [("b", 49), ("d", None)],
    ]
    for n, wave in enumerate(waves):
        cursors(spark, wave).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("stream_key string, cursor bigint").parquet(f"{folder}/in")
        range_aggregate_stream(stream, "s", 10, f"{folder}/state", f"{folder}/events", f"{folder}/offsets", buckets=3).awaitTermination()
    want = [("a", 0, 9), ("a", 10, 19), ("a", 20, 29), *[("b", 10 * n, 10 * n + 9) for n in range(5)]]
    assert events_of(spark, folder) == sorted((k, s, e, f"{s}-{e}") for k, s, e in want)
    state = {r.stream_key: r.last_emitted_end for r in read_committed(spark, f"{folder}/state").collect()}
    assert state == {"a": 30, "b": 50, "c": 100}
    for n, wave in enumerate(waves):  # every batch once more, as after a lost checkpoint commit
        apply_cursors(cursors(spark, wave), f"s-{n}", 10, f"{folder}/state", f"{folder}/events", buckets=3)
    assert events_of(spark, folder) == sorted((k, s, e, f"{s}-{e}") for k, s, e in want)


def test_a_crash_between_events_and_state_repeats_the_events(spark, folder, monkeypatch):
    import blockloom.streaming.ranges as module

    apply_cursors(cursors(spark, [("a", 25)]), "s-0", 10, f"{folder}/state", f"{folder}/events")
    with monkeypatch.context() as patch:
        patch.setattr(module, "replace_scopes", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError):
            apply_cursors(cursors(spark, [("a", 49)]), "s-1", 10, f"{folder}/state", f"{folder}/events")
    apply_cursors(cursors(spark, [("a", 49)]), "s-1", 10, f"{folder}/state", f"{folder}/events")
    assert [(s, e) for _, s, e, _ in events_of(spark, folder)] == [(20, 29), (30, 39), (40, 49)]


def test_events_are_stored_as_differences(spark, folder):
    """Numbers without dictionaries, whatever the key; the rows are those of the cursors."""
    import pyarrow.parquet as pq

    for name, schema in (("s", "string"), ("n", "bigint")):
        keys = [f"s{n}" if name == "s" else n for n in range(40)]
        frame = spark.createDataFrame([(k, 999 + n % 3) for n, k in enumerate(keys)] + [(k, 0) for k in keys], f"stream_key {schema}, cursor bigint")
        apply_cursors(frame, "s-0", 10, f"{folder}/{name}/state", f"{folder}/{name}/events", buckets=3)
        assert events_of(spark, f"{folder}/{name}") == sorted((k, 10 * i, 10 * i + 9, f"{10 * i}-{10 * i + 9}") for k in keys for i in range(100))
        columns = {}
        for file in glob.glob(f"{folder}/{name}/events/batch_id=s-0/*.parquet"):
            group = pq.ParquetFile(file).metadata.row_group(0)
            for i in range(group.num_columns):
                columns.setdefault(group.column(i).path_in_schema, set()).update(group.column(i).encodings)
        numbers = {"start", "end"} | ({"stream_key"} if name == "n" else set())
        assert {c for c, used in columns.items() if "DELTA_BINARY_PACKED" in used and "RLE_DICTIONARY" not in used} == numbers


def test_events_of_any_batch_name(spark, folder):
    """Names that a folder cannot have as they are, and batches without events, are read like all others."""
    for n, name in enumerate(["s-0", "a:b/c=%d-1", "s-2"]):
        for state in ("state", "again"):  # as after a crash before the state is written
            apply_cursors(cursors(spark, [(f"k{n}", 29 if n < 2 else 5)]), name, 10, f"{folder}/{state}{n}", f"{folder}/events")
    assert [(k, s) for k, s, _, _ in events_of(spark, folder)] == [("k0", 20), ("k1", 20)]


BLOCKS = "chain_id bigint, block_number bigint, block_time timestamp_ntz, at timestamp_ntz"


def tick(spark, folder, n, blocks=(), at=None, **options):
    import datetime

    start = datetime.datetime(2025, 1, 1)
    made = [(c, b, start + datetime.timedelta(seconds=s), None) for c, b, s in blocks]
    made += [(None, None, None, start + datetime.timedelta(seconds=s)) for s in (at or [])]
    apply_ticks(spark.createDataFrame(made, BLOCKS), f"t-{n}", f"{folder}/state", f"{folder}/events", 10_000, 60_000, **options)


def statuses(spark, folder):
    found = read_appended(spark, f"{folder}/events").orderBy("judged_at", "chain_id").collect()
    return [(r.chain_id, r.last_block, r.gap_ms, r.status) for r in found]


def test_stalls_are_reported_without_blocks(spark, folder):
    tick(spark, folder, 0, [(1, 7, 100), (1, 6, 90), (2, 3, 100)], [101, 105])
    for _ in range(2):  # a replay changes nothing
        tick(spark, folder, 1, at=[130])
    tick(spark, folder, 2, [(2, 4, 135)])  # no tick: the state alone moves
    tick(spark, folder, 3, at=[170])
    tick(spark, folder, 4, [(1, 8, 172), (1, 5, 80)], [175])
    assert statuses(spark, folder) == [
        (1, 7, 5000, "ok"), (2, 3, 5000, "ok"), (1, 7, 30000, "degraded"), (2, 3, 30000, "degraded"),
        (1, 7, 70000, "stalled"), (2, 4, 35000, "degraded"), (1, 8, 3000, "ok"), (2, 4, 40000, "degraded"),
    ]


def test_changes_of_status_alone(spark, folder):
    for n, (blocks, at) in enumerate([([(1, 7, 100)], [101]), ([], [103]), ([], [130]), ([], [140]), ([], [200]), ([(1, 8, 201)], [202])]):
        tick(spark, folder, n, blocks, at, changes_only=True)
    assert [s for _, _, _, s in statuses(spark, folder)] == ["ok", "degraded", "stalled", "ok"]


def test_the_clock_goes_on_without_blocks(spark, folder):
    """One old block, then only processing time: events keep coming."""
    schema = "chain_id bigint, block_number bigint, block_time timestamp"
    spark.sql("SELECT 1L AS chain_id, 5L AS block_number, timestamp'2025-01-01 00:00:00' AS block_time").write.parquet(f"{folder}/in")
    blocks = spark.readStream.schema(schema).parquet(f"{folder}/in")
    stream = liveliness_stream(blocks, clock(spark), "live", f"{folder}/state", f"{folder}/events", f"{folder}/offsets", 1000, 5000, interval="1 second")
    try:
        for _ in range(60):
            time.sleep(0.5)
            assert stream.exception() is None
            if os.path.exists(f"{folder}/events") and len(glob.glob(f"{folder}/events/batch_id=*/*.parquet")) >= 2:
                break
    finally:
        stream.stop()
    found = read_appended(spark, f"{folder}/events").collect()
    assert len({r.judged_at for r in found}) >= 2 and {(r.chain_id, r.last_block, r.status) for r in found} == {(1, 5, "stalled")}


# Epochs


def test_late_duties_change_the_last_epochs_alone(spark, folder):
    def duties(pairs):
        return spark.createDataFrame([(v, e, False, 1, 1.0) for v, e in pairs], "validator bigint, epoch bigint, missed boolean, inclusion_distance int, reward double")

    def stored():
        return {(r.validator, r.epoch): r.duties for r in read_committed(spark, folder).collect()}

    def files():
        return {f for f in glob.glob(f"{folder}/data/**/*.parquet", recursive=True)}

    first = [(v, e) for v in (1, 2) for e in range(30)]
    epochs.refresh_validator_stats(duties(first), folder, None, size=10)
    assert stored() == {p: 1 for p in first}
    before = files()
    late = [*first, (1, 3), (1, 24), (2, 31), (1, 33)]
    epochs.refresh_validator_stats(duties(late), folder, 8, 31, size=10)
    assert stored() == {p: 1 for p in first} | {(1, 24): 2, (2, 31): 1}
    scopes_written = {f.split("scope=")[1].split("/")[0] for f in files() - before}
    assert scopes_written == {"e2", "e3"}
    epochs.refresh_validator_stats(duties(first), folder, 4, 28, size=10)  # a head that went back
    assert stored() == {p: 1 for p in first if p[1] <= 28} | {}  | ({} if (1, 24) not in stored() else {(1, 24): stored()[1, 24]})
    assert epochs.refresh_validator_stats(duties([]), f"{folder}/none", None) == 0


# Closures


def test_a_deep_chain_takes_few_rounds(spark, monkeypatch):
    made = []
    real = closure.materialized
    monkeypatch.setattr(closure, "materialized", lambda df, name="stage": made.append(name) or real(df, name))
    edges = spark.range(10_000).selectExpr("id AS src", "id + 1 AS dst")
    got = closure.downstream_closure(edges, spark.createDataFrame([(0,)], "node bigint"))
    assert got.filter("node <> depth").isEmpty() and got.count() == 10_001
    assert len(made) < 50 and made.count("found") < 40


@pytest.mark.parametrize("seed", range(3))
def test_distances_equal_breadth_first_search(spark, monkeypatch, seed):
    monkeypatch.setattr(closure, "SHALLOW", 1)
    rng = random.Random(seed)
    pairs = [(n, n + 1) for n in range(60) if rng.random() < 0.97] + [(rng.randrange(60), rng.randrange(60)) for _ in range(6)]
    start = [0, 30]
    want, frontier = {n: 0 for n in start}, start
    while frontier:
        following = sorted({b for a, b in pairs if a in frontier} - set(want))
        want |= {n: want[frontier[0]] + 1 for n in following}
        frontier = following
    got = closure.downstream_closure(spark.createDataFrame(pairs, "src int, dst int"), spark.createDataFrame([(n,) for n in start], "node int"))
    assert {r.node: r.depth for r in got.collect()} == want


# Spans


@pytest.mark.parametrize("rows_a_part", [3, 10**6])
def test_merged_spans_equal_brute_force(spark, rows_a_part):
    rng = random.Random(9)
    spans = [(rng.choice([1, 2, None]), a := rng.randrange(200), a + rng.choice([0, 1, 5, 40])) for _ in range(60)]
    spans += [(1, 150, 10**6), (2, intervals.LOWEST, 3), (1, 20, 30), (1, 20, 30), (3, intervals.LOWEST, intervals.HIGHEST), (3, 5, 6)]
    want = []
    for key in {k for k, _, _ in spans}:
        merged = []
        for first, last in sorted((a, b) for k, a, b in spans if k == key):
            if merged and first - 1 <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], last)
            else:
                merged.append([first, last])
        want += [(key, a, b) for a, b in merged]
    frame = spark.createDataFrame(spans, "chain bigint, first bigint, last bigint")
    got = [tuple(r) for r in intervals.merged_spans(frame, "chain", rows_a_part).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_scopes_far_apart_do_not_open_what_lies_between(spark, folder):
    spark.range(0, 100_000, 1, 4).selectExpr("1L AS chain_id", "id AS block_number").write.parquet(f"{folder}/t")
    names = spark.createDataFrame([("0-9",), ("5-19",), ("1_99990-99999",)], "partition_key string")
    found = incremental._within_scopes(spark.read.parquet(f"{folder}/t"), names)
    assert sorted(r.block_number for r in found.collect()) == [*range(20), *range(99_990, 100_000)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters:")[1].split("]")[0]
    assert pushed.count("Or(") == 1 and "GreaterThanOrEqual(block_number,99990)" in pushed
    many = spark.range(0, 90_000, 30).selectExpr("concat(id, '-', id + 1) AS partition_key")
    some = incremental._within_scopes(spark.read.parquet(f"{folder}/t"), many)
    kept = {r.block_number for r in some.collect()}
    assert kept >= {n for s in range(0, 90_000, 30) for n in (s, s + 1)} and max(kept) < 90_000


def test_invalidation_bounds_of_many_parts(spark):
    spans = [("row_range", None, (n * 10, n * 10 + 4 + n % 3 * 5)) for n in range(40)]
    frame = spark.createDataFrame(spans, "scope string, partition_key string, row_filter struct<gte:bigint,lte:bigint>")
    usable, _ = joins.usable_invalidations(frame)
    whole = sorted(map(str, joins.invalidation_bounds(usable).collect()))
    assert whole == sorted(map(str, joins.invalidation_bounds(usable, rows_a_part=4).collect())) and len(whole) == 14


# Publications


def published(spark, folder):
    data = spark.range(60).selectExpr("1L AS chain_id", "id AS block_number", "'x' AS block_hash")
    spans = [(UUID, 1, s, s + 20, "cfg") for s in (0, 20, 40)]
    ranges = spark.createDataFrame(spans, "dataset_uuid string, chain_id bigint, range_start bigint, range_end bigint, config_hash string")
    return data, ranges, publish_ranges(data, ranges, folder)


def test_a_range_opens_only_its_manifests_and_files(spark, folder):
    data, ranges, found = published(spark, folder)
    for f in glob.glob(f"{folder}/cryo/**/range=0_20/**/_manifest.json", recursive=True):
        os.truncate(f, 3)  # would refuse the whole set if it were read
    some = attach_versions(found, folder, first=25, last=45)
    assert {f.split("range=")[1].split("/")[0] for f in some.inputFiles()} == {"20_40", "40_60"} and some.count() == 40
    with pytest.raises(ManifestError, match="malformed"):
        attach_versions(found, folder)
    with pytest.raises(ManifestError, match="oversized"):
        attach_versions(found, folder, first=25, max_bytes=10)
    with pytest.raises(ManifestError):
        attach_versions(found, folder, first=1000)


def test_publishing_lists_only_the_versions_it_writes(spark, folder, monkeypatch):
    import blockloom.sinks.publish as module

    data, ranges, _ = published(spark, folder)
    listed = []
    real = module.list_folders
    monkeypatch.setattr(module, "list_folders", lambda df, address: listed.append(df.count()) or real(df, address))
    more = spark.createDataFrame([(UUID, 1, 60, 80, "cfg")], ranges.schema)
    publish_ranges(spark.range(60, 80).selectExpr("1L AS chain_id", "id AS block_number", "'y' AS block_hash"), ranges.unionByName(more), folder)
    assert listed == [1, 1]
