"""Sources, sinks and incremental runs: replays, crashes, conflicts."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from blockloom.operators import filters, joins
from blockloom.operators.windows import block_gaps, detect_reorg
from blockloom.plans import incremental
from blockloom.plans.closure import downstream_closure
from blockloom.sinks import versions
from blockloom.sinks.append import append_dedupe, read_appended
from blockloom.sinks.compact import compact_finalized, purge_range
from blockloom.sinks.export import export_result
from blockloom.sinks.files import expired_staging, list_files, output_caps
from blockloom.sinks.publish import OutputCapsExceeded, plan_publications, publish_ranges
from blockloom.sinks.scopes import commit_log, current_scopes, partition_versions, read_committed, replace_scope, replace_scopes
from blockloom.sources.attach import ManifestError, attach_pinned, attach_prefix, attach_versions
from blockloom.sources.jsonl import read_jsonl_batches
from blockloom.sources.synth import synth_blocks
from blockloom.sources.unify import hot_cold_union

BLOCK = "chain_id bigint, block_number bigint, block_hash string"
UUID = "906c0c0c-342d-472f-97a1-2c9b3d4eaab1"


def blocks(spark, rows):
    return spark.createDataFrame(rows, BLOCK)


def keys(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# --- JSON lines -------------------------------------------------------------------------


def line(**changes):
    row = {
        "alert_definition_id": UUID, "dedupe_key": "k", "event_time": "2025-01-01T00:00:00Z", "chain_id": 1, "block_number": 2,
        "block_hash": "0x1", "tx_hash": "0x2", "payload": {"a": [1, {"b": None}]},
    }
    row.update(changes)
    return json.dumps({k: v for k, v in row.items() if v is not ...})


def batch(folder, name, *lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.jsonl", "wb") as out:
        out.write(b"\n".join(x if isinstance(x, bytes) else x.encode() for x in lines))


BAD_LINES = {
    "text": "not json",
    "payload": line(payload="not-an-object"),
    "null_payload": line(payload=None),
    "list": "[" + line() + "]",
    "extra": line(extra=1),
    "missing": line(tx_hash=...),
    "int_as_text": line(chain_id="1"),
    "float": line(chain_id=1.5),
    "float_like_int": line(chain_id=1).replace('"chain_id": 1', '"chain_id": 1.0'),
    "too_big": line(block_number=2**63),
    "text_as_int": line(block_hash=1),
    "uuid": line(alert_definition_id="x"),
    "time": line(event_time="2025-01-01"),
    "trailing": line() + "}",
    "two": line() + line(),
    "twice": line()[:-1] + ', "chain_id": 2}',
    "bytes": line().encode().replace(b"0x1", b"\xff\xfe"),
}


def test_jsonl_poison_rejects_whole_file(spark, folder):
    batch(folder, "good", line(dedupe_key="g1"), "", "   ", line(dedupe_key="g2", chain_id=-5) + "\r", "")
    for name, bad in BAD_LINES.items():
        batch(folder, name, line(dedupe_key=f"lost-{name}"), bad)
    good, rejected = read_jsonl_batches(spark, folder)
    rows = {r.dedupe_key: r for r in good.collect()}
    assert set(rows) == {"g1", "g2"}
    assert rows["g2"].chain_id == -5 and json.loads(rows["g1"].payload) == {"a": [1, {"b": None}]}
    names = {os.path.basename(r.file).removesuffix(".jsonl") for r in rejected.collect()}
    assert names == set(BAD_LINES)


# --- manifests and publishing -----------------------------------------------------------


def publish(spark, folder, size=10, rows=25):
    data = blocks(spark, [(1, n, f"0x{n:016x}") for n in range(rows)])
    spans = [(UUID, 1, s, min(s + size, rows), "cfg") for s in range(0, rows, size)]
    ranges = spark.createDataFrame(spans, "dataset_uuid string, chain_id bigint, range_start bigint, range_end bigint, config_hash string")
    return data, ranges, publish_ranges(data, ranges, folder)


def test_publish_pins_and_replays(spark, folder):
    data, ranges, published = publish(spark, folder)
    assert published.count() == 3
    first = published.filter("range_start = 10").first()
    prefix = first.storage_prefix[len(folder):].strip("/")
    assert keys(attach_pinned(spark, folder, prefix, UUID, first.dataset_version), "block_number") == [(n,) for n in range(10, 20)]
    publish_ranges(data, ranges, folder)
    assert keys(attach_versions(published, folder), "block_number") == [(n,) for n in range(25)]
    with pytest.raises(ManifestError):
        attach_pinned(spark, folder, prefix, UUID, "other-version")


def test_readers_survive_publications_that_fail_or_repeat(spark, folder, monkeypatch):
    import functools

    import blockloom.sinks.publish as module

    data, ranges, published = publish(spark, folder)
    pinned = attach_versions(published, folder)
    files = set(glob.glob(f"{folder}/cryo/**/*.parquet", recursive=True))
    publish_ranges(data, ranges, folder)
    assert set(glob.glob(f"{folder}/cryo/**/*.parquet", recursive=True)) == files  # complete versions are left alone
    more = blocks(spark, [(1, n, "y") for n in range(100, 110)])
    later = spark.createDataFrame([(UUID, 1, 100, 110, "cfg")], ranges.schema)
    with monkeypatch.context() as patch:
        patch.setattr(module, "output_caps", functools.partial(output_caps, max_files=0))
        with pytest.raises(OutputCapsExceeded):
            publish_ranges(more, later, folder)
    assert keys(pinned, "block_number") == keys(attach_versions(published, folder), "block_number") == [(n,) for n in range(25)]
    found = publish_ranges(more, later, folder)
    assert keys(attach_versions(found, folder), "block_number") == [(n,) for n in range(100, 110)]


def test_registration_of_the_same_publication_is_one_row(spark, folder):
    _, _, published = publish(spark, folder)
    empty = spark.createDataFrame([], published.schema)
    new, conflicts = versions.register_versions(empty, published.unionByName(published))
    assert new.count() == 3 and conflicts.count() == 0
    again, conflicts = versions.register_versions(new, published)
    assert again.count() == 0 and conflicts.count() == 0
    changed = published.withColumn("config_hash", F.lit("other"))
    again, conflicts = versions.register_versions(new, changed)
    assert again.count() == 0 and conflicts.count() == 3


@pytest.mark.parametrize(
    ("change", "rule"),
    [
        ({"version": 2}, "unsupported_version"),
        ({"dataset_uuid": "x"}, "registry_mismatch"),
        ({"parquet_keys": []}, "no_objects"),
        ({"parquet_keys": ["data/v1-other/a.parquet"]}, "outside_prefix"),
        ({"parquet_keys": ["data/v1/../v2\\a.parquet"]}, "backslash"),
        ({"parquet_keys": ["data/v1/a.csv"]}, "not_parquet"),
        ({"parquet_keys": [f"data/v1/{i}.parquet" for i in range(4)]}, "too_many_objects"),
        ({"extra": 1}, "malformed"),
        ({"parquet_keys": None}, "malformed"),
    ],
)
def test_broken_manifest_is_refused(spark, folder, change, rule):
    body = {"version": 1, "dataset_uuid": UUID, "dataset_version": UUID, "parquet_keys": ["data/v1/a.parquet"], **change}
    os.makedirs(f"{folder}/data/v1")
    with open(f"{folder}/data/v1/_manifest.json", "w") as out:
        json.dump(body, out)
    with pytest.raises(ManifestError, match=rule):
        attach_pinned(spark, folder, "data/v1", UUID, UUID, max_objects=3)


def test_manifest_alias_and_size(spark, folder):
    blocks(spark, [(1, 1, "a")]).coalesce(1).write.parquet(f"{folder}/data/v1/x")
    name = os.path.basename(glob.glob(f"{folder}/data/v1/x/*.parquet")[0])
    body = {"version": 1, "dataset_uuid": UUID, "dataset_version": UUID, "parquet_objects": [f"/data/v1/x/{name}"]}
    with open(f"{folder}/data/v1/_manifest.json", "w") as out:
        json.dump(body, out)
    assert attach_pinned(spark, folder, "data/v1", UUID, UUID).count() == 1
    with open(f"{folder}/data/v1/_manifest.json", "w") as out:
        out.write(json.dumps(body) + " " * (1 << 20))
    with pytest.raises(ManifestError, match="larger"):
        attach_pinned(spark, folder, "data/v1", UUID, UUID)


def test_empty_prefix_is_refused(spark):
    with pytest.raises(ValueError):
        attach_prefix(spark, "/")


def test_output_caps_fail_publishing(spark, folder, monkeypatch):
    import blockloom.sinks.publish as module

    monkeypatch.setattr(module, "output_caps", lambda files: output_caps(files, max_file_bytes=10))
    with pytest.raises(OutputCapsExceeded):
        publish(spark, folder)
    assert not glob.glob(f"{folder}/**/_manifest.json", recursive=True)


def test_synthetic_blocks(spark):
    spans = [(1, 0, 3), (1, 100, 102), (1, 7, 8), (1, 9, 9), (1, 0, 1000)]
    out = {
        (s, e): [r[0] for r in keys(synth_blocks(spark.createDataFrame([(1, s, e)], "chain_id bigint, range_start bigint, range_end bigint")), "block_number")]
        for _, s, e in spans
    }
    assert out == {(0, 3): [0, 1, 2], (100, 102): [100, 101], (7, 8): [7], (9, 9): [9], (0, 1000): [0, 1, 999]}


def test_plan_publications_is_deterministic(spark):
    ranges = spark.createDataFrame([(UUID, 1, 0, 10, "cfg")], "dataset_uuid string, chain_id bigint, range_start bigint, range_end bigint, config_hash string")
    row = plan_publications(ranges).first()
    assert row.storage_prefix == f"cryo/chain=1/dataset={UUID}/range=0_10/version={row.dataset_version}"


# --- append -----------------------------------------------------------------------------


def test_append_first_writer_wins_and_replay_changes_nothing(spark, folder):
    target = f"{folder}/t"
    one, two = blocks(spark, [(1, 1, "b"), (1, 1, "a"), (1, 2, "x")]), blocks(spark, [(1, 2, "y"), (1, 3, "z")])
    for batch_id, rows in (("b1", one), ("b2", two), ("b1", one), ("b2", two), ("b2", two)):
        append_dedupe(target, rows, ["chain_id", "block_number"], ["block_hash"], batch_id)
    assert keys(read_appended(spark, target), *BLOCK.replace(" bigint", "").replace(" string", "").split(", ")) == [(1, 1, "a"), (1, 2, "x"), (1, 3, "z")]


def test_append_after_empty_first_batch(spark, folder):
    target = f"{folder}/t"
    append_dedupe(target, blocks(spark, []), ["block_number"], ["block_hash"], "b0", range_column="block_number")
    append_dedupe(target, blocks(spark, [(1, 5, "a")]), ["block_number"], ["block_hash"], "b1", range_column="block_number")
    assert read_appended(spark, target).count() == 1


def test_append_hot_key(spark, folder):
    copies = spark.range(3000).selectExpr("1L AS chain_id", "IF(id % 3 = 0, 7L, id) AS block_number", "cast(id AS string) AS block_hash")
    append_dedupe(f"{folder}/t", copies, ["chain_id", "block_number"], ["block_hash"], "b1")
    got = read_appended(spark, f"{folder}/t")
    assert got.count() == copies.select("block_number").distinct().count()
    assert got.filter("block_number = 7").first().block_hash == "0"


# --- scopes -----------------------------------------------------------------------------


def scoped(spark, rows):
    return spark.createDataFrame([(1, n, h, f"{n // 10 * 10}-{n // 10 * 10 + 9}") for n, h in rows], BLOCK + ", partition_key string")


def test_only_committed_scopes_are_visible(spark, folder):
    rows = scoped(spark, [(n, "a") for n in range(30)])
    assert replace_scopes(rows, folder) == 1
    rows.withColumn("scope", F.col("partition_key")).write.partitionBy("scope").parquet(f"{folder}/data/attempt=a-crash")
    assert read_committed(spark, folder).count() == 30
    replace_scope(scoped(spark, [(3, "b")]), folder, "0-9")
    replace_scope(rows.limit(0), folder, "10-19")
    assert keys(read_committed(spark, folder).filter("block_number < 20"), "block_number", "block_hash") == [(3, "b")]
    assert read_committed(spark, folder, as_of=1).count() == 30
    assert read_committed(spark, folder, ["20-29"]).count() == 10 and read_committed(spark, folder, []).count() == 0
    stats = {r.partition_key: r.row_count for r in partition_versions(spark, folder, "d", "v").collect()}
    assert stats == {"0-9": 1, "10-19": 0, "20-29": 10}


def test_expired_staging_never_lists_committed(spark, folder):
    rows = scoped(spark, [(n, "a") for n in range(30)])
    replace_scopes(rows, folder)
    replace_scope(scoped(spark, [(3, "b")]), folder, "0-9")
    rows.write.parquet(f"{folder}/data/attempt=a-crash/x")
    now = F.current_timestamp()
    files, log = list_files(spark, f"{folder}/data"), commit_log(spark, folder)
    assert expired_staging(files, log, now).count() == 0
    late = expired_staging(files, log, now + F.expr("INTERVAL 8 DAYS")).collect()
    assert len(late) == 1 and late[0].attempt.endswith("attempt=a-crash")


def test_compact_then_purge(spark, folder):
    hot, cold = f"{folder}/hot", f"{folder}/cold"
    replace_scopes(scoped(spark, [(n, "a") for n in range(40)]), hot)
    for _ in range(2):
        compact_finalized(read_committed(spark, hot), cold, "20-39", finality_depth=5, chunk_size=4)
    assert keys(read_committed(spark, cold), "block_number") == [(n,) for n in range(20, 35)]
    newest = current_scopes(spark, cold).first().location
    assert len(glob.glob(f"{newest}/**/*.parquet", recursive=True)) >= 4
    for _ in range(2):
        purge_range(spark, hot, "20-39", cold)
    assert keys(read_committed(spark, hot), "block_number") == [(n,) for n in [*range(20), *range(35, 40)]]
    # Blocks that are not in cold storage stay, whatever the range says.
    purge_range(spark, hot, "0-9")
    assert read_committed(spark, hot).filter("block_number < 10").count() == 0


def test_hot_cold_union(spark):
    hot, cold = blocks(spark, [(1, 5, "hot"), (1, 6, "hot")]), blocks(spark, [(1, n, "cold") for n in range(8)])
    for column in (None, "block_number"):
        both = hot_cold_union(hot, cold, ["chain_id", "block_number"], column)
        assert keys(both, "block_number", "block_hash") == [(n, "hot" if n in (5, 6) else "cold") for n in range(8)]
    assert hot_cold_union(blocks(spark, []), cold, ["block_number"], "block_number").count() == 8


def test_export_formats(spark, folder):
    rows = blocks(spark, [(1, n, "x") for n in range(50)])
    for fmt in ("parquet", "json", "csv"):
        for _ in range(2):
            result = export_result(rows, f"{folder}/{fmt}", fmt)
        assert result.row_count == 50 and result.bytes > 0
    with pytest.raises(ValueError):
        export_result(rows, folder, "orc")


def test_rollback_restores_previous_set(spark):
    schema = "seq bigint, dag_name string, dag_version string, dataset_uuid string, dataset_version string"
    history = spark.createDataFrame([(1, "d", "d1", "x", "v1"), (1, "d", "d1", "y", "v1")], schema)
    staged = spark.createDataFrame([("d", "d2", "x", "v2"), ("d", "d2", "z", "v2")], schema.replace("seq bigint, ", ""))
    history = history.unionByName(versions.cutover(history, staged))
    assert keys(versions.current_pointers(history), "dataset_uuid", "dataset_version") == [("x", "v2"), ("y", "v1"), ("z", "v2")]
    history = history.unionByName(versions.rollback(history, "d"))
    assert keys(versions.current_pointers(history), "seq", "dataset_uuid", "dataset_version") == [(3, "x", "v1"), (3, "y", "v1")]


# --- filters, joins, repair -------------------------------------------------------------


def test_edge_where_checks_fields_and_types(spark):
    df = spark.createDataFrame([("critical", 1, True, 0.5), ("info", 1, False, 1.5)], "severity string, chain_id bigint, flag boolean, score double")
    allow = ["severity", "chain_id", "flag", "score"]
    assert filters.edge_where(df, {"severity": ["critical"], "chain_id": 1, "flag": True, "score": 0.5}, allow).count() == 1
    assert filters.edge_where(df, {}, allow).count() == 2
    bad = [{"other": 1}, {"severity": 1}, {"chain_id": "1"}, {"chain_id": True}, {"flag": 1}, {"severity": []}, {"severity": ["a", 1]}]
    for where in [*bad, {"severity": "a' OR '1'='1", "nope": 1}]:
        with pytest.raises(filters.FilterError):
            filters.edge_where(df, where, allow)
    with pytest.raises(filters.FilterError):
        filters.edge_where(df, {"severity": "info"}, ["chain_id"])


def test_cursor_advances_when_filter_matches_nothing(spark):
    df = spark.createDataFrame([(1, "info"), (9, "info")], "n bigint, severity string")
    rows, cursor = filters.read_since(df, "n", 3, {"severity": "critical"}, ["severity"])
    assert rows.count() == 0 and cursor.first().next_cursor == 9
    assert filters.read_since(df, "n", 9)[1].first().next_cursor == 9
    rows, cursor = filters.read_since(df, "n", None)
    assert rows.count() == 2 and cursor.first().next_cursor == 9 and cursor.schema["next_cursor"].dataType == df.schema["n"].dataType
    empty, none = filters.read_since(df.limit(0), "n", None)
    assert empty.count() == 0 and none.first().next_cursor is None


def test_rows_that_arrive_after_the_cursor_was_fixed_wait(spark, folder):
    df = spark.createDataFrame([(1,), (5,)], "n bigint")
    df.write.parquet(f"{folder}/live")
    rows, cursor = filters.read_since(spark.read.parquet(f"{folder}/live"), "n", 0)
    spark.createDataFrame([(7,)], "n bigint").write.mode("append").parquet(f"{folder}/live")
    seen = sorted(r.n for r in rows.select("n").collect())
    assert seen == [1, 5] and cursor.first().next_cursor == 5
    spark.catalog.refreshByPath(f"{folder}/live")
    later, cursor = filters.read_since(spark.read.parquet(f"{folder}/live"), "n", 5)
    assert [r.n for r in later.collect()] == [7] and cursor.first().next_cursor == 7


def test_invalidated_rows_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    spans = [(s, s + rng.randint(0, 300)) for s in (rng.randint(0, 5000) for _ in range(40))]
    schema = "scope string, partition_key string, row_filter struct<gte:bigint,lte:bigint>"
    invalid = [("partition", f"{s}-{e}", None) if i % 2 else ("row_range", None, (s, e)) for i, (s, e) in enumerate(spans)]
    df = blocks(spark, [(1, n, "x") for n in range(0, 6000, 3)] + [(1, 999, "copy")] * 500)
    expected = sorted(n for (n,) in keys(df, "block_number") if any(s <= n <= e for s, e in spans))
    for size in (None, 1, 64, 100_000):
        hit = joins.invalidated_rows(df, spark.createDataFrame(invalid, schema), bucket_size=size)
        assert [n for (n,) in keys(hit, "block_number")] == expected
    open_end = spark.createDataFrame([("row_range", None, (5900, None)), ("row_range", None, (None, 10))], schema)
    assert {n for (n,) in keys(joins.invalidated_rows(df, open_end), "block_number")} == {0, 3, 6, 9, *range(5901, 6000, 3)}
    assert joins.invalidated_rows(df, spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("few", [0, 100])
def test_invalidations_of_chains_and_datasets(spark, monkeypatch, few):
    monkeypatch.setattr(joins, "FEW_BOUNDS", few)
    schema = "id string, dataset_uuid string, dataset_version string, chain_id bigint, scope string, partition_key string, row_filter struct<gte:bigint,lte:bigint>"
    rows = [
        ("chain key", "d", "v1", None, "partition", "1_0-4", None),
        ("every chain", "d", None, None, "row_range", None, (8, 9)),
        ("own chain", "d", "v1", 2, "row_range", None, (2, 3)),
        ("open", "d", "v1", 2, "row_range", None, (18, None)),
        ("other version", "d", "v0", None, "partition", "12-13", None),
        ("other dataset", "e", "v1", None, "row_range", None, (0, 99)),
        ("no range", "d", "v1", None, "partition", "weekly", None),
        ("no bounds", "d", "v1", None, "row_range", None, None),
        ("unknown scope", "d", "v1", None, "table", None, (0, 5)),
    ]
    invalid = spark.createDataFrame(rows, schema)
    df = blocks(spark, [(c, n, "x") for c in (1, 2) for n in range(20)])
    hit = joins.invalidated_rows(df, invalid, dataset_uuid="d", dataset_version="v1")
    want = [(1, n) for n in (0, 1, 2, 3, 4, 8, 9)] + [(2, n) for n in (2, 3, 8, 9, 18, 19)]
    assert keys(hit, "chain_id", "block_number") == want
    usable, others = joins.usable_invalidations(invalid, "d", "v1")
    assert sorted(r.id for r in others.collect()) == ["no bounds", "no range", "unknown scope"]
    assert usable.count() == 4 and others.columns == invalid.columns
    with pytest.raises(ValueError):
        joins.invalidated_rows(df.drop("chain_id"), invalid)


def test_bounds_are_merged_per_chain(spark):
    usable = spark.createDataFrame([(1, 0, 5), (1, 6, 9), (1, 20, None), (1, 30, 40), (2, 3, 4), (None, None, 2)], "chain bigint, first bigint, last bigint")
    got = sorted(((r.chain or 0), r.first, r.last) for r in joins.invalidation_bounds(usable).collect())
    assert got == [(0, joins.LOWEST, 2), (1, 0, 9), (1, 20, joins.HIGHEST), (2, 3, 4)]


def test_recompaction_requests_can_be_reprocessed(spark):
    checked = spark.createDataFrame([(1, 3, "a", "b", "mismatch"), (1, 4, "a", "a", "match"), (2, 17, None, "c", "missing_cold")],
                                    "chain_id bigint, block_number bigint, cold_hash string, canonical_hash string, status string")
    requests = joins.recompaction_requests(checked, 10, "d", "v")
    df = blocks(spark, [(c, n, "x") for c in (1, 2) for n in range(30)])
    hit = joins.invalidated_rows(df, requests, dataset_uuid="d", dataset_version="v")
    assert keys(hit, "chain_id", "block_number") == [(1, n) for n in range(10)] + [(2, n) for n in range(10, 20)]
    again = joins.recompaction_requests(checked.filter("block_number < 10"), 10, "d", "v")
    assert {r.id for r in again.collect()} < {r.id for r in requests.collect()}


def test_rows_outside_the_given_scopes_are_not_lost(spark, folder):
    replace_scopes(scoped(spark, [(1, "a"), (11, "a")]), folder)
    only = spark.createDataFrame([("0-9",)], "partition_key string")
    moved = spark.createDataFrame([(1, 12, "b", "10-19")], "chain_id bigint, block_number bigint, block_hash string, partition_key string")
    replace_scopes(moved, folder, scopes=only)
    assert [(r.block_number, r.block_hash) for r in read_committed(spark, folder).collect()] == [(12, "b")]


@pytest.mark.parametrize("name", ["a:b", "", None, "x/y", "k=v"])
def test_bad_scope_names_fail_before_the_commit(spark, folder, name):
    good = scoped(spark, [(1, "a")])
    replace_scopes(good, folder)
    with pytest.raises(ValueError):
        replace_scopes(good.withColumn("partition_key", F.lit(name).cast("string")), folder)
    assert read_committed(spark, folder).count() == 1 and commit_log(spark, folder).count() == 1


def test_closure_of_a_long_chain(spark):
    edges = spark.createDataFrame([(n, n + 1) for n in range(19)] + [(19, 0)], "src int, dst int")
    got = downstream_closure(edges, spark.createDataFrame([(0,)], "node int"))
    assert sorted(map(tuple, got.collect())) == [(n, n) for n in range(20)]


def test_integrity_check_with_copies(spark):
    cold = blocks(spark, [(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, 2, "x"), (1, 3, None), (1, 5, "e")])
    canonical = blocks(spark, [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (1, 4, "d")])
    got = dict(keys(joins.integrity_check(cold, canonical), "block_number", "status"))
    assert got == {1: "match", 2: "mismatch", 3: "mismatch", 4: "missing_cold", 5: "missing_canonical"}


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_block_gaps_do_not_depend_on_buckets(spark, size):
    present = [0, 1, 2, 5, 6, 14, 15, 40, 40, 41]
    gaps = block_gaps(blocks(spark, [(c, n, "x") for c in (1, 2) for n in present]), bucket_size=size)
    assert keys(gaps, "chain_id", "gap_start", "gap_end") == [(c, s, e) for c in (1, 2) for s, e in ((3, 4), (7, 13), (16, 39))]


def test_detect_reorg(spark):
    stored = blocks(spark, [(1, n, f"a{n}") for n in range(990, 1006)] + [(2, n, "s") for n in range(5)])
    incoming = blocks(spark, [(1, n, f"b{n}") for n in range(995, 1004)] + [(2, 4, "s"), (2, 5, "s")])
    assert [tuple(r) for r in detect_reorg(stored, incoming).collect()] == [(1, 995, 1005, 1003, 9)]


def test_visible_rows(spark):
    rows = [("o", "me", "private", 1), ("o", "you", "private", 2), ("o", "you", "org", 3), ("o", "you", "role:ops", 4), ("o", "you", "role:fin", 5), ("p", "me", "org", 6)]
    df = spark.createDataFrame(rows, "org_id string, user_id string, visibility string, id int")
    members = spark.createDataFrame([("o", "ops", "me"), ("o", "ops", "me"), ("o", "fin", "you"), ("p", "fin", "me")], "org_id string, role_slug string, user_id string")
    assert keys(filters.visible_rows(df, "o", "me", members), "id") == [(1,), (3,), (4,)]


def test_reprocess_replaces_only_hit_scopes(spark, folder):
    data = blocks(spark, [(1, n, "old") for n in range(50)])
    start = F.floor(F.col("block_number") / 10) * 10
    scope = F.concat(start.cast("string"), F.lit("-"), (start + 9).cast("string"))
    replace_scopes(data.withColumn("partition_key", scope), folder)
    schema = "id string, dataset_uuid string, scope string, partition_key string, row_filter struct<gte:bigint,lte:bigint>, processed_by array<string>"
    invalid = spark.createDataFrame([("i1", "d", "row_range", None, (15, 16), None), ("i2", "d", "partition", "40-49", None, ["j"])], schema)
    edges = spark.createDataFrame([("d", "j"), ("d", "k")], "dataset_uuid string, job_id string")
    fresh = data.withColumn("block_hash", F.lit("new"))
    marked, downstream = incremental.reprocess_invalidations(spark, invalid, edges, "j", fresh, lambda d: d, folder, "out", "v", scope)
    got = read_committed(spark, folder)
    assert {n for (n,) in keys(got.filter("block_hash = 'new'"), "block_number")} == set(range(10, 20)) and got.count() == 50
    assert keys(downstream, "partition_key") == [("10-19",)]
    assert sorted((r.id, tuple(r.processed_by)) for r in marked.collect()) == [("i1", ("j",)), ("i2", ("j",))]
    assert joins.open_invalidations(marked, edges.filter("job_id = 'j'")).count() == 0
    # A later correction of the same scope is another invalidation; one that names no rows stays open.
    later = spark.createDataFrame([("i3", "d", "partition", "10-19", None, None), ("i4", "d", "partition", "weekly", None, None)], schema)
    again = incremental.reprocess_invalidations(spark, later, edges, "j", fresh, lambda d: d, folder, "out", "v", scope)
    assert keys(again[1], "partition_key") == keys(downstream, "partition_key")
    assert not {r.id for r in again[1].collect()} & {r.id for r in downstream.collect()}
    assert sorted((r.id, tuple(r.processed_by)) for r in again[0].collect()) == [("i3", ("j",)), ("i4", ())]


def test_run_incremental_rejects_unknown_mode(spark):
    with pytest.raises(ValueError):
        incremental.run_incremental("other", spark, None, None, "")


def test_shared_dir_is_taken_from_the_session(spark):
    from blockloom.session import scratch_path

    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
