"""Plan shape: what must hold when the tables are far larger than here."""

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

import __spark_entry__ as entry
from blockloom.operators import filters, joins, windows
from blockloom.session import broadcast_if_bounded, is_bounded
from blockloom.workloads import views as v

QUERIES = entry.queries()
# Queries whose result frame is a scan of what they wrote are covered by their own tests.
DECLARATIVE = [
    "enrich_labels", "combine_offchain", "sync_status", "alert_status", "missing_partitions", "invalidated_rows", "integrity_check",
    "orphan_refs", "route_alerts", "open_invalidations", "daily_summary", "duplicate_keys", "validator_stats", "provider_quorum",
    "block_gaps", "detect_reorg", "canonical_blocks", "liveliness_history", "plan_ranges", "complete_ranges", "range_aggregate",
    "hot_cold_union", "manifest_audit", "register_versions", "cutover", "delivery_outcomes", "finalized_only", "visible_rows",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", DECLARATIVE)
def test_no_cross_join_no_single_partition_no_row_udf(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Exchange SinglePartition", "BatchEvalPython"):
        assert bad not in text


def test_latest_row_is_reduced_before_the_shuffle(spark):
    text = plan(QUERIES["canonical_blocks"](spark, SF_DIR))
    below = text[text.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_filters_and_columns_reach_the_scan(spark):
    rows = filters.row_range(v.blocks(spark, SF_DIR), {"block_number": {"gte": 10, "lte": 20}}).select("block_number")
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,10)" in text and "ReadSchema: struct<o_orderkey:bigint>" in text


def test_invalidation_bounds_reach_the_scan(spark, monkeypatch):
    schema = "scope string, partition_key string, row_filter struct<gte:bigint,lte:bigint>"
    invalid = spark.createDataFrame([("partition", "10-20", None), ("row_range", None, (500, 600))], schema)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(joins.invalidated_rows(v.blocks(spark, SF_DIR), invalid))
    assert "GreaterThanOrEqual(o_orderkey,10)" in text and "LessThanOrEqual(o_orderkey,600)" in text and "Join" not in text
    monkeypatch.setattr(joins, "FEW_BOUNDS", 1)
    text = plan(joins.invalidated_rows(v.blocks(spark, SF_DIR), invalid))
    assert "GreaterThanOrEqual(o_orderkey,10)" in text and "LessThanOrEqual(o_orderkey,600)" in text and "LeftSemi" in text


def test_wide_rows_are_not_broadcast(spark):
    wide = spark.range(10).selectExpr("id", "repeat('x', 1000) AS text")
    assert is_bounded(wide, 100) and not is_bounded(wide, 100, max_bytes=5000) and not is_bounded(wide, 5)


def test_broadcast_needs_a_counted_bound(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small, large = spark.range(50), spark.range(5000)
        left = spark.range(100)
        assert "BroadcastHashJoin" in plan(left.join(broadcast_if_bounded(small, 100), "id"))
        assert "SortMergeJoin" in plan(left.join(broadcast_if_bounded(large, 100), "id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_full_outer_is_one_shuffle(spark):
    blocks = v.blocks(spark, SF_DIR)
    assert plan(joins.integrity_check(blocks, blocks)).count("Exchange hashpartitioning") == 1


def test_chain_window_sees_bucket_edges_only(spark):
    # One chain: the whole-chain window must come after an aggregation per bucket.
    blocks = v.blocks(spark, SF_DIR).withColumn("chain_id", F.lit(1).cast("bigint"))
    text = plan(windows.block_gaps(blocks, bucket_size=100))
    assert "Window" in text and "CartesianProduct" not in text
