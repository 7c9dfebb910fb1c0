"""Chain-shaped views over the benchmark tables, and the same views as SQL.

orders are blocks, lineitem transfers and validator duties, events alert events and head
observations, supplier addresses with their nation as label, customer sync jobs. Every view
covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions.ids import block_hash

NOW = "2024-01-30 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at(moment: str):
    return F.lit(moment).cast("timestamp_ntz")


def text(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), value.cast("string"))


# --- blocks and transfers ---------------------------------------------------------------

BLOCKS_SQL = """blocks AS (
  SELECT o_custkey % 3 AS chain_id, o_orderkey AS block_number,
         printf('0x%016x', o_orderkey) AS block_hash, o_orderdate AS block_time
  FROM orders)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 3).alias("chain_id"),
        F.col("o_orderkey").alias("block_number"),
        block_hash("o_orderkey").alias("block_hash"),
        F.col("o_orderdate").alias("block_time"),
    )


TRANSFERS_SQL = """transfers AS (
  SELECT l_orderkey AS block_number, l_linenumber AS log_index, l_suppkey AS address,
         l_partkey AS token, l_extendedprice AS value, l_shipdate AS ts
  FROM lineitem)"""


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("block_number"),
        F.col("l_linenumber").alias("log_index"),
        F.col("l_suppkey").alias("address"),
        F.col("l_partkey").alias("token"),
        F.col("l_extendedprice").alias("value"),
        F.col("l_shipdate").alias("ts"),
    )


LABELS_SQL = """labels_dim AS (
  SELECT s_suppkey AS address, n_name AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def labels_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return table(spark, sf_dir, "supplier").join(nation, "s_nationkey").select(
        F.col("s_suppkey").alias("address"), F.col("n_name").alias("label")
    )


# --- alerts -----------------------------------------------------------------------------

ALERTS_SQL = """alerts AS (
  SELECT event_id AS alert_event_id, 'org-' || (user_id % 5) AS org_id, 'def-' || (user_id % 50) AS alert_definition_id,
         CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'warning' ELSE 'info' END AS severity,
         user_id % 3 AS chain_id, ts AS event_time, event_id AS block_number
  FROM events)"""


def severity():
    return (
        F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "warning").otherwise("info")
    )


def as_alerts(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("alert_event_id"),
        text("org-", F.col("user_id") % 5).alias("org_id"),
        text("def-", F.col("user_id") % 50).alias("alert_definition_id"),
        severity().alias("severity"),
        (F.col("user_id") % 3).alias("chain_id"),
        F.col("ts").alias("event_time"),
        F.col("event_id").alias("block_number"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_alerts(table(spark, sf_dir, "events"))


# Definitions: one per (org, definition) from supplier, with one to three channels.
DEFINITIONS_SQL = """definitions AS (
  SELECT DISTINCT 'def-' || (s_suppkey % 50) AS id, 'org-' || (s_suppkey % 5) AS org_id,
         s_suppkey % 10 <> 7 AS enabled,
         CASE s_suppkey % 3 WHEN 0 THEN ['slack'] WHEN 1 THEN ['slack', 'email'] ELSE ['email', 'pagerduty', 'email'] END AS channels
  FROM (SELECT s_suppkey % 50 AS s_suppkey FROM supplier))"""


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey") % 50
    channels = (
        F.when(key % 3 == 0, F.array(F.lit("slack")))
        .when(key % 3 == 1, F.array(F.lit("slack"), F.lit("email")))
        .otherwise(F.array(F.lit("email"), F.lit("pagerduty"), F.lit("email")))
    )
    return table(spark, sf_dir, "supplier").select(
        text("def-", key).alias("id"), text("org-", key % 5).alias("org_id"), (key % 10 != 7).alias("enabled"),
        channels.alias("channels"),
    ).distinct()


# Deliveries: critical events on two channels, warnings on one.
DELIVERIES_SQL = """deliveries AS (
  SELECT event_id AS alert_event_id, channel,
         CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'sending' WHEN 2 THEN 'retrying' WHEN 3 THEN 'delivered' ELSE 'failed' END AS status,
         CAST(event_id % 13 AS INTEGER) AS attempt
  FROM events, unnest(CASE event_type WHEN 'error' THEN ['pagerduty', 'slack'] WHEN 'purchase' THEN ['slack'] ELSE [] END) AS u(channel))"""


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    channels = F.when(F.col("event_type") == "error", F.array(F.lit("pagerduty"), F.lit("slack"))).when(
        F.col("event_type") == "purchase", F.array(F.lit("slack"))
    )
    names = F.array(*[F.lit(s) for s in ("pending", "sending", "retrying", "delivered", "failed")])
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("alert_event_id"),
        F.explode(channels).alias("channel"),
        F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("status"),
        (F.col("event_id") % 13).cast("int").alias("attempt"),
    )


# --- sync state -------------------------------------------------------------------------

JOBS_SQL = """jobs AS (
  SELECT 'job-' || c_custkey AS job_id, 'org-' || (c_nationkey % 5) AS org_id, c_custkey % 3 AS chain_id,
         c_custkey % 10 <> 9 AS enabled,
         CASE WHEN c_custkey % 4 < 2 THEN 'fixed_target' WHEN c_custkey % 20 = 3 THEN 'paused' ELSE 'follow_head' END AS mode,
         c_custkey * 10 AS from_block,
         CASE WHEN c_custkey % 4 < 2 AND c_custkey % 8 <> 0 THEN c_custkey * 10 + 50 * (c_custkey % 100) + 7 END AS to_block,
         CASE WHEN c_custkey % 12 <> 2 THEN 5 END AS tail_lag,
         CASE WHEN c_custkey % 12 <> 6 THEN CAST(7200 * (c_custkey % 5) AS INTEGER) END AS max_head_age_seconds
  FROM customer)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    fixed = key % 4 < 2
    return table(spark, sf_dir, "customer").select(
        text("job-", key).alias("job_id"),
        text("org-", F.col("c_nationkey") % 5).alias("org_id"),
        (key % 3).alias("chain_id"),
        (key % 10 != 9).alias("enabled"),
        F.when(fixed, "fixed_target").when(key % 20 == 3, "paused").otherwise("follow_head").alias("mode"),
        (key * 10).alias("from_block"),
        F.when(fixed & (key % 8 != 0), key * 10 + 50 * (key % 100) + 7).alias("to_block"),
        F.when(key % 12 != 2, F.lit(5).cast("bigint")).alias("tail_lag"),
        F.when(key % 12 != 6, (7200 * (key % 5)).cast("int")).alias("max_head_age_seconds"),
    )


STREAMS_SQL = """streams AS (
  SELECT 'job-' || c_custkey AS job_id, dataset_key, 'pool-' || (c_custkey % 4) AS rpc_pool,
         'cryo_ingest.' || dataset_key || ':v1' AS config_hash, dataset_key AS cryo_dataset_name,
         CASE WHEN dataset_key = 'blocks' THEN 10 END AS chunk_size,
         CASE WHEN dataset_key = 'blocks' THEN c_custkey % 6 END AS max_inflight
  FROM customer, (VALUES ('blocks'), ('logs')) AS k(dataset_key))"""


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_blocks = F.col("dataset_key") == "blocks"
    keys = F.array(F.lit("blocks"), F.lit("logs"))
    return (
        table(spark, sf_dir, "customer")
        .select("c_custkey", F.explode(keys).alias("dataset_key"))
        .select(
            text("job-", F.col("c_custkey")).alias("job_id"),
            "dataset_key",
            text("pool-", F.col("c_custkey") % 4).alias("rpc_pool"),
            F.concat(F.lit("cryo_ingest."), "dataset_key", F.lit(":v1")).alias("config_hash"),
            F.col("dataset_key").alias("cryo_dataset_name"),
            F.when(is_blocks, F.lit(10).cast("bigint")).alias("chunk_size"),
            F.when(is_blocks, F.col("c_custkey") % 6).alias("max_inflight"),
        )
    )


CURSORS_SQL = """cursors AS (
  SELECT 'job-' || c_custkey AS job_id, dataset_key, c_custkey * 10 + 10 * (c_custkey % 3) AS next_block
  FROM customer, (VALUES ('blocks'), ('logs')) AS k(dataset_key) WHERE c_custkey % 7 <> 0)"""


def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.array(F.lit("blocks"), F.lit("logs"))
    return table(spark, sf_dir, "customer").filter("c_custkey % 7 <> 0").select(
        text("job-", F.col("c_custkey")).alias("job_id"),
        F.explode(keys).alias("dataset_key"),
        (F.col("c_custkey") * 10 + 10 * (F.col("c_custkey") % 3)).alias("next_block"),
    )


RANGES_SQL = """ranges AS (
  SELECT 'job-' || o_custkey AS job_id, 'blocks' AS dataset_key,
         o_custkey * 10 + 10 * (o_orderkey % 20) AS range_start, o_custkey * 10 + 10 * (o_orderkey % 20) + 10 AS range_end,
         min(CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'scheduled' ELSE 'running' END) AS status
  FROM orders GROUP BY ALL)"""


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("o_custkey") * 10 + 10 * (F.col("o_orderkey") % 20)
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "scheduled").otherwise("running")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(
            text("job-", F.col("o_custkey")).alias("job_id"),
            F.lit("blocks").alias("dataset_key"),
            start.alias("range_start"),
            (start + 10).alias("range_end"),
        )
        .agg(F.min(status).alias("status"))
    )


HEADS_SQL = """observations AS (
  SELECT 'org-' || (user_id % 5) AS org_id, user_id % 3 AS chain_id, 'pool-' || (event_id % 3) AS rpc_pool,
         event_id * 3 AS head_block, ts AS observed_at FROM events),
heads AS (
  SELECT org_id, chain_id, rpc_pool, max(observed_at) AS observed_at, arg_max(head_block, observed_at) AS head_block
  FROM observations GROUP BY ALL)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        text("org-", F.col("user_id") % 5).alias("org_id"),
        (F.col("user_id") % 3).alias("chain_id"),
        text("pool-", F.col("event_id") % 3).alias("rpc_pool"),
        (F.col("event_id") * 3).alias("head_block"),
        F.col("ts").alias("observed_at"),
    )


# --- invalidations ----------------------------------------------------------------------

# One per part: a short row range or a partition key, scattered over the block numbers.
INVALIDATIONS_SQL = """invalidations AS (
  SELECT 'inv-' || p_partkey AS id, 'ds-' || (p_partkey % 7) AS dataset_uuid,
         CASE WHEN p_partkey % 2 = 0 THEN 'partition' ELSE 'row_range' END AS scope,
         p_partkey * 37 AS first, p_partkey * 37 + p_size AS last,
         CASE WHEN p_partkey % 3 = 0 THEN 'reorg' ELSE 'correction' END AS reason,
         CASE p_partkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['job-a'] WHEN 2 THEN ['job-a', 'job-b'] END AS processed_by
  FROM part)"""


def invalidations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    first, last = key * 37, key * 37 + F.col("p_size")
    by_partition = key % 2 == 0
    processed = (
        F.when(key % 4 == 0, F.array().cast("array<string>"))
        .when(key % 4 == 1, F.array(F.lit("job-a")))
        .when(key % 4 == 2, F.array(F.lit("job-a"), F.lit("job-b")))
    )
    return table(spark, sf_dir, "part").select(
        text("inv-", key).alias("id"),
        text("ds-", key % 7).alias("dataset_uuid"),
        F.lit("v1").alias("dataset_version"),
        F.when(by_partition, "partition").otherwise("row_range").alias("scope"),
        F.when(by_partition, F.concat_ws("-", first.cast("string"), last.cast("string"))).alias("partition_key"),
        F.when(~by_partition, F.struct(first.alias("gte"), last.alias("lte"))).alias("row_filter"),
        F.when(key % 3 == 0, "reorg").otherwise("correction").alias("reason"),
        processed.alias("processed_by"),
    )


# Dependents: job-a reads every dataset, job-b the even ones.
EDGES_SQL = """edges AS (
  SELECT DISTINCT 'ds-' || (p_partkey % 7) AS dataset_uuid, job_id
  FROM part, (VALUES ('job-a'), ('job-b')) AS j(job_id) WHERE job_id = 'job-a' OR p_partkey % 7 % 2 = 0)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    dataset = F.col("p_partkey") % 7
    both = F.when(dataset % 2 == 0, F.array(F.lit("job-a"), F.lit("job-b"))).otherwise(F.array(F.lit("job-a")))
    return table(spark, sf_dir, "part").select(
        text("ds-", dataset).alias("dataset_uuid"), F.explode(both).alias("job_id")
    ).distinct()


# --- query ledger -----------------------------------------------------------------------

# One run per event; the status comes from the event type.
RUNS_SQL = """runs AS (
  SELECT 'q-' || event_id AS id, 'org-' || (user_id % 5) AS org_id,
         CASE WHEN event_id % 2 = 0 THEN 'user-' || user_id END AS user_id,
         CASE WHEN event_id % 2 = 1 THEN 'task-' || event_id END AS task_id,
         'ds-' || (user_id % 7) AS dataset_id, ts AS query_time,
         CASE WHEN event_type = 'error' THEN 'Failed' ELSE 'Succeeded' END AS status,
         CASE WHEN event_type = 'error' THEN 'E' || (event_id % 4) END AS error_code,
         event_id % 1000 AS row_count, event_id % 1000 * 8 AS bytes, CAST(round(value * 100) AS BIGINT) AS duration_ms
  FROM events)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        text("q-", event).alias("id"),
        text("org-", F.col("user_id") % 5).alias("org_id"),
        F.when(event % 2 == 0, text("user-", F.col("user_id"))).alias("user_id"),
        F.when(event % 2 == 1, text("task-", event)).alias("task_id"),
        text("ds-", F.col("user_id") % 7).alias("dataset_id"),
        F.col("ts").alias("query_time"),
        F.when(failed, "Failed").otherwise("Succeeded").alias("status"),
        F.when(failed, text("E", event % 4)).alias("error_code"),
        (event % 1000).alias("row_count"),
        (event % 1000 * 8).alias("bytes"),
        F.round(F.col("value") * 100).cast("bigint").alias("duration_ms"),
    )


def with_sql(*views: str, select: str) -> str:
    return "WITH " + ",\n".join(views) + "\n" + select
