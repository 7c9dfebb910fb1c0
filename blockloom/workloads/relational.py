"""Filter, join, aggregate, window and set queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from blockloom.operators import aggregates, filters, joins, sets, windows
from blockloom.plans.epochs import refresh_validator_stats
from blockloom.session import scratch_path
from blockloom.sinks.scopes import read_committed
from blockloom.workloads import views as v
from blockloom.workloads.registry import query
from blockloom.workloads.views import at, table, text, with_sql

# --- filters ----------------------------------------------------------------------------


@query(
    "edge_where",
    with_sql(v.ALERTS_SQL, select="SELECT * FROM alerts WHERE severity IN ('warning', 'critical') AND chain_id = 1"),
)
def edge_where(spark, sf_dir):
    where = {"severity": ["warning", "critical"], "chain_id": 1}
    return filters.edge_where(v.alerts(spark, sf_dir), where, ["severity", "chain_id"])


@query("row_range", with_sql(v.BLOCKS_SQL, select="SELECT * FROM blocks WHERE block_number BETWEEN 700 AND 1200"))
def row_range(spark, sf_dir):
    return filters.row_range(v.blocks(spark, sf_dir), {"block_number": {"gte": 700, "lte": 1200}})


@query(
    "read_since",
    with_sql(
        v.ALERTS_SQL,
        select="""SELECT alert_event_id, severity, (SELECT max(alert_event_id) FROM alerts) AS next_cursor
FROM alerts WHERE alert_event_id > 400 AND severity = 'critical'""",
    ),
)
def read_since(spark, sf_dir):
    rows, cursor = filters.read_since(
        v.alerts(spark, sf_dir), "alert_event_id", 400, {"severity": "critical"}, ["severity"]
    )
    return rows.select("alert_event_id", "severity").withColumn("next_cursor", F.lit(cursor.first().next_cursor))


@query(
    "finalized_only",
    with_sql(
        v.BLOCKS_SQL,
        select="""SELECT b.* FROM blocks b JOIN (SELECT chain_id, max(block_number) AS tip FROM blocks GROUP BY chain_id) t
  ON b.chain_id = t.chain_id WHERE block_number <= tip - 100""",
    ),
)
def finalized_only(spark, sf_dir):
    return filters.finalized_only(v.blocks(spark, sf_dir), 100)


@query(
    "fresh_only",
    with_sql(v.ALERTS_SQL, select=f"SELECT * FROM alerts WHERE event_time >= TIMESTAMP '{v.NOW}' - INTERVAL 7 DAY"),
)
def fresh_only(spark, sf_dir):
    return filters.fresh_only(v.alerts(spark, sf_dir), at(v.NOW), 7 * 86400)


_VISIBLE_SQL = """WITH rows AS (
  SELECT c_custkey, 'org-' || (c_nationkey % 5) AS org_id, 'user-' || (c_custkey % 100) AS user_id,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'private' WHEN 'MACHINERY' THEN 'org' WHEN 'HOUSEHOLD' THEN 'role:r0' WHEN 'FURNITURE' THEN 'role:r1' ELSE 'role:r2' END AS visibility
  FROM customer),
memberships AS (SELECT 'org-' || (s_suppkey % 5) AS org_id, 'r' || (s_suppkey % 3) AS role_slug, 'user-' || (s_suppkey % 10) AS user_id FROM supplier)
SELECT * FROM rows WHERE org_id = 'org-1' AND (visibility = 'org' OR (visibility = 'private' AND user_id = 'user-6')
  OR visibility IN (SELECT 'role:' || role_slug FROM memberships WHERE org_id = 'org-1' AND user_id = 'user-6'))"""


@query(
    "visible_to",
    _VISIBLE_SQL.replace(
        "SELECT * FROM rows WHERE org_id = 'org-1' AND (visibility = 'org' OR (visibility = 'private' AND user_id = 'user-6')\n"
        "  OR visibility IN (SELECT 'role:' || role_slug FROM memberships WHERE org_id = 'org-1' AND user_id = 'user-6'))",
        """, principals AS (SELECT DISTINCT org_id, user_id AS reader FROM memberships)
SELECT r.*, reader FROM rows r JOIN principals p ON r.org_id = p.org_id WHERE visibility = 'org' OR (visibility = 'private' AND r.user_id = reader)
  OR EXISTS (SELECT 1 FROM memberships m WHERE m.org_id = r.org_id AND m.user_id = reader AND visibility = 'role:' || role_slug)""",
    ),
)
def visible_to(spark, sf_dir):
    rows, memberships = _visibility(spark, sf_dir)
    return filters.visible_to(rows, memberships.select("org_id", "user_id"), memberships)


@query("visible_rows", _VISIBLE_SQL)
def visible_rows(spark, sf_dir):
    rows, memberships = _visibility(spark, sf_dir)
    return filters.visible_rows(rows, "org-1", "user-6", memberships)


def _visibility(spark, sf_dir):
    segment, key = F.col("c_mktsegment"), F.col("s_suppkey")
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey",
        text("org-", F.col("c_nationkey") % 5).alias("org_id"),
        text("user-", F.col("c_custkey") % 100).alias("user_id"),
        F.when(segment == "BUILDING", "private")
        .when(segment == "MACHINERY", "org")
        .when(segment == "HOUSEHOLD", "role:r0")
        .when(segment == "FURNITURE", "role:r1")
        .otherwise("role:r2")
        .alias("visibility"),
    )
    memberships = table(spark, sf_dir, "supplier").select(
        text("org-", key % 5).alias("org_id"), text("r", key % 3).alias("role_slug"), text("user-", key % 10).alias("user_id")
    )
    return rows, memberships


@query(
    "sample_blocks",
    with_sql(
        v.BLOCKS_SQL,
        select="SELECT * FROM blocks WHERE CAST('0x' || substr(md5(CAST(block_number AS VARCHAR)), 1, 8) AS BIGINT) < 429496729",
    ),
)
def sample_blocks(spark, sf_dir):
    return filters.sample_blocks(v.blocks(spark, sf_dir), 0.1)


@query("select_columns", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def select_columns(spark, sf_dir):
    wanted = ["c_custkey", "c_name", "c_nationkey", "c_acctbal"]
    return filters.select_columns(table(spark, sf_dir, "customer"), wanted, ["c_name", "c_acctbal"], ["c_acctbal"])


# --- joins ------------------------------------------------------------------------------


@query(
    "enrich_labels",
    with_sql(
        v.TRANSFERS_SQL, v.LABELS_SQL,
        select="""SELECT t.*, a.label AS address_label, c.label AS counterparty_label
FROM (SELECT *, token % 250 AS counterparty FROM transfers) t
LEFT JOIN labels_dim a ON t.address = a.address LEFT JOIN labels_dim c ON t.counterparty = c.address""",
    ),
)
def enrich_labels(spark, sf_dir):
    rows = v.transfers(spark, sf_dir).withColumn("counterparty", F.col("token") % 250)
    return joins.enrich_labels(rows, v.labels_dim(spark, sf_dir), ["address", "counterparty"])


@query(
    "combine_offchain",
    with_sql(
        v.TRANSFERS_SQL,
        select="""SELECT t.*, p_name AS token_name, p_retailprice AS price, value / p_retailprice AS units
FROM transfers t LEFT JOIN part ON token = p_partkey""",
    ),
)
def combine_offchain(spark, sf_dir):
    feed = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("token"), F.col("p_name").alias("token_name"), F.col("p_retailprice").alias("price")
    )
    return joins.combine_offchain(v.transfers(spark, sf_dir), feed, ["token"]).withColumn(
        "units", F.col("value") / F.col("price")
    )


@query(
    "sync_status",
    with_sql(
        v.JOBS_SQL, v.STREAMS_SQL, v.CURSORS_SQL, v.RANGES_SQL, v.HEADS_SQL,
        select=f"""SELECT s.job_id, s.dataset_key, s.rpc_pool, c.next_block, coalesce(r.inflight, 0) AS inflight, coalesce(r.completed, 0) AS completed,
  CASE WHEN mode = 'follow_head' THEN head_block END AS observed_head,
  CASE WHEN mode = 'follow_head' AND head_block IS NOT NULL AND greatest(0, date_sub('second', observed_at, TIMESTAMP '{v.NOW}')) <= coalesce(max_head_age_seconds, 0)
    THEN greatest(from_block, head_block + 1 - coalesce(tail_lag, 0)) END AS eligible_end
FROM streams s JOIN jobs j ON s.job_id = j.job_id JOIN cursors c ON c.job_id = s.job_id AND c.dataset_key = s.dataset_key
LEFT JOIN (SELECT job_id, dataset_key, count(*) FILTER (status <> 'completed') AS inflight, count(*) FILTER (status = 'completed') AS completed
  FROM ranges GROUP BY ALL) r ON r.job_id = s.job_id AND r.dataset_key = s.dataset_key
LEFT JOIN heads h ON h.org_id = j.org_id AND h.chain_id = j.chain_id AND h.rpc_pool = s.rpc_pool""",
    ),
)
def sync_status(spark, sf_dir):
    return joins.sync_status(
        v.jobs(spark, sf_dir), v.streams(spark, sf_dir), v.cursors(spark, sf_dir), v.ranges(spark, sf_dir),
        v.observations(spark, sf_dir), at(v.NOW),
    )


@query(
    "alert_status",
    with_sql(
        v.ALERTS_SQL, v.DELIVERIES_SQL,
        select="""SELECT a.*, count(d.channel) AS deliveries, count(*) FILTER (d.status = 'pending') AS pending,
  count(*) FILTER (d.status = 'sending') AS sending, count(*) FILTER (d.status = 'retrying') AS retrying,
  count(*) FILTER (d.status = 'delivered') AS delivered, count(*) FILTER (d.status = 'failed') AS failed,
  CAST(coalesce(max(attempt), 0) AS BIGINT) AS max_attempt
FROM alerts a LEFT JOIN deliveries d ON a.alert_event_id = d.alert_event_id GROUP BY ALL""",
    ),
)
def alert_status(spark, sf_dir):
    return joins.alert_status(v.alerts(spark, sf_dir), v.deliveries(spark, sf_dir))


@query(
    "missing_partitions",
    """SELECT DISTINCT 'v' || (o_custkey % 3) AS dataset_version, (o_orderkey // 10 * 10) || '-' || (o_orderkey // 10 * 10 + 9) AS partition_key
FROM orders WHERE ('v' || (o_custkey % 3), o_orderkey // 10) NOT IN (SELECT 'v' || (l_suppkey % 3), l_orderkey // 10 FROM lineitem WHERE l_returnflag = 'R')""",
)
def missing_partitions(spark, sf_dir):
    from blockloom.functions.ids import partition_key

    def keyed(df, version, block):
        start = F.floor(F.col(block) / 10) * 10
        return df.select(text("v", F.col(version) % 3).alias("dataset_version"), partition_key(start, start + 10).alias("partition_key"))

    upstream = keyed(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").distinct()
    done = keyed(table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'"), "l_suppkey", "l_orderkey")
    return joins.missing_partitions(upstream, done)


@query(
    "invalidated_rows",
    with_sql(
        v.BLOCKS_SQL, v.INVALIDATIONS_SQL,
        select="SELECT * FROM blocks b WHERE EXISTS (SELECT 1 FROM invalidations i WHERE b.block_number BETWEEN i.first AND i.last)",
    ),
)
def invalidated_rows(spark, sf_dir):
    return joins.invalidated_rows(v.blocks(spark, sf_dir), v.invalidations(spark, sf_dir))


# Cold blocks lack every 101st number and hold a wrong hash on every 97th; the canonical
# side lacks every 89th.
_CHECKED_SQL = """checked AS (
  SELECT chain_id, block_number,
    CASE WHEN block_number % 101 <> 0 THEN CASE WHEN block_number % 97 = 0 THEN 'bad' ELSE block_hash END END AS cold_hash,
    CASE WHEN block_number % 89 <> 0 THEN block_hash END AS canonical_hash,
    CASE WHEN block_number % 101 = 0 THEN 'missing_cold' WHEN block_number % 89 = 0 THEN 'missing_canonical'
      WHEN block_number % 97 = 0 THEN 'mismatch' ELSE 'match' END AS status
  FROM blocks WHERE block_number % 101 <> 0 OR block_number % 89 <> 0)"""


def _checked(spark, sf_dir):
    number = F.col("block_number")
    cold = v.blocks(spark, sf_dir).filter(number % 101 != 0)
    cold = cold.withColumn("block_hash", F.when(number % 97 == 0, "bad").otherwise(F.col("block_hash")))
    return joins.integrity_check(cold, v.blocks(spark, sf_dir).filter(number % 89 != 0))


@query("integrity_check", with_sql(v.BLOCKS_SQL, _CHECKED_SQL, select="SELECT * FROM checked"))
def integrity_check(spark, sf_dir):
    return _checked(spark, sf_dir)


@query(
    "recompaction_requests",
    with_sql(
        v.BLOCKS_SQL, _CHECKED_SQL,
        select="""SELECT 'ds' AS dataset_uuid, 'v1' AS dataset_version, chain_id, 'partition' AS scope,
  (block_number // 50 * 50) || '-' || (block_number // 50 * 50 + 49) AS partition_key, 'correction' AS reason, count(*) AS bad_blocks,
  0 AS processed, 1 AS same_id FROM checked WHERE status <> 'match' GROUP BY ALL""",
    ),
)
def recompaction_requests(spark, sf_dir):
    found = joins.recompaction_requests(_checked(spark, sf_dir), 50, "ds", "v1")
    same = F.count("*").over(Window.partitionBy("id"))  # ids are hashes that SQL cannot make; each must be one row's
    return found.withColumns({"processed": F.size("processed_by"), "same_id": same}).drop("id", "row_filter", "processed_by")


@query("orphan_refs", "SELECT * FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def orphan_refs(spark, sf_dir):
    known = table(spark, sf_dir, "part").filter("p_size > 5")
    return joins.orphan_refs(table(spark, sf_dir, "lineitem"), known, "l_partkey", "p_partkey")


ROUTED_SQL = f"""routed AS (
  SELECT DISTINCT a.org_id, alert_event_id, channel, 'pending' AS status, 0 AS attempt, TIMESTAMP '{v.NOW}' AS next_attempt_at,
    sha256('{{"org_id":"' || a.org_id || '","alert_event_id":' || alert_event_id || ',"channel":"' || channel || '"}}') AS id
  FROM (SELECT a.*, channels FROM alerts a JOIN definitions d ON d.id = a.alert_definition_id AND d.org_id = a.org_id
    WHERE d.enabled AND severity IN ('critical', 'warning') AND event_time >= TIMESTAMP '{v.NOW}' - INTERVAL 10 DAY) a,
    unnest(channels) AS u(channel))"""
ROUTE_WHERE = {"severity": ["critical", "warning"]}


@query("route_alerts", with_sql(v.ALERTS_SQL, v.DEFINITIONS_SQL, ROUTED_SQL, select="SELECT * FROM routed"))
def route_alerts(spark, sf_dir):
    return joins.route_alerts(
        v.alerts(spark, sf_dir), v.definitions(spark, sf_dir), at(v.NOW), 10 * 86400, ROUTE_WHERE
    )


_OPEN = "NOT coalesce(list_contains(processed_by, job_id), false)"


@query(
    "open_invalidations",
    with_sql(
        v.INVALIDATIONS_SQL, v.EDGES_SQL,
        select=f"SELECT id, i.dataset_uuid, job_id FROM invalidations i JOIN edges e ON i.dataset_uuid = e.dataset_uuid WHERE {_OPEN}",
    ),
)
def open_invalidations(spark, sf_dir):
    return joins.open_invalidations(v.invalidations(spark, sf_dir), v.edges(spark, sf_dir)).select("id", "dataset_uuid", "job_id")


@query(
    "closed_invalidations",
    with_sql(
        v.INVALIDATIONS_SQL, v.EDGES_SQL,
        select=f"""SELECT id, dataset_uuid FROM invalidations WHERE id NOT IN
  (SELECT id FROM invalidations i JOIN edges e ON i.dataset_uuid = e.dataset_uuid WHERE {_OPEN})""",
    ),
)
def closed_invalidations(spark, sf_dir):
    return joins.closed_invalidations(v.invalidations(spark, sf_dir), v.edges(spark, sf_dir)).select("id", "dataset_uuid")


# --- aggregates -------------------------------------------------------------------------

DAILY_SQL = """SELECT CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS day, count(*) AS tx_count,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS total_value FROM lineitem GROUP BY 1"""


@query("daily_summary", DAILY_SQL)
def daily_summary(spark, sf_dir):
    daily = aggregates.daily_summary(v.transfers(spark, sf_dir), "ts", "value")
    return daily.withColumn("total_value", F.col("total_value").cast("double"))


_DUPLICATES_SQL = """SELECT l_partkey, l_suppkey, min(l_orderkey) AS first_block, max(l_orderkey) AS last_block, count(DISTINCT l_orderkey) AS num_blocks
FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(DISTINCT l_orderkey) > 1"""


@query("duplicate_keys", _DUPLICATES_SQL)
def duplicate_keys(spark, sf_dir):
    return aggregates.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], "l_orderkey")


@query(
    "duplicate_keys_approx",
    """SELECT l_partkey, min(l_orderkey) AS first_block, max(l_orderkey) AS last_block, true AS near FROM lineitem
GROUP BY l_partkey HAVING min(l_orderkey) < max(l_orderkey)""",
)
def duplicate_keys_approx(spark, sf_dir):
    """The estimated count is held against the exact one: within a fifth, or one block."""
    rows = table(spark, sf_dir, "lineitem")
    found = aggregates.duplicate_keys(rows, ["l_partkey"], "l_orderkey", approximate=True)
    exact = rows.groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("exact"))
    near = F.abs(F.col("num_blocks") - F.col("exact")) <= F.greatest(F.lit(1), F.col("exact") / 5)
    return found.join(exact, "l_partkey").withColumn("near", near).drop("num_blocks", "exact")


@query(
    "range_counts",
    with_sql(
        v.RANGES_SQL,
        select="""SELECT job_id, dataset_key, count(*) FILTER (status <> 'completed') AS inflight,
  count(*) FILTER (status = 'completed') AS completed FROM ranges GROUP BY ALL""",
    ),
)
def range_counts(spark, sf_dir):
    return aggregates.range_counts(v.ranges(spark, sf_dir))


_DUTY_WINDOW = "l_orderkey // 32 >= (SELECT max(l_orderkey // 32) FROM lineitem) - 20"


@query(
    "validator_stats",
    f"""SELECT validator, epoch, duties, missed_slots, dist / nullif(att, 0) AS avg_inclusion_distance,
  CAST(total AS DOUBLE) AS total_reward, CAST(total AS DOUBLE) / duties AS reward_rate
FROM (SELECT l_suppkey AS validator, l_orderkey // 32 AS epoch, count(*) AS duties, count(*) FILTER (l_returnflag = 'R') AS missed_slots,
  sum(CASE WHEN l_returnflag <> 'R' THEN l_linenumber END) AS dist, count(CASE WHEN l_returnflag <> 'R' THEN 1 END) AS att,
  sum(CAST(l_tax AS DECIMAL(18, 6))) AS total FROM lineitem WHERE {_DUTY_WINDOW} GROUP BY ALL)""",
)
def validator_stats(spark, sf_dir):
    missed = F.col("l_returnflag") == "R"
    duties = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("validator"),
        F.floor(F.col("l_orderkey") / 32).alias("epoch"),
        missed.alias("missed"),
        F.when(~missed, F.col("l_linenumber")).alias("inclusion_distance"),
        F.col("l_tax").alias("reward"),
    )
    return aggregates.validator_stats(duties, 20).withColumn("total_reward", F.col("total_reward").cast("double"))


# Duties arrive in three runs, each ten epochs later. A run recomputes twenty epochs before
# its current one, so an epoch shows what had arrived at the last run that reached it.
_REFRESH_SQL = """duties AS (SELECT l_suppkey AS validator, l_orderkey // 32 AS epoch, l_partkey % 3 + 1 AS arrival, l_returnflag = 'R' AS missed,
    l_linenumber AS distance, CAST(l_tax AS DECIMAL(18, 6)) AS reward, (SELECT max(l_orderkey // 32) FROM lineitem) AS top FROM lineitem),
seen AS (SELECT * FROM duties WHERE arrival <= CASE WHEN epoch >= top - 20 THEN 3 WHEN epoch >= top - 30 THEN 2 ELSE 1 END)"""


@query(
    "validator_stats_refresh",
    with_sql(
        _REFRESH_SQL,
        select="""SELECT validator, epoch, duties, missed_slots, dist / nullif(att, 0) AS avg_inclusion_distance,
  CAST(total AS DOUBLE) AS total_reward, CAST(total AS DOUBLE) / duties AS reward_rate
FROM (SELECT validator, epoch, count(*) AS duties, count(*) FILTER (missed) AS missed_slots, sum(CASE WHEN NOT missed THEN distance END) AS dist,
  count(*) FILTER (NOT missed) AS att, sum(reward) AS total FROM seen GROUP BY ALL)""",
    ),
)
def validator_stats_refresh(spark, sf_dir):
    target, missed, rows = scratch_path(spark, "epochs"), F.col("l_returnflag") == "R", table(spark, sf_dir, "lineitem")
    duties = rows.select(
        F.col("l_suppkey").alias("validator"), F.floor(F.col("l_orderkey") / 32).alias("epoch"), missed.alias("missed"),
        F.when(~missed, F.col("l_linenumber")).alias("inclusion_distance"), F.col("l_tax").alias("reward"),
        (F.col("l_partkey") % 3 + 1).alias("arrival"),
    )
    top = duties.agg(F.max("epoch")).first()[0]
    for run in (1, 2, 3):
        arrived = duties.filter(F.col("arrival") <= run).drop("arrival")
        refresh_validator_stats(arrived, target, None if run == 1 else 20, top - 10 * (3 - run), size=64)
    return read_committed(spark, target).drop("partition_key").withColumn("total_reward", F.col("total_reward").cast("double"))


_QUORUM_SQL = with_sql(
    v.BLOCKS_SQL,
    """answers AS (
  SELECT chain_id, block_number, 'block_hash' AS field, provider,
    CASE WHEN provider = 'b' AND block_number % 97 = 0 THEN 'fork' WHEN provider = 'c' AND block_number % 194 = 0 THEN NULL ELSE block_hash END AS value
  FROM blocks, (VALUES ('a'), ('b'), ('c')) AS p(provider)
  UNION ALL
  SELECT chain_id, block_number, 'tx_count', provider, CAST(block_number % 7 + CASE WHEN provider = 'c' AND block_number % 89 = 0 THEN 1 ELSE 0 END AS VARCHAR)
  FROM blocks, (VALUES ('a'), ('b'), ('c')) AS p(provider))""",
    """votes AS (SELECT chain_id, block_number, field, value, count(*) AS n, string_agg(provider, ',' ORDER BY provider) AS providers FROM answers GROUP BY ALL)""",
    select="""SELECT chain_id, block_number, field, count(*) AS variants, CAST(sum(n) AS BIGINT) AS answers, max(n) AS top_votes, max(n) >= 2 AS agreement_met,
  string_agg(coalesce(value, 'null') || '=' || providers, ';' ORDER BY value NULLS FIRST) AS differing_values
FROM votes GROUP BY chain_id, block_number, field HAVING count(*) > 1""",
)


@query("provider_quorum", _QUORUM_SQL)
def provider_quorum(spark, sf_dir):
    number, provider = F.col("block_number"), F.col("provider")
    answers = v.blocks(spark, sf_dir).withColumn("provider", F.explode(F.array(*[F.lit(p) for p in "abc"])))
    answers = answers.withColumns(
        {
            "block_hash": F.when((provider == "b") & (number % 97 == 0), "fork")
            .when((provider == "c") & (number % 194 == 0), None)
            .otherwise(F.col("block_hash")),
            "tx_count": number % 7 + F.when((provider == "c") & (number % 89 == 0), 1).otherwise(0),
        }
    )
    return aggregates.provider_quorum(answers, ["block_hash", "tx_count"], min_agreement=2)


@query(
    "query_metrics",
    with_sql(
        v.RUNS_SQL,
        select="""SELECT org_id, user_id, count(*) AS query_count, count(error_code) AS query_errors, CAST(sum(row_count) AS BIGINT) AS result_rows,
  CAST(sum(bytes) AS BIGINT) AS result_bytes, max(duration_ms) AS max_duration_ms FROM runs GROUP BY org_id, user_id""",
    ),
)
def query_metrics(spark, sf_dir):
    return aggregates.query_metrics(v.runs(spark, sf_dir))


@query(
    "query_errors",
    with_sql(v.RUNS_SQL, select="SELECT error_code, count(*) AS query_errors FROM runs WHERE error_code IS NOT NULL GROUP BY error_code"),
)
def query_errors(spark, sf_dir):
    return aggregates.query_errors(v.runs(spark, sf_dir))


@query(
    "query_histogram",
    with_sql(
        v.RUNS_SQL,
        select="""SELECT CAST(CASE WHEN duration_ms >= 20000 THEN 21 ELSE duration_ms // 1000 + 1 END AS INTEGER) AS bucket, count(*) AS n,
  min(duration_ms) AS low, max(duration_ms) AS high FROM runs GROUP BY 1""",
    ),
)
def query_histogram(spark, sf_dir):
    return aggregates.histogram(v.runs(spark, sf_dir), "duration_ms", 0, 20000, 20)


@query(
    "query_quantiles",
    with_sql(
        v.RUNS_SQL,
        select="""SELECT org_id, quantile_cont(duration_ms, 0.5) AS p50, quantile_cont(duration_ms, 0.95) AS p95, quantile_cont(duration_ms, 0.99) AS p99
FROM runs GROUP BY org_id""",
    ),
)
def query_quantiles(spark, sf_dir):
    return aggregates.quantiles(v.runs(spark, sf_dir), ["org_id"], "duration_ms")


@query(
    "sync_lag",
    with_sql(
        v.JOBS_SQL, v.STREAMS_SQL, v.CURSORS_SQL, v.HEADS_SQL,
        select="""SELECT s.job_id, s.dataset_key, j.chain_id, head_block, next_block, CASE WHEN head_block IS NOT NULL THEN greatest(head_block + 1 - next_block, 0) END AS lag_blocks
FROM streams s JOIN jobs j ON s.job_id = j.job_id JOIN cursors c ON c.job_id = s.job_id AND c.dataset_key = s.dataset_key
LEFT JOIN heads h ON h.org_id = j.org_id AND h.chain_id = j.chain_id AND h.rpc_pool = s.rpc_pool""",
    ),
)
def sync_lag(spark, sf_dir):
    return aggregates.sync_lag(
        v.jobs(spark, sf_dir), v.streams(spark, sf_dir), v.cursors(spark, sf_dir), v.observations(spark, sf_dir)
    )


@query(
    "reorg_counts",
    with_sql(
        v.INVALIDATIONS_SQL,
        select="SELECT dataset_uuid, count(*) FILTER (reason = 'reorg') AS reorgs, count(*) AS invalidations FROM invalidations GROUP BY dataset_uuid",
    ),
)
def reorg_counts(spark, sf_dir):
    return aggregates.reorg_counts(v.invalidations(spark, sf_dir))


@query("latest_heads", with_sql(v.HEADS_SQL, select="SELECT * FROM heads"))
def latest_heads(spark, sf_dir):
    return aggregates.latest_heads(v.observations(spark, sf_dir))


@query(
    "job_completion",
    with_sql(
        v.JOBS_SQL, v.STREAMS_SQL, v.CURSORS_SQL, v.RANGES_SQL,
        select="""SELECT job_id, mode, count(*) AS streams, count(*) FILTER (done) AS streams_done, bool_and(done) AS complete FROM (
  SELECT j.job_id, mode, coalesce(mode = 'fixed_target' AND next_block >= to_block AND coalesce(inflight, 0) = 0, false) AS done
  FROM jobs j JOIN streams s ON s.job_id = j.job_id LEFT JOIN cursors c ON c.job_id = s.job_id AND c.dataset_key = s.dataset_key
  LEFT JOIN (SELECT job_id, dataset_key, count(*) FILTER (status <> 'completed') AS inflight FROM ranges GROUP BY ALL) r
    ON r.job_id = s.job_id AND r.dataset_key = s.dataset_key) GROUP BY ALL""",
    ),
)
def job_completion(spark, sf_dir):
    return aggregates.job_completion(
        v.jobs(spark, sf_dir), v.streams(spark, sf_dir), v.cursors(spark, sf_dir), v.ranges(spark, sf_dir)
    )


# --- windows ----------------------------------------------------------------------------


@query(
    "block_gaps",
    with_sql(
        v.BLOCKS_SQL,
        select="""SELECT chain_id, block_number + 1 AS gap_start, next - 1 AS gap_end, next - block_number - 1 AS missing FROM (
  SELECT *, lead(block_number) OVER (PARTITION BY chain_id ORDER BY block_number) AS next FROM blocks) WHERE next > block_number + 1""",
    ),
)
def block_gaps(spark, sf_dir):
    return windows.block_gaps(v.blocks(spark, sf_dir), bucket_size=1000)


# Incoming blocks: those of urgent orders, with another hash from block 700 on.
_INCOMING_SQL = """incoming AS (
  SELECT b.chain_id, block_number, CASE WHEN block_number >= 700 THEN 'new' || block_hash ELSE block_hash END AS block_hash
  FROM blocks b JOIN orders ON o_orderkey = block_number WHERE o_orderpriority = '1-URGENT')"""


def _incoming(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("block_number"))
    changed = F.when(F.col("block_number") >= 700, F.concat(F.lit("new"), "block_hash")).otherwise(F.col("block_hash"))
    return v.blocks(spark, sf_dir).join(urgent, "block_number").withColumn("block_hash", changed)


@query(
    "detect_reorg",
    with_sql(
        v.BLOCKS_SQL, _INCOMING_SQL,
        select="""SELECT c.chain_id, fork_block, (SELECT max(block_number) FROM blocks b WHERE b.chain_id = c.chain_id) AS old_tip,
  (SELECT max(block_number) FROM incoming n WHERE n.chain_id = c.chain_id) AS new_tip, changed_blocks
FROM (SELECT b.chain_id, min(b.block_number) AS fork_block, count(DISTINCT b.block_number) AS changed_blocks
  FROM blocks b JOIN incoming i ON b.chain_id = i.chain_id AND b.block_number = i.block_number WHERE b.block_hash <> i.block_hash GROUP BY b.chain_id) c""",
    ),
)
def detect_reorg(spark, sf_dir):
    return windows.detect_reorg(v.blocks(spark, sf_dir), _incoming(spark, sf_dir))


@query(
    "canonical_blocks",
    """SELECT chain_id, block_number, block_hash, seen_at FROM (
  SELECT *, row_number() OVER (PARTITION BY chain_id, block_number ORDER BY seen_at DESC, block_hash DESC) AS rn FROM (
    SELECT l_suppkey % 3 AS chain_id, l_orderkey AS block_number, l_linenumber || '-' || l_partkey AS block_hash, l_shipdate AS seen_at FROM lineitem)) WHERE rn = 1""",
)
def canonical_blocks(spark, sf_dir):
    seen = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 3).alias("chain_id"),
        F.col("l_orderkey").alias("block_number"),
        F.concat_ws("-", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("block_hash"),
        F.col("l_shipdate").alias("seen_at"),
    )
    return windows.canonical_blocks(seen)


_LIVE_SQL = "live AS (SELECT user_id % 3 AS chain_id, event_id AS block_number, ts AS block_time FROM events)"


def _live(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 3).alias("chain_id"), F.col("event_id").alias("block_number"), F.col("ts").alias("block_time")
    )


@query(
    "liveliness",
    with_sql(
        _LIVE_SQL,
        select="""SELECT chain_id, max(block_number) AS last_block, max(block_time) AS last_block_time,
  date_sub('millisecond', max(block_time), TIMESTAMP '2024-01-31 00:00:00') AS gap_ms,
  CASE WHEN date_sub('millisecond', max(block_time), TIMESTAMP '2024-01-31 00:00:00') <= 200000 THEN 'ok'
    WHEN date_sub('millisecond', max(block_time), TIMESTAMP '2024-01-31 00:00:00') < 600000 THEN 'degraded' ELSE 'stalled' END AS status
FROM live GROUP BY chain_id""",
    ),
)
def liveliness(spark, sf_dir):
    return windows.liveliness(_live(spark, sf_dir), at("2024-01-31 00:00:00"), 200_000, 600_000)


@query(
    "liveliness_history",
    with_sql(
        _LIVE_SQL,
        select="""SELECT chain_id, block_number, gap_ms, CASE WHEN gap_ms <= 200000 THEN 'ok' WHEN gap_ms < 600000 THEN 'degraded' ELSE 'stalled' END AS status
FROM (SELECT *, date_sub('millisecond', lag(block_time) OVER (PARTITION BY chain_id ORDER BY block_number), block_time) AS gap_ms FROM live) WHERE gap_ms IS NOT NULL""",
    ),
)
def liveliness_history(spark, sf_dir):
    return windows.liveliness_history(_live(spark, sf_dir), 200_000, 600_000, bucket_size=500)


# --- sets -------------------------------------------------------------------------------


@query("distinct_keys", "SELECT DISTINCT 'cold/' || (l_orderkey // 7) || '/' || l_suppkey || '.parquet' AS path FROM lineitem")
def distinct_keys(spark, sf_dir):
    block = F.floor(F.col("l_orderkey") / 7).cast("string")
    path = F.concat(F.lit("cold/"), block, F.lit("/"), F.col("l_suppkey").cast("string"), F.lit(".parquet"))
    return sets.distinct_keys(table(spark, sf_dir, "lineitem").select(path.alias("path")))


@query(
    "unscheduled_ranges",
    with_sql(
        v.RANGES_SQL,
        select="""SELECT * FROM (SELECT 'job-' || c_custkey AS job_id, 'blocks' AS dataset_key, c_custkey * 10 + 10 * i AS range_start, c_custkey * 10 + 10 * i + 10 AS range_end
  FROM customer, range(0, 20) AS s(i)) EXCEPT SELECT job_id, dataset_key, range_start, range_end FROM ranges""",
    ),
)
def unscheduled_ranges(spark, sf_dir):
    start = F.col("c_custkey") * 10 + 10 * F.col("i")
    expected = (
        table(spark, sf_dir, "customer")
        .select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i"))
        .select(text("job-", F.col("c_custkey")).alias("job_id"), F.lit("blocks").alias("dataset_key"), start.alias("range_start"), (start + 10).alias("range_end"))
    )
    return sets.unscheduled_ranges(expected, v.ranges(spark, sf_dir))
