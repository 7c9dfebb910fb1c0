"""SQL gate, user rule, audit and incremental queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom.functions.ids import partition_key
from blockloom.plans import audit, incremental
from blockloom.plans import rules as ur
from blockloom.plans.query import encode_result, gated_sql, run_query
from blockloom.session import scratch_path
from blockloom.sinks.append import read_appended
from blockloom.sinks.scopes import read_committed, replace_scopes
from blockloom.workloads import views as v
from blockloom.workloads.registry import query
from blockloom.workloads.relational import DAILY_SQL
from blockloom.workloads.tables import SCOPE, SCOPED_SQL, scoped_blocks
from blockloom.workloads.views import at, table, text, with_sql

DEFINITION = "5c1a0b52-3f56-4c7e-9a51-000000000001"
DATASET = "5c1a0b52-3f56-4c7e-9a51-000000000002"
VERSION = "5c1a0b52-3f56-4c7e-9a51-000000000003"


@query("run_query", f"SELECT epoch_us(day) AS day, tx_count, total_value FROM ({DAILY_SQL})")
def run_query_query(spark, sf_dir):
    """The daily summary as user SQL: gated and encoded, all its rows, on the executors."""
    sql = """SELECT CAST(date_trunc('day', ts) AS timestamp_ntz) AS day, count(*) AS tx_count,
  CAST(sum(CAST(value AS decimal(18, 2))) AS double) AS total_value FROM dataset GROUP BY 1"""
    return encode_result(gated_sql(v.transfers(spark, sf_dir), sql))


@query(
    "capped_rows",
    """SELECT o_orderkey, o_totalprice, count(*) OVER () > 500 AS truncated FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500""",
)
def capped_rows_query(spark, sf_dir):
    sql = "SELECT o_orderkey, o_totalprice FROM dataset ORDER BY o_totalprice DESC, o_orderkey"
    result = run_query(table(spark, sf_dir, "orders"), sql, limit=500)
    rows = spark.createDataFrame(result.rows, "o_orderkey bigint, o_totalprice double")
    return rows.withColumn("truncated", F.lit(result.truncated))


@query(
    "encode_result",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS VARCHAR) AS price, epoch_us(l_shipdate) AS shipped,
  CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS day, CASE WHEN l_tax > 0 THEN l_tax END AS tax, '<list>' AS flags,
  '<unsupported>' AS pair, '[' || ord(l_returnflag) || ']' AS raw FROM lineitem""",
)
def encode_result_query(spark, sf_dir):
    tax = F.when(F.col("l_tax") > 0, F.col("l_tax")).otherwise(F.lit(float("nan")))
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
        F.col("l_shipdate").alias("shipped"),
        F.col("l_shipdate").cast("date").alias("day"),
        tax.alias("tax"),
        F.array("l_returnflag", "l_linestatus").alias("flags"),
        F.struct("l_returnflag", "l_linestatus").alias("pair"),
        F.encode("l_returnflag", "UTF-8").alias("raw"),
    )
    return encode_result(rows).withColumn("raw", F.to_json("raw"))


EVENTS_SQL = f"""SELECT '{DEFINITION}' AS alert_definition_id, 'alert_eval:{DEFINITION}:{VERSION}:' || block_number || ':' || block_hash AS dedupe_key,
  block_time AS event_time, chain_id, block_number, block_hash, '' AS tx_hash,
  '{{"dataset_uuid":"{DATASET}","dataset_version":"{VERSION}","block_hash":"' || block_hash || '"}}' AS payload
FROM blocks JOIN orders ON o_orderkey = block_number WHERE o_totalprice > 400000"""
RULE_SQL = "SELECT chain_id, block_number, block_hash, block_time AS event_time FROM dataset WHERE total > 400000"


def priced_blocks(spark, sf_dir):
    price = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("block_number"), F.col("o_totalprice").alias("total"))
    return v.blocks(spark, sf_dir).join(price, "block_number")


def rule_arguments():
    return {
        "definition_id": DEFINITION, "dataset_uuid": DATASET, "dataset_version": VERSION, "now": at(v.NOW),
    }


@query("sql_rule", with_sql(v.BLOCKS_SQL, select=EVENTS_SQL))
def sql_rule_query(spark, sf_dir):
    return ur.sql_rule(priced_blocks(spark, sf_dir), RULE_SQL, **rule_arguments())


@query(
    "sql_rule_own_payload",
    with_sql(
        v.BLOCKS_SQL,
        select=f"""SELECT '{DEFINITION}' AS alert_definition_id, 'alert_eval:{DEFINITION}:{VERSION}:' || block_number || ':' || block_hash || ':0xt' || block_number AS dedupe_key,
  TIMESTAMP '{v.NOW}' AS event_time, chain_id, block_number, block_hash, '0xt' || block_number AS tx_hash,
  '{{"severity":"high","total":' || CAST(floor(o_totalprice) AS BIGINT) || '}}' AS payload
FROM blocks JOIN orders ON o_orderkey = block_number WHERE o_totalprice > 400000""",
    ),
)
def sql_rule_own_payload(spark, sf_dir):
    sql = """SELECT chain_id, block_number, block_hash, '0xt' || block_number AS tx_hash, 'high' AS severity,
  '{"total":' || CAST(floor(total) AS bigint) || '}' AS payload FROM dataset WHERE total > 400000"""
    return ur.sql_rule(priced_blocks(spark, sf_dir), sql, **rule_arguments())


def _large_transfers(batches):
    for pdf in batches:
        hit = pdf[pdf["value"] > 90000]
        yield hit.assign(score=(hit["value"] // 1000).astype("int64"))[["block_number", "log_index", "address", "token", "score"]]


@query(
    "python_rule",
    """SELECT l_orderkey AS block_number, l_linenumber AS log_index, l_suppkey AS address, l_partkey AS token, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS score
FROM lineitem WHERE l_extendedprice > 90000""",
)
def python_rule_query(spark, sf_dir):
    schema = "block_number bigint, log_index int, address bigint, token bigint, score bigint"
    return ur.python_rule(v.transfers(spark, sf_dir), _large_transfers, schema)


def _longest_run(key, pieces):
    import numpy as np
    import pandas as pd

    count, longest, last = 0, 0, []
    for piece in pieces:
        dates = piece["o_orderdate"].to_numpy()
        steps = np.diff(np.concatenate([last, dates]) if count else dates)
        pauses = steps[~np.isnat(steps)] // np.timedelta64(1, "D")
        count, longest, last = count + len(dates), max([longest, *pauses.tolist()]), dates[-1:]
    yield pd.DataFrame({"o_custkey": [key[0]], "orders": [count], "longest_pause": [longest]})


@query(
    "python_group_rule",
    """SELECT o_custkey, count(*) AS orders, CAST(coalesce(max(pause), 0) AS BIGINT) AS longest_pause FROM (
  SELECT o_custkey, date_diff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate) AS pause FROM orders) GROUP BY o_custkey""",
)
def python_group_rule_query(spark, sf_dir):
    schema = "o_custkey bigint, orders bigint, longest_pause bigint"
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return ur.sorted_group_rule(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], _longest_run, schema)


# Rule output with invalid rows, one kind per residue.
_REJECT = "CASE event_id % 50 WHEN 1 THEN 'bad alert_definition_id' WHEN 2 THEN 'missing block_hash' WHEN 3 THEN 'payload must be an object' END"


@query("validate_events", f"SELECT event_id AS block_number, {_REJECT} AS error FROM events WHERE event_id % 50 IN (1, 2, 3)")
def validate_events_query(spark, sf_dir):
    kind = F.col("event_id") % 50
    emitted = table(spark, sf_dir, "events").select(
        F.when(kind == 1, "not-a-uuid").otherwise(F.lit(DEFINITION)).alias("alert_definition_id"),
        text("k", F.col("event_id")).alias("dedupe_key"),
        F.col("ts").alias("event_time"),
        (F.col("user_id") % 3).alias("chain_id"),
        F.col("event_id").alias("block_number"),
        F.when(kind != 2, "0x0").alias("block_hash"),
        F.lit("0x0").alias("tx_hash"),
        F.when(kind == 3, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props")).alias("payload"),
    )
    return ur.validate_events(emitted)[1].select("block_number", "error")


# --- audit ------------------------------------------------------------------------------

_AUDIT_SQL = """audit AS (SELECT org_id, task_id, user_id AS user_sub, dataset_id, query_time, NULL AS columns_accessed, row_count AS result_row_count
  FROM runs WHERE status = 'Succeeded')"""


def _audit(spark, sf_dir):
    return audit.query_audit(v.runs(spark, sf_dir).withColumnRenamed("user_id", "user_sub"))


@query("query_audit", with_sql(v.RUNS_SQL, _AUDIT_SQL, select="SELECT * FROM audit"))
def query_audit_query(spark, sf_dir):
    return _audit(spark, sf_dir)


@query(
    "query_results",
    with_sql(
        v.RUNS_SQL,
        select="""SELECT id, org_id, status, row_count, query_time AS updated_at, sha256('SELECT ' || id) AS sql_hash FROM runs""",
    ),
)
def query_results_query(spark, sf_dir):
    """Every run is first recorded as running, later with its outcome."""
    runs = v.runs(spark, sf_dir).select(
        "id", "org_id", "status", "row_count", F.col("query_time").alias("updated_at"), F.concat(F.lit("SELECT "), "id").alias("sql")
    )
    started = runs.withColumns(
        {"status": F.lit("Running"), "updated_at": F.col("updated_at") - F.expr("INTERVAL 1 SECOND"), "row_count": F.lit(None).cast("bigint")}
    )
    return audit.query_results(started.unionByName(runs))


_PII_SQL = """SELECT r.org_id, r.user_id, r.task_id, r.dataset_id AS dataset, column_name, r.id AS record_id, 'read' AS action, query_time AS accessed_at
FROM runs r, unnest(CASE WHEN substr(dataset_id, 4)::INT % 2 = 1 THEN [] WHEN row_count % 3 = 0 THEN [NULL] WHEN row_count % 3 = 1 THEN ['email', 'label'] ELSE ['label'] END) AS u(column_name)"""


@query("pii_access", with_sql(v.RUNS_SQL, select=_PII_SQL))
def pii_access_query(spark, sf_dir):
    kind = F.col("row_count") % 3
    columns = F.when(kind == 1, F.array(F.lit("label"), F.lit("address"), F.lit("email"))).when(
        kind == 2, F.array(F.lit("label"), F.lit("address"))
    )
    reads = v.runs(spark, sf_dir).select(
        "org_id", "user_id", "task_id", F.col("dataset_id").alias("dataset"), columns.alias("columns"),
        F.col("id").alias("record_id"), F.col("query_time").alias("accessed_at"),
    )
    number = F.col("p_partkey") % 7
    classified = table(spark, sf_dir, "part").filter(number % 2 == 0).select(
        text("ds-", number).alias("dataset"), F.explode(F.array(F.lit("label"), F.lit("email"))).alias("column_name")
    ).distinct()
    return audit.pii_access(reads, classified)


@query(
    "audit_report",
    with_sql(
        v.RUNS_SQL, _AUDIT_SQL,
        select="""SELECT org_id, dataset_id, CAST(date_trunc('day', query_time) AS TIMESTAMP) AS bucket, count(*) AS accesses, CAST(sum(result_row_count) AS BIGINT) AS rows_read
FROM audit GROUP BY ALL""",
    ),
)
def audit_report_query(spark, sf_dir):
    return audit.audit_report(_audit(spark, sf_dir))


# --- incremental ------------------------------------------------------------------------


def _with_flag(df):
    return df.withColumn("flag", F.substring("block_hash", -1, 1))


@query(
    "run_incremental_cursor",
    with_sql(v.BLOCKS_SQL, select="SELECT chain_id, block_number, block_hash, block_time, right(block_hash, 1) AS flag FROM blocks"),
)
def run_incremental_cursor(spark, sf_dir):
    """Blocks in three runs, the second one twice, as after a crash before the cursor was stored."""
    target, rows, cursor = scratch_path(spark, "cursor"), v.blocks(spark, sf_dir), -1
    top = rows.agg(F.max("block_number")).first()[0]
    for n, limit in enumerate((top // 3, top // 2, top)):
        for _ in range(2 if n == 1 else 1):
            moved = incremental.run_incremental(
                "cursor", spark, rows.filter(F.col("block_number") <= limit), _with_flag, target,
                cursor_column="block_number", cursor=cursor, keys=["chain_id", "block_number"], order_by=["block_hash"], batch_id=f"run-{n}",
            )
        cursor = moved.first().next_cursor
    return read_appended(spark, target)


@query(
    "run_incremental_partition",
    with_sql(v.BLOCKS_SQL, SCOPED_SQL, select="SELECT *, right(block_hash, 1) AS flag FROM scoped"),
)
def run_incremental_partition(spark, sf_dir):
    """Half the partitions, then all: the second run only adds what is missing."""
    root, rows = scratch_path(spark, "partitions"), scoped_blocks(spark, sf_dir)
    half = rows.agg(F.max("block_number")).first()[0] // 2 // SCOPE * SCOPE
    incremental.run_incremental("partition", spark, rows.filter(F.col("block_number") < half), _with_flag, root)
    incremental.run_incremental("partition", spark, rows, _with_flag, root)
    return read_committed(spark, root)


@query(
    "run_incremental_full",
    with_sql(v.BLOCKS_SQL, SCOPED_SQL, select="SELECT *, right(block_hash, 1) AS flag FROM scoped WHERE partition_key <> '0-4999'"),
)
def run_incremental_full(spark, sf_dir):
    root, rows = scratch_path(spark, "full"), scoped_blocks(spark, sf_dir)
    incremental.run_incremental("full", spark, rows, _with_flag, root)
    incremental.run_incremental("full", spark, rows.filter("partition_key <> '0-4999'"), _with_flag, root)
    return read_committed(spark, root)


def _reprocess(spark, sf_dir):
    """Output built from old hashes; the input is then rewritten and one job catches up."""
    root, rows = scratch_path(spark, "reprocess"), v.blocks(spark, sf_dir)
    start = F.floor(F.col("block_number") / 2500) * 2500
    scope = partition_key(start, start + 2500)
    replace_scopes(_with_flag(rows.withColumn("partition_key", scope)), root)
    rewritten = rows.withColumn("block_hash", F.concat("block_hash", F.lit("z")))
    marked, downstream = incremental.reprocess_invalidations(
        spark, v.invalidations(spark, sf_dir), v.edges(spark, sf_dir), "job-b", rewritten, _with_flag, root, "out", "v1", scope
    )
    return root, marked, downstream


_HIT_SQL = """open_b AS (SELECT i.* FROM invalidations i JOIN edges e ON i.dataset_uuid = e.dataset_uuid AND job_id = 'job-b'
  WHERE NOT coalesce(list_contains(processed_by, 'job-b'), false)),
hit AS (SELECT DISTINCT block_number // 2500 AS s FROM blocks b WHERE EXISTS (SELECT 1 FROM open_b i WHERE b.block_number BETWEEN i.first AND i.last))"""


@query(
    "reprocess_invalidations",
    with_sql(
        v.BLOCKS_SQL, v.INVALIDATIONS_SQL, v.EDGES_SQL, _HIT_SQL,
        select="""SELECT chain_id, block_number, CASE WHEN s IS NULL THEN block_hash ELSE block_hash || 'z' END AS block_hash, block_time,
  (block_number // 2500 * 2500) || '-' || (block_number // 2500 * 2500 + 2499) AS partition_key, CASE WHEN s IS NULL THEN right(block_hash, 1) ELSE 'z' END AS flag
FROM blocks LEFT JOIN hit ON s = block_number // 2500""",
    ),
)
def reprocess_invalidations_query(spark, sf_dir):
    return read_committed(spark, _reprocess(spark, sf_dir)[0])


@query(
    "downstream_invalidations",
    with_sql(
        v.BLOCKS_SQL, v.INVALIDATIONS_SQL, v.EDGES_SQL, _HIT_SQL,
        select="SELECT 'out' AS dataset_uuid, 'partition' AS scope, (s * 2500) || '-' || (s * 2500 + 2499) AS partition_key, 'correction' AS reason FROM hit",
    ),
)
def downstream_invalidations(spark, sf_dir):
    return _reprocess(spark, sf_dir)[2].select("dataset_uuid", "scope", "partition_key", "reason")


@query(
    "mark_processed",
    with_sql(
        v.INVALIDATIONS_SQL, v.EDGES_SQL,
        select="""SELECT i.id, array_to_string(list_sort(list_distinct(list_concat(coalesce(processed_by, []), CASE WHEN e.job_id IS NOT NULL THEN ['job-b'] ELSE [] END))), ',') AS processed_by
FROM invalidations i LEFT JOIN edges e ON e.dataset_uuid = i.dataset_uuid AND e.job_id = 'job-b'""",
    ),
)
def mark_processed_query(spark, sf_dir):
    from blockloom.operators.joins import open_invalidations

    rows = v.invalidations(spark, sf_dir)
    mine = open_invalidations(rows, v.edges(spark, sf_dir).filter("job_id = 'job-b'"))
    marked = incremental.mark_processed(rows, mine.select("id", "job_id"))
    return marked.select("id", F.array_join("processed_by", ",").alias("processed_by"))
