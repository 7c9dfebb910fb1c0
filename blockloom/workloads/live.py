"""Structured Streaming queries: each drains a table as a stream and returns the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom.session import materialized, scratch_path
from blockloom.sinks.append import read_appended
from blockloom.sinks.scopes import read_committed
from blockloom.streaming.alerts import alert_evaluate, alert_evaluate_stream, alert_route_stream, dedupe_stream
from blockloom.streaming.deliveries import delivery_outcomes
from blockloom.streaming.follow import follow_blocks
from blockloom.streaming.liveliness import liveliness_stream
from blockloom.streaming.ranges import range_aggregate_stream
from blockloom.workloads import views as v
from blockloom.workloads.registry import query
from blockloom.workloads.relational import ROUTE_WHERE, ROUTED_SQL
from blockloom.workloads.rules import EVENTS_SQL, RULE_SQL, priced_blocks, rule_arguments
from blockloom.workloads.views import as_alerts, at, table, text, with_sql


def drained_in_waves(spark, df, wave, start):
    """``df`` arriving in the order of ``wave``, a small integer column: each wave is written,
    then the stream over all that is written resumes from its checkpoint and drains it.

    So a wave is a micro-batch whatever the number of its files, and state and
    de-duplication work across batches. ``start(stream)`` starts the query.
    """
    path, schema = scratch_path(spark, "stream"), df.drop(wave).schema
    for value in [row[0] for row in df.select(wave).distinct().orderBy(wave).collect()]:
        df.filter(F.col(wave) == value).drop(wave).write.mode("append").parquet(path, compression="zstd")
        start(spark.readStream.schema(schema).parquet(path)).awaitTermination()


# Blocks arrive in four waves: the old branch; a new branch from 3/4 of the tip on that is ten
# blocks shorter; the old hashes of the first ten of these again, seen before the new ones;
# and the old branch once more from there on, seen later than all.
_FOLLOW_SQL = """cut AS (SELECT max(block_number) * 3 // 4 AS fork, max(block_number) AS top FROM blocks),
tips AS (SELECT b.chain_id, min(block_number) FILTER (block_number >= fork AND block_number <= top - 10) AS fork_block, max(block_number) AS old_tip,
  max(block_number) FILTER (block_number <= top - 10) AS new_tip FROM blocks b, cut GROUP BY b.chain_id),
kept AS (SELECT b.chain_id, block_number, block_hash, block_time, CAST(CASE WHEN block_number >= fork_block THEN 4 ELSE 1 END AS INTEGER) AS seen_at
  FROM blocks b JOIN tips t ON b.chain_id = t.chain_id, cut WHERE block_number < fork_block OR block_number <= top - 10)"""


def _waves(rows, top, hashed="block_hash"):
    number, fresh = F.col("block_number"), F.concat(F.lit("new"), hashed)
    branch = rows.filter((number >= top * 3 // 4) & (number <= top - 10))
    return (
        rows.withColumns({"seen_at": F.lit(1), "wave": F.lit(1)})
        .unionByName(branch.withColumns({hashed: fresh, "seen_at": F.lit(3), "wave": F.lit(2)}))
        .unionByName(branch.filter(number < top * 3 // 4 + 10).withColumns({"seen_at": F.lit(2), "wave": F.lit(3)}))
        .unionByName(branch.withColumns({"seen_at": F.lit(4), "wave": F.lit(4)}))
    )


def _follow(spark, rows, top, row_key=()):
    hot, notes, events, offsets = (scratch_path(spark, n) for n in ("hot", "invalidations", "events", "offsets"))
    drained_in_waves(
        spark, _waves(rows, top), "wave",
        lambda stream: follow_blocks(
            stream, "follow", hot, notes, events, offsets, "ds", "v1", scope_size=10_000, row_key=row_key
        ),
    )
    return hot, notes, events


def _followed_blocks(spark, sf_dir):
    blocks = v.blocks(spark, sf_dir)
    return _follow(spark, blocks, blocks.agg(F.max("block_number")).first()[0])


@query("follow_blocks", with_sql(v.BLOCKS_SQL, _FOLLOW_SQL, select="SELECT * FROM kept"))
def follow_blocks_query(spark, sf_dir):
    return read_committed(spark, _followed_blocks(spark, sf_dir)[0]).drop("partition_key")


# Every block has the line items of an order as its logs, told apart by all they have.
@query(
    "follow_logs",
    with_sql(
        v.BLOCKS_SQL, _FOLLOW_SQL,
        select="""SELECT DISTINCT chain_id, block_number, block_hash, seen_at, l_linenumber AS log_index, l_partkey AS token
FROM kept JOIN lineitem ON l_orderkey = block_number""",
    ),
)
def follow_logs_query(spark, sf_dir):
    blocks = v.blocks(spark, sf_dir)
    logs = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("block_number"), F.col("l_linenumber").alias("log_index"), F.col("l_partkey").alias("token")
    )
    rows = blocks.select("chain_id", "block_number", "block_hash").join(logs.distinct(), "block_number")
    rows = materialized(rows, "logs", "zstd")  # every wave takes its rows from here
    top = blocks.agg(F.max("block_number")).first()[0]
    return read_committed(spark, _follow(spark, rows, top, ("log_index", "token"))[0]).drop("partition_key")


# The second wave and the fourth are reorgs of their own; the third changes nothing.
@query(
    "follow_invalidations",
    with_sql(
        v.BLOCKS_SQL, _FOLLOW_SQL,
        select="""SELECT 'ds' AS dataset_uuid, 'v1' AS dataset_version, chain_id, 'row_range' AS scope, fork_block AS gte, tip AS lte, 'reorg' AS reason,
  sha256('ds:v1:{"chain_id":' || chain_id || ',"fork_block":' || fork_block || ',"old_tip":' || tip || ',"new_tip":' || new_tip || ',"commit_id":"follow-' || batch || '"}') AS id
FROM (SELECT *, old_tip AS tip, 1 AS batch FROM tips UNION ALL SELECT *, new_tip, 3 FROM tips) WHERE fork_block IS NOT NULL""",
    ),
)
def follow_invalidations(spark, sf_dir):
    rows = read_appended(spark, _followed_blocks(spark, sf_dir)[1])
    return rows.select("id", "dataset_uuid", "dataset_version", "chain_id", "scope", "row_filter.gte", "row_filter.lte", "reason")


@query("alert_evaluate", with_sql(v.BLOCKS_SQL, select=EVENTS_SQL))
def alert_evaluate_query(spark, sf_dir):
    """The rule evaluated twice over the same rows: the second run adds nothing."""
    target = scratch_path(spark, "alerts")
    for batch_id in ("first", "again"):
        alert_evaluate(priced_blocks(spark, sf_dir), RULE_SQL, target_path=target, batch_id=batch_id, **rule_arguments())
    return read_appended(spark, target)


@query("alert_evaluate_stream", with_sql(v.BLOCKS_SQL, select=EVENTS_SQL))
def alert_evaluate_stream_query(spark, sf_dir):
    from blockloom.functions.ids import block_hash

    target, offsets = scratch_path(spark, "alerts"), scratch_path(spark, "offsets")
    updates = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 3).alias("chain_id"), F.col("o_orderkey").alias("block_number"),
        block_hash("o_orderkey").alias("block_hash"), F.col("o_orderdate").alias("block_time"), F.col("o_totalprice").alias("total"),
        (F.col("o_orderkey") % 3).alias("wave"),
    )
    again = updates.filter("wave = 0").withColumn("wave", F.lit(3).cast("bigint"))  # a redelivery
    drained_in_waves(
        spark, updates.unionByName(again), "wave",
        lambda stream: alert_evaluate_stream(stream, "alerts", offsets, rule=RULE_SQL, target_path=target, **rule_arguments()),
    )
    return read_appended(spark, target)


@query("alert_route_stream", with_sql(v.ALERTS_SQL, v.DEFINITIONS_SQL, ROUTED_SQL, select="SELECT * FROM routed"))
def alert_route_stream_query(spark, sf_dir):
    target, offsets = scratch_path(spark, "deliveries"), scratch_path(spark, "offsets")
    events = table(spark, sf_dir, "events").withColumn("wave", F.col("event_id") % 3)
    again = events.filter("wave = 1").withColumn("wave", F.lit(3).cast("bigint"))
    drained_in_waves(
        spark, events.unionByName(again), "wave",
        lambda stream: alert_route_stream(
            as_alerts(stream), "route", lambda: v.definitions(spark, sf_dir), target, offsets, at(v.NOW), 10 * 86400, ROUTE_WHERE
        ),
    )
    return read_appended(spark, target)


# Keys come again in later waves, and waves do not follow the dates, so first-seen rows are late.
_DEDUPE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query(
    "dedupe_stream",
    f"""SELECT * FROM lineitem QUALIFY row_number() OVER (
  PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey % 4, {', '.join(_DEDUPE_ORDER)}) = 1""",
)
def dedupe_stream_query(spark, sf_dir):
    target, offsets = scratch_path(spark, "dedupe"), scratch_path(spark, "offsets")
    rows = table(spark, sf_dir, "lineitem").withColumn("wave", F.col("l_partkey") % 4)
    drained_in_waves(
        spark, rows, "wave",
        lambda stream: dedupe_stream(stream, "dedupe", ["l_orderkey", "l_linenumber"], _DEDUPE_ORDER, target, offsets),
    )
    return read_appended(spark, target)


# Deliveries are events with a recorded attempt; each got one to three further outcomes.
_OUTCOME_SQL = """d AS (SELECT 'd-' || event_id AS id, event_id, CAST(event_id % 13 AS INTEGER) AS attempt,
    CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'sending' WHEN 2 THEN 'retrying' WHEN 3 THEN 'delivered' ELSE 'failed' END AS status, ts FROM events),
o AS (SELECT id, CAST(event_id % 13 + i - 1 AS INTEGER) AS attempt, i = 2 AND event_id % 3 = 0 AS delivered, ts + to_seconds(CAST(60 * i AS INTEGER)) AS at_time
  FROM d, unnest(range(0, event_id % 3 + 2)) AS u(i) WHERE i > 0),
n AS (SELECT d.id, max(o.attempt) AS attempt, bool_or(delivered) AS ok, arg_max(at_time, (delivered, o.attempt)) AS at_time
  FROM d JOIN o ON o.id = d.id AND o.attempt > d.attempt WHERE status NOT IN ('delivered', 'failed') GROUP BY d.id)
SELECT d.id, CASE WHEN n.id IS NULL THEN status WHEN ok THEN 'delivered' WHEN n.attempt >= 12 THEN 'failed' ELSE 'retrying' END AS status,
  coalesce(n.attempt, d.attempt) AS attempt, at_time AS last_attempt_at, CASE WHEN ok THEN at_time END AS delivered_at,
  CASE WHEN NOT ok AND n.attempt < 12 THEN at_time + to_seconds(CAST(least(1800, 5 * pow(2, n.attempt - 1)) AS INTEGER)) ELSE ts END AS next_attempt_at,
  CASE WHEN NOT ok THEN 'timeout' END AS error_message FROM d LEFT JOIN n ON n.id = d.id"""


@query("delivery_outcomes", "WITH " + _OUTCOME_SQL)
def delivery_outcomes_query(spark, sf_dir):
    """Outcomes applied twice, with the replay changing nothing."""
    event = F.col("event_id")
    names = F.array(*[F.lit(s) for s in ("pending", "sending", "retrying", "delivered", "failed")])
    events = table(spark, sf_dir, "events")
    no_time = F.lit(None).cast("timestamp_ntz")
    rows = events.select(
        text("d-", event).alias("id"), F.element_at(names, (event % 5 + 1).cast("int")).alias("status"), (event % 13).cast("int").alias("attempt"),
        F.col("ts").alias("next_attempt_at"), no_time.alias("last_attempt_at"), F.lit(None).cast("string").alias("error_message"),
        F.lit(None).cast("string").alias("provider_message_id"), no_time.alias("delivered_at"),
    )
    step = F.explode(F.sequence(F.lit(0).cast("bigint"), event % 3 + 1)).alias("i")
    outcomes = events.select("event_id", "ts", step).filter("i > 0").select(
        text("d-", event).alias("delivery_id"), (event % 13 + F.col("i") - 1).cast("int").alias("attempt"),
        ((F.col("i") == 2) & (event % 3 == 0)).alias("delivered"), F.lit(None).cast("string").alias("provider_message_id"),
        F.lit("timeout").alias("error_message"), (F.col("ts") + F.make_dt_interval(secs=F.col("i") * 60)).alias("attempted_at"),
    )
    once = delivery_outcomes(rows, outcomes)
    return delivery_outcomes(once, outcomes).drop("provider_message_id")


# Cursors are the transfers of a supplier in five waves: three shares in an order of their own,
# a redelivery of the first, and once more the lowest cursors of all.
_CURSORS_SQL = """cursors AS (SELECT l_suppkey AS stream_key, l_orderkey AS cursor, CAST(l_partkey % 3 AS INTEGER) AS wave FROM lineitem),
started AS (SELECT stream_key, min(cursor) FILTER (wave = (SELECT min(wave) FROM cursors x WHERE x.stream_key = c.stream_key)) // 64 * 64 AS s,
  max(cursor) AS high FROM cursors c GROUP BY stream_key),
full_ranges AS (SELECT stream_key, s, greatest((high + 1 - s) // 64, 0) AS n FROM started)"""


def _aggregated(spark, sf_dir):
    state, events, offsets = (scratch_path(spark, n) for n in ("state", "events", "offsets"))
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("stream_key"), F.col("l_orderkey").alias("cursor"), (F.col("l_partkey") % 3).cast("int").alias("wave")
    )
    again = rows.filter("wave = 0").withColumn("wave", F.lit(3))
    low = rows.groupBy("stream_key").agg(F.min("cursor").alias("cursor")).withColumn("wave", F.lit(4))
    drained_in_waves(
        spark, rows.unionByName(again).unionByName(low), "wave",
        lambda stream: range_aggregate_stream(stream, "ranges", 64, state, events, offsets, buckets=4),
    )
    return state, events


@query(
    "range_aggregate_stream",
    with_sql(
        _CURSORS_SQL,
        select="""SELECT stream_key, (s + i * 64) || '-' || (s + i * 64 + 63) AS partition_key, s + i * 64 AS start, s + i * 64 + 63 AS "end"
FROM full_ranges, unnest(range(0, n)) AS u(i)""",
    ),
)
def range_aggregate_stream_query(spark, sf_dir):
    return read_appended(spark, _aggregated(spark, sf_dir)[1])


@query(
    "range_aggregate_stream_state",
    with_sql(_CURSORS_SQL, select="SELECT stream_key, s + n * 64 AS last_emitted_end FROM full_ranges"),
)
def range_aggregate_stream_state(spark, sf_dir):
    return read_committed(spark, _aggregated(spark, sf_dir)[0]).drop("partition_key")


# A block a minute. Half of the blocks arrive, then silence for two ticks, then the rest but
# for chain 2, and last those of chain 2 with old blocks once more. A tick ends each wave.
_TICKS_SQL = """timed AS (SELECT chain_id, block_number, TIMESTAMP '2024-01-01' + to_minutes(CAST(block_number AS INTEGER)) AS block_time,
    CASE WHEN block_number <= half THEN 1 WHEN chain_id <> 2 THEN 4 ELSE 5 END AS wave, half, top
  FROM blocks, (SELECT max(block_number) // 2 AS half, max(block_number) AS top FROM blocks)),
ticks AS (SELECT w, TIMESTAMP '2024-01-01' + to_minutes(CAST(CASE w WHEN 1 THEN half + 1 WHEN 2 THEN half + 600 WHEN 3 THEN half + 4320 ELSE top + w + 4320 END AS INTEGER)) AS judged_at
  FROM (SELECT any_value(half) AS half, any_value(top) AS top FROM timed), unnest([1, 2, 3, 4, 5]) AS u(w)),
judged AS (SELECT w, chain_id, judged_at, max(block_number) AS last_block, max(block_time + to_minutes(CASE WHEN wave > 1 THEN 4320 ELSE 0 END)) AS last_block_time
  FROM ticks JOIN timed ON wave <= w GROUP BY w, chain_id, judged_at),
gaps AS (SELECT *, date_diff('millisecond', last_block_time, judged_at) AS gap_ms FROM judged),
events AS (SELECT chain_id, judged_at, last_block, last_block_time, gap_ms, w,
  CASE WHEN gap_ms <= 7200000 THEN 'ok' WHEN gap_ms < 86400000 THEN 'degraded' ELSE 'stalled' END AS status FROM gaps)"""


def _ticked(spark, sf_dir, changes_only=False):
    state, events, offsets = (scratch_path(spark, n) for n in ("state", "events", "offsets"))
    blocks, number = v.blocks(spark, sf_dir).select("chain_id", "block_number"), F.col("block_number")
    top = blocks.agg(F.max("block_number")).first()[0]
    half = top // 2

    def minutes(count):
        return at("2024-01-01") + F.make_dt_interval(mins=count.cast("int"))

    wave = F.when(number <= half, 1).when(F.col("chain_id") != 2, 4).otherwise(5)
    rows = blocks.withColumn("wave", wave).withColumn("block_time", minutes(number + F.when(F.col("wave") > 1, 4320).otherwise(0)))
    again = rows.filter((F.col("wave") == 1) & (number % 2 == 0)).withColumn("wave", F.lit(5))
    rows = rows.unionByName(again).withColumn("at", F.lit(None).cast("timestamp_ntz"))
    moments = [(1, half + 1), (2, half + 600), (3, half + 4320), (4, top + 4 + 4320), (5, top + 5 + 4320)]
    ticks = spark.createDataFrame(moments, "wave int, n long").select(
        *[F.lit(None).cast(k).alias(c) for c, k in (("chain_id", "bigint"), ("block_number", "bigint"), ("block_time", "timestamp_ntz"))],
        minutes(F.col("n")).alias("at"), "wave",
    )
    drained_in_waves(
        spark, rows.unionByName(ticks), "wave",
        lambda stream: liveliness_stream(
            stream.filter("at IS NULL"), stream.filter("at IS NOT NULL").select("at"), "live", state, events, offsets,
            7_200_000, 86_400_000, changes_only,
        ),
    )
    return read_appended(spark, events)


@query("liveliness_stream", with_sql(v.BLOCKS_SQL, _TICKS_SQL, select="SELECT chain_id, judged_at, last_block, last_block_time, gap_ms, status FROM events"))
def liveliness_stream_query(spark, sf_dir):
    return _ticked(spark, sf_dir)


@query(
    "liveliness_changes",
    with_sql(
        v.BLOCKS_SQL, _TICKS_SQL,
        select="""SELECT chain_id, judged_at, last_block, last_block_time, gap_ms, status FROM events
QUALIFY status IS DISTINCT FROM lag(status) OVER (PARTITION BY chain_id ORDER BY w)""",
    ),
)
def liveliness_changes(spark, sf_dir):
    return _ticked(spark, sf_dir, changes_only=True)
