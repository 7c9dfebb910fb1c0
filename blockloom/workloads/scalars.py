"""Scalar function queries over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom.functions import checks, ids, values
from blockloom.workloads.registry import query
from blockloom.workloads.views import table


def uuid5_sql(namespace: str, name: str) -> str:
    h = f"sha1(unhex('{namespace.replace('-', '')}') || encode({name}))"
    nibble = f"substr('89ab', 1 + (instr('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4, 1)"
    return (
        f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || "
        f"{nibble} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"
    )


_END = "o_orderkey + 1 + o_custkey % 9"


@query(
    "uuid5",
    f"""SELECT o_orderkey, {uuid5_sql(ids.TASK_NAMESPACE, f"'chain_sync:job-' || o_custkey || ':blocks:' || o_orderkey || ':' || ({_END})")} AS task_id,
  {uuid5_sql(ids.DATASET_NAMESPACE, "'chain_sync:org:' || (o_custkey % 3) || ':' || o_orderpriority")} AS dataset_uuid,
  {uuid5_sql(ids.VERSION_NAMESPACE, f"'cryo_ingest:d:cfg:' || (o_custkey % 3) || ':' || o_orderkey || ':' || ({_END})")} AS dataset_version
FROM orders""",
)
def uuid5(spark, sf_dir):
    chain, end = F.col("o_custkey") % 3, F.col("o_orderkey") + 1 + F.col("o_custkey") % 9
    job = F.concat(F.lit("job-"), F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        ids.task_id(job, F.lit("blocks"), "o_orderkey", end).alias("task_id"),
        ids.dataset_uuid(F.lit("org"), chain, "o_orderpriority").alias("dataset_uuid"),
        ids.dataset_version(F.lit("d"), F.lit("cfg"), chain, "o_orderkey", end).alias("dataset_version"),
    )


@query("block_hash", "SELECT o_orderkey, printf('0x%016x', o_orderkey) AS block_hash, printf('0xtx%016x', o_orderkey) AS tx_hash FROM orders")
def block_hash(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", ids.block_hash("o_orderkey").alias("block_hash"), ids.tx_hash("o_orderkey").alias("tx_hash")
    )


@query(
    "hex_to_bigint",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 4 THEN o_orderkey * 1000003 WHEN o_orderkey % 7 = 4 THEN 9223372036854775807 END AS value
FROM orders""",
)
def hex_to_bigint(spark, sf_dir):
    kind, digits = F.col("o_orderkey") % 7, F.lower(F.hex(F.col("o_orderkey") * 1000003))
    written = (
        F.when(kind == 0, F.concat(F.lit("0x"), digits))
        .when(kind == 1, F.concat(F.lit("  0x"), F.upper(digits), F.lit("\n")))
        .when(kind == 2, digits)
        .when(kind == 3, F.concat(F.lit("0x"), F.lpad(digits, 30, "0")))
        .when(kind == 4, F.lit("0x7fffffffffffffff"))
        .when(kind == 5, F.lit("0x8000000000000000"))
        .otherwise(F.concat(F.lit("0xzz"), digits))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", ids.hex_to_bigint(written).alias("value"))


@query(
    "dedupe_key",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  concat_ws(':', l_orderkey, l_linenumber, l_partkey) AS dedupe_key,
  'alert_eval:' || l_suppkey || ':v1:' || l_orderkey AS alert_key,
  sha256('{"l_orderkey":' || l_orderkey || ',"l_returnflag":"' || l_returnflag || '"}') AS content_key
FROM lineitem""",
)
def dedupe_key(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        ids.dedupe_key("l_orderkey", "l_linenumber", "l_partkey").alias("dedupe_key"),
        ids.alert_key("l_suppkey", F.lit("v1"), "l_orderkey").alias("alert_key"),
        ids.content_key("l_orderkey", "l_returnflag").alias("content_key"),
    )


@query(
    "partition_key",
    """SELECT o_orderkey, (o_orderkey * 100) || '-' || (o_orderkey * 100 + o_custkey) AS partition_key,
  o_orderkey * 100 AS range_start, o_orderkey * 100 + o_custkey + 1 AS range_end FROM orders""",
)
def partition_key(spark, sf_dir):
    from blockloom.operators.ranges import format_partition_keys, parse_partition_keys

    ranges = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (F.col("o_orderkey") * 100).alias("range_start"),
        (F.col("o_orderkey") * 100 + F.col("o_custkey") + 1).alias("range_end"),
    )
    return parse_partition_keys(format_partition_keys(ranges).select("o_orderkey", "partition_key"))


@query(
    "is_json_object",
    """SELECT event_id, event_id % 6 IN (0, 5) AS is_object FROM events""",
)
def is_json_object(spark, sf_dir):
    kind, props = F.col("event_id") % 6, F.col("props")
    written = (
        F.when(kind == 0, props)
        .when(kind == 1, F.concat(F.lit("["), props, F.lit("]")))
        .when(kind == 2, F.to_json(F.struct("props")).substr(F.lit(10), F.length(props)))
        .when(kind == 3, F.concat(props, F.lit("}")))
        .when(kind == 4, F.lit(None).cast("string"))
        .otherwise(F.lit("{}"))
    )
    return table(spark, sf_dir, "events").select("event_id", checks.is_json_object(written).alias("is_object"))


@query(
    "parse_rfc3339",
    """SELECT event_id, CASE WHEN event_id % 6 IN (0, 1) THEN epoch_us(ts) WHEN event_id % 6 = 2 THEN epoch_us(ts) - 5400000000 END AS micros
FROM events""",
)
def parse_rfc3339(spark, sf_dir):
    kind = F.col("event_id") % 6
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    written = (
        F.when(kind == 0, F.concat(iso, F.lit("Z")))
        .when(kind == 1, F.concat(F.lower(iso), F.lit("z")))
        .when(kind == 2, F.concat(iso, F.lit("+01:30")))
        .when(kind == 3, iso)
        .when(kind == 4, F.concat(F.substring(iso, 1, 10), F.lit("Z")))
        .otherwise(F.concat(F.lit("2024-13-45"), F.substring(iso, 11, 20), F.lit("Z")))
    )
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(checks.parse_rfc3339(written)).alias("micros"))


_NAME_SQL = "CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN p_name ELSE p_partkey || '_' || p_type END"


def _names(spark, sf_dir):
    key = F.col("p_partkey")
    name = (
        F.when(key % 3 == 0, F.replace("p_name", F.lit(" "), F.lit("_")))
        .when(key % 3 == 1, F.col("p_name"))
        .otherwise(F.concat(key.cast("string"), F.lit("_"), "p_type"))
    )
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))


@query("is_dataset_name", f"SELECT p_partkey, {_NAME_SQL} AS name, regexp_full_match({_NAME_SQL}, '[a-z][a-z0-9_]{{0,127}}') AS valid FROM part")
def is_dataset_name(spark, sf_dir):
    return _names(spark, sf_dir).withColumn("valid", checks.is_dataset_name("name"))


@query("is_slug", f"SELECT p_partkey, {_NAME_SQL} AS name, regexp_full_match(lower({_NAME_SQL}), '[a-z0-9_]{{1,64}}') AS valid FROM part")
def is_slug(spark, sf_dir):
    return _names(spark, sf_dir).withColumn("valid", checks.is_slug(F.lower("name")))


@query(
    "under_prefix",
    """SELECT page_id, CASE page_id % 5 WHEN 0 THEN true WHEN 3 THEN true ELSE false END AS allowed FROM pages""",
)
def under_prefix(spark, sf_dir):
    key = F.col("page_id")
    uri = F.concat(
        F.when(key % 5 == 0, F.lit("s3://data/foo/"))
        .when(key % 5 == 1, F.lit("s3://data/foo-bar/"))
        .when(key % 5 == 2, F.lit("s3://other/foo/"))
        .when(key % 5 == 3, F.lit("s3://data//foo/"))
        .otherwise(F.lit("file:///data/foo/")),
        F.sha2("html", 256),
    )
    return table(spark, sf_dir, "pages").select("page_id", checks.under_prefix(uri, "s3://data/foo").alias("allowed"))


@query(
    "backoff",
    """SELECT event_id, least(1800.0, 5.0 * pow(2.0, event_id % 13))::DOUBLE AS delay,
  least(600.0, 30.0 * pow(2.0, event_id % 7))::DOUBLE * CAST(0.5 AS DOUBLE) AS jittered FROM events""",
)
def backoff(spark, sf_dir):
    event = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        values.backoff(event % 13, values.DELIVERY_BASE_SECONDS, values.DELIVERY_CAP_SECONDS).alias("delay"),
        values.backoff(event % 7, 30, 600, F.lit(0.5)).alias("jittered"),
    )


@query(
    "is_distinct",
    """SELECT o_orderkey, nullif(o_orderstatus, 'P') IS DISTINCT FROM CASE WHEN o_orderkey % 3 = 0 THEN 'F' END AS changed FROM orders""",
)
def is_distinct(spark, sf_dir):
    left = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    right = F.when(F.col("o_orderkey") % 3 == 0, "F")
    return table(spark, sf_dir, "orders").select("o_orderkey", checks.is_distinct(left, right).alias("changed"))


@query(
    "greatest_least_coalesce",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(l_partkey, l_suppkey) AS high, least(l_partkey, l_suppkey) AS low,
  coalesce(nullif(l_returnflag, 'N'), l_linestatus) AS flag FROM lineitem""",
)
def greatest_least_coalesce(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.greatest("l_partkey", "l_suppkey").alias("high"),
        F.least("l_partkey", "l_suppkey").alias("low"),
        F.coalesce(F.nullif(F.col("l_returnflag"), F.lit("N")), "l_linestatus").alias("flag"),
    )


@query(
    "clip_message",
    """SELECT doc_id, CASE WHEN strlen(text) <= 1024 THEN text
  ELSE left(text, list_max(list_filter(range(0, 1025), lambda n: strlen(left(text, n)) <= 1024))) END AS message FROM documents""",
)
def clip_message(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", values.clip_message("text").alias("message"))


@query(
    "severity_rank",
    """SELECT event_id, CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 WHEN 'view' THEN 0 END AS rank FROM events""",
)
def severity_rank(spark, sf_dir):
    kind = F.col("event_type")
    name = F.when(kind == "error", "critical").when(kind == "purchase", "warning").when(kind == "view", "info").otherwise(kind)
    return table(spark, sf_dir, "events").select("event_id", values.severity_rank(name).alias("rank"))


@query(
    "schema_hash",
    """SELECT o_orderstatus, count(*) AS n, sha256('o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double,o_orderdate:timestamp_ntz,o_orderpriority:string') AS schema_hash
FROM orders GROUP BY o_orderstatus""",
)
def schema_hash(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).withColumn("schema_hash", values.schema_hash(orders))


@query("config_hash", "SELECT p_partkey, 'cryo_ingest.' || replace(p_name, ' ', '_') || ':v1' AS config_hash FROM part")
def config_hash(spark, sf_dir):
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    return table(spark, sf_dir, "part").select("p_partkey", values.config_hash(name).alias("config_hash"))


@query("sql_hash", "SELECT conv_id, turn, sha256(text) AS sql_hash FROM conversations")
def sql_hash(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", values.sql_hash("text").alias("sql_hash"))


@query("date_trunc", "SELECT event_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day FROM events")
def date_trunc(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", values.day_of("ts").alias("day"))
