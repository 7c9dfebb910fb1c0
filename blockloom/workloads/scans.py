"""Source queries."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from blockloom.session import scratch_path
from blockloom.sources.attach import attach_pinned, attach_prefix
from blockloom.sources.jsonl import read_jsonl_batches
from blockloom.sources.labels import load_labels
from blockloom.sources.manifests import MANIFEST_NAME, manifest_audit
from blockloom.sources.registry import resolve_dataset
from blockloom.sources.synth import synth_blocks
from blockloom.sources.unify import hot_cold_union
from blockloom.workloads.registry import query
from blockloom.workloads.views import BLOCKS_SQL, blocks, table, text, with_sql

DATASET, VERSION = "7d3c2f64-3a5e-5b1f-9d70-0c5a4de0a001", "7d3c2f64-3a5e-5b1f-9d70-0c5a4de0a002"


def write_text(spark, path: str, body: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, False)
    stream.write(bytearray(body.encode("utf-8")))
    stream.close()


@query("attach_pinned", "SELECT * FROM orders")
def attach_pinned_query(spark, sf_dir):
    """Blocks written under a version prefix together with a file the manifest does not list."""
    root = scratch_path(spark, "pinned")
    orders = table(spark, sf_dir, "orders")
    orders.repartition(4, "o_orderkey").write.parquet(f"{root}/data/v1/kept")
    orders.write.parquet(f"{root}/data/v1/stray")
    files = spark.read.parquet(f"{root}/data/v1/kept").select(F.col("_metadata.file_path").alias("path")).distinct()
    keys = sorted("data/v1/kept/" + r.path.rsplit("/", 1)[1] for r in files.collect())
    body = {"version": 1, "dataset_uuid": DATASET, "dataset_version": VERSION, "parquet_keys": keys}
    write_text(spark, f"{root}/data/v1/{MANIFEST_NAME}", json.dumps(body))
    return attach_pinned(spark, root, "data/v1", DATASET, VERSION)


@query("attach_prefix", "SELECT * FROM lineitem")
def attach_prefix_query(spark, sf_dir):
    return attach_prefix(spark, sf_dir, "lineitem.parquet")


_AUDIT_SQL = """SELECT 'cryo/' || o_orderkey AS storage_prefix, rule, parquet_key FROM (
  SELECT o_orderkey, 'unsupported_version' AS rule, NULL AS parquet_key FROM orders WHERE o_orderkey % 11 = 0
  UNION ALL SELECT o_orderkey, 'registry_mismatch', NULL FROM orders WHERE o_orderkey % 17 = 0 OR o_orderkey % 19 = 0
  UNION ALL SELECT o_orderkey, 'no_objects', NULL FROM orders WHERE o_orderkey % 13 = 0
  UNION ALL SELECT o_orderkey, 'too_many_objects', NULL FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 23 = 0
  UNION ALL SELECT o_orderkey, 'outside_prefix', 'cryo/' || o_orderkey || '-x/b.parquet' FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 5 = 0
  UNION ALL SELECT o_orderkey, 'backslash', '/cryo/' || o_orderkey || '/c' || chr(92) || '.PARQUET' FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 7 = 0
  UNION ALL SELECT o_orderkey, 'not_parquet', 'cryo/' || o_orderkey || '/d.csv' FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 3 = 0)"""


@query("manifest_audit", _AUDIT_SQL)
def manifest_audit_query(spark, sf_dir):
    key = F.col("o_orderkey")
    prefix = text("cryo/", key)
    keys = F.array_compact(
        F.array(
            F.concat(prefix, F.lit("/a.parquet")),
            F.when(key % 5 == 0, F.concat(prefix, F.lit("-x/b.parquet"))),
            F.when(key % 7 == 0, F.concat(F.lit("/"), prefix, F.lit("/c\\.PARQUET"))),
            F.when(key % 3 == 0, F.concat(prefix, F.lit("/d.csv"))),
        )
    )
    many = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.concat(prefix, F.lit("/m"), i.cast("string"), F.lit(".parquet")))
    orders = table(spark, sf_dir, "orders")
    manifests = orders.select(
        prefix.alias("storage_prefix"),
        F.when(key % 11 == 0, 2).otherwise(1).alias("version"),
        text("d-", key).alias("dataset_uuid"),
        text("v-", key).alias("dataset_version"),
        F.when(key % 13 == 0, F.array().cast("array<string>"))
        .when(key % 23 == 0, F.concat(keys, many))
        .otherwise(keys)
        .alias("parquet_keys"),
    )
    registry = orders.filter(key % 19 != 0).select(
        prefix.alias("storage_prefix"),
        text("d-", key).alias("dataset_uuid"),
        F.when(key % 17 == 0, F.lit("v-other")).otherwise(text("v-", key)).alias("dataset_version"),
    )
    return manifest_audit(manifests, registry, max_objects=9).select("storage_prefix", "rule", "parquet_key")


# Every event is one line of one of 64 batch files; a bad line rejects its whole file.
_JSONL_SQL = """SELECT '00000000-0000-0000-0000-' || lpad(CAST(user_id AS VARCHAR), 12, '0') AS alert_definition_id,
  'k' || event_id AS dedupe_key, epoch_us(ts) AS event_micros, user_id % 3 AS chain_id, event_id AS block_number,
  printf('0x%016x', event_id) AS block_hash, printf('0xtx%016x', event_id) AS tx_hash, replace(props, ' ', '') AS payload
FROM events WHERE event_id % 64 NOT IN (SELECT event_id % 64 FROM events WHERE event_id % 1009 = 1008)"""


def event_lines(spark, sf_dir):
    """(file number, line): valid lines, some blank ones, and bad lines of six kinds."""
    from blockloom.functions.ids import block_hash, tx_hash

    event, micros = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    fields = {
        "alert_definition_id": F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(F.col("user_id").cast("string"), 12, "0")),
        "dedupe_key": text("k", event),
        "event_time": micros,
        "chain_id": F.col("user_id") % 3,
        "block_number": event,
        "block_hash": block_hash("event_id"),
        "tx_hash": tx_hash("event_id"),
    }
    head = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    line = F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"payload":'), F.col("props"), F.lit("}"))
    bad, kind = event % 1009 == 1008, F.floor(event / 1009) % 6
    broken = (
        F.when(kind == 0, F.lit("not json"))
        .when(kind == 1, F.regexp_replace(line, '"payload":.*$', '"payload":"text"}'))
        .when(kind == 2, F.regexp_replace(line, r"\}$", ',"extra":1}'))
        .when(kind == 3, F.regexp_replace(line, '"chain_id":(\\d+)', '"chain_id":"$1"'))
        .when(kind == 4, F.regexp_replace(line, "Z\"", '"'))
        .otherwise(F.concat(line, F.lit("}")))
    )
    blank = F.when(event % 10 == 0, F.array(line, F.lit("   "))).otherwise(F.array(line))
    return table(spark, sf_dir, "events").select(
        (event % 64).alias("file"), F.explode(F.when(bad, F.array(broken)).otherwise(blank)).alias("value")
    )


@query("read_jsonl_batches", _JSONL_SQL)
def read_jsonl_batches_query(spark, sf_dir):
    root = scratch_path(spark, "jsonl")
    event_lines(spark, sf_dir).repartition(8, "file").write.partitionBy("file").text(root)
    good, _ = read_jsonl_batches(spark, root)
    return good.drop("file").withColumn("event_time", F.unix_micros("event_time")).withColumnRenamed("event_time", "event_micros")


@query(
    "dead_letter_batches",
    """SELECT event_id % 64 AS file, count(*) AS bad_lines, min(CASE event_id // 1009 % 6 WHEN 1 THEN 'payload must be an object'
  WHEN 2 THEN 'unknown field' WHEN 3 THEN 'wrong type' WHEN 4 THEN 'bad event_time' ELSE 'not json' END) AS error
FROM events WHERE event_id % 1009 = 1008 GROUP BY 1""",
)
def dead_letter_batches(spark, sf_dir):
    root = scratch_path(spark, "jsonl")
    event_lines(spark, sf_dir).repartition(8, "file").write.partitionBy("file").text(root)
    _, rejected = read_jsonl_batches(spark, root)
    number = F.regexp_extract("file", r"/file=(\d+)/", 1).cast("bigint")
    return rejected.select(number.alias("file"), "bad_lines", "error")


@query(
    "hot_cold_union",
    with_sql(
        BLOCKS_SQL,
        select="""SELECT chain_id, block_number, CASE WHEN u THEN 'hot' || block_hash ELSE block_hash END AS block_hash, block_time,
  CASE WHEN u THEN 1 END AS extra
FROM blocks JOIN (SELECT o_orderkey, o_orderpriority = '1-URGENT' AS u FROM orders) ON o_orderkey = block_number""",
    ),
)
def hot_cold_union_query(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    hot = blocks(spark, sf_dir).join(urgent.select(F.col("o_orderkey").alias("block_number")), "block_number")
    hot = hot.withColumns({"block_hash": F.concat(F.lit("hot"), "block_hash"), "extra": F.lit(1)})
    return hot_cold_union(hot, blocks(spark, sf_dir), ["chain_id", "block_number"], "block_number")


@query(
    "synth_blocks",
    """SELECT DISTINCT o_custkey % 3 AS chain_id, o_orderkey * 10 + d AS block_number, printf('0x%016x', o_orderkey * 10 + d) AS block_hash
FROM (SELECT o_orderkey, o_custkey, unnest([0, least(1, greatest(o_custkey % 5 - 1, 0)), greatest(o_custkey % 5 - 1, 0)]) AS d FROM orders)""",
)
def synth_blocks_query(spark, sf_dir):
    start = F.col("o_orderkey") * 10
    ranges = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 3).alias("chain_id"), start.alias("range_start"), (start + F.col("o_custkey") % 5).alias("range_end")
    )
    return synth_blocks(ranges)


@query(
    "resolve_dataset",
    """SELECT 'name_' || p_partkey AS dataset_name, 'ds-' || p_partkey AS dataset_uuid, 'ds-' || p_partkey || '-' || p_brand AS dataset_version,
  's3://cold/' || p_partkey || '/' AS storage_prefix, '*.parquet' AS storage_glob FROM part WHERE p_size % 5 <> 0""",
)
def resolve_dataset_query(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    uuid = text("ds-", key)
    version = F.concat(uuid, F.lit("-"), F.col("p_brand"))
    old = F.concat(uuid, F.lit("-old"))
    return resolve_dataset(
        part.select(text("name_", key).alias("dataset_name")),
        part.select(text("name_", key).alias("dataset_name"), uuid.alias("dataset_uuid"), F.col("p_brand").alias("dag_name")),
        part.select(F.col("p_brand").alias("dag_name"), F.concat(F.col("p_brand"), F.lit(":2")).alias("dag_version")).distinct(),
        part.select(F.concat(F.col("p_brand"), F.lit(":1")).alias("dag_version"), uuid.alias("dataset_uuid"), old.alias("dataset_version"))
        .unionByName(
            part.filter("p_size % 5 <> 0").select(
                F.concat(F.col("p_brand"), F.lit(":2")).alias("dag_version"), uuid.alias("dataset_uuid"), version.alias("dataset_version")
            )
        ),
        part.select(version.alias("dataset_version"), F.concat(F.lit("s3://cold/"), key.cast("string"), F.lit("/")).alias("storage_prefix"))
        .withColumn("storage_glob", F.lit("*.parquet")),
    )


@query(
    "load_labels",
    """SELECT org_id, user_id, address, label, min(id) AS id, arg_min(visibility, id) AS visibility FROM (
  SELECT CAST(1000000 + c_custkey AS VARCHAR) AS id, 'org-' || (c_nationkey % 5) AS org_id, 'user-' || (c_custkey % 7) AS user_id,
    '0x' || (c_custkey % 40) AS address, c_mktsegment AS label, CASE WHEN c_custkey % 2 = 0 THEN 'org' ELSE 'private' END AS visibility
  FROM customer) GROUP BY org_id, user_id, address, label""",
)
def load_labels_query(spark, sf_dir):
    root, key = scratch_path(spark, "labels"), F.col("c_custkey")
    table(spark, sf_dir, "customer").select(
        (key + 1000000).cast("string").alias("id"),
        text("org-", F.col("c_nationkey") % 5).alias("org_id"),
        text("user-", key % 7).alias("user_id"),
        text("0x", key % 40).alias("address"),
        F.col("c_mktsegment").alias("label"),
        F.when(key % 2 == 0, "org").otherwise("private").alias("visibility"),
    ).write.option("header", "true").csv(root)
    return load_labels(spark, root, "csv")
