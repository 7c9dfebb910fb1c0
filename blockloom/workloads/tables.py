"""Sink and table maintenance queries: each returns the table content after the writes."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from blockloom.functions.ids import partition_key
from blockloom.operators import aggregates
from blockloom.session import scratch_path
from blockloom.sinks import versions
from blockloom.sinks.append import append_dedupe, read_appended
from blockloom.sinks.compact import compact_finalized, purge_range
from blockloom.sinks.export import export_result
from blockloom.sinks.files import expired_staging, list_files, output_caps
from blockloom.sinks.publish import publish_ranges
from blockloom.sinks.scopes import commit_log, partition_versions, read_committed, replace_scope, replace_scopes
from blockloom.sources.attach import attach_versions
from blockloom.workloads import views as v
from blockloom.workloads.registry import query
from blockloom.workloads.views import table, text, with_sql

TIE_BREAK = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


@query(
    "append_dedupe",
    """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rn FROM lineitem) WHERE rn = 1""",
)
def append_dedupe_query(spark, sf_dir):
    """Three batches: returned items, all items, and a replay of the first."""
    target, rows = scratch_path(spark, "append"), table(spark, sf_dir, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    returned = rows.filter("l_returnflag = 'A'")
    for batch_id, batch in (("b1", returned), ("b2", rows), ("b1", returned)):
        append_dedupe(target, batch, keys, TIE_BREAK, batch_id, range_column="l_orderkey")
    return read_appended(spark, target)


SCOPE = 5000


def scoped_blocks(spark, sf_dir):
    start = F.floor(F.col("block_number") / SCOPE) * SCOPE
    return v.blocks(spark, sf_dir).withColumn("partition_key", partition_key(start, start + SCOPE))


SCOPED_SQL = f"""scoped AS (SELECT *, (block_number // {SCOPE} * {SCOPE}) || '-' || (block_number // {SCOPE} * {SCOPE} + {SCOPE - 1}) AS partition_key FROM blocks)"""


@query(
    "replace_scope",
    with_sql(
        v.BLOCKS_SQL, SCOPED_SQL,
        select="""SELECT chain_id, block_number, CASE WHEN partition_key = '0-4999' THEN 'new' || block_hash ELSE block_hash END AS block_hash, block_time, partition_key
FROM scoped WHERE partition_key <> '5000-9999'""",
    ),
)
def replace_scope_query(spark, sf_dir):
    """Load all scopes, rewrite the first, empty the second, leave an uncommitted attempt."""
    root, rows = scratch_path(spark, "scopes"), scoped_blocks(spark, sf_dir)
    replace_scopes(rows, root)
    first = rows.filter("partition_key = '0-4999'").withColumn("block_hash", F.concat(F.lit("new"), "block_hash"))
    replace_scope(first, root, "0-4999")
    replace_scope(rows.limit(0), root, "5000-9999")
    rows.withColumn("scope", F.col("partition_key")).write.partitionBy("scope").parquet(f"{root}/data/attempt=a-crashed")
    return read_committed(spark, root)


@query(
    "partition_stats",
    with_sql(
        v.BLOCKS_SQL, SCOPED_SQL,
        select="""SELECT partition_key, count(*) AS row_count, true AS has_bytes,
  sha256('chain_id:bigint,block_number:bigint,block_hash:string,block_time:timestamp_ntz,partition_key:string') AS schema_hash FROM scoped GROUP BY partition_key""",
    ),
)
def partition_stats_query(spark, sf_dir):
    root = scratch_path(spark, "stats")
    replace_scopes(scoped_blocks(spark, sf_dir), root)
    files = list_files(spark, f"{root}/data").withColumn("partition_key", F.regexp_extract("path", r"/scope=([^/]+)/", 1))
    stats = aggregates.partition_stats(read_committed(spark, root), files)
    return stats.select("partition_key", "row_count", (F.col("bytes") > 0).alias("has_bytes"), "schema_hash")


def _chain_ranges(spark, sf_dir, size=2500):
    """Ranges that cover the blocks of each chain; the last one is short."""
    top = F.max("block_number") + 1
    spans = v.blocks(spark, sf_dir).groupBy("chain_id").agg(top.alias("top"))
    start = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("top") - 1, F.lit(size).cast("bigint")))
    return spans.select("chain_id", "top", start.alias("range_start")).select(
        text("ds-", F.col("chain_id")).alias("dataset_uuid"),
        "chain_id",
        "range_start",
        F.least(F.col("range_start") + size, F.col("top")).alias("range_end"),
        F.lit("cryo_ingest.blocks:v1").alias("config_hash"),
    )


@query(
    "publish_ranges",
    with_sql(
        v.BLOCKS_SQL,
        select="""SELECT chain_id, block_number, block_hash, block_time, block_number // 2500 * 2500 AS range_start FROM blocks""",
    ),
)
def publish_ranges_query(spark, sf_dir):
    """Publish twice, then read every version back through the manifests."""
    root, blocks, ranges = scratch_path(spark, "publish"), v.blocks(spark, sf_dir), _chain_ranges(spark, sf_dir)
    publish_ranges(blocks, ranges, root)
    published = publish_ranges(blocks, ranges, root)
    rows = attach_versions(published, root).withColumn("_path", F.col("_metadata.file_path"))
    start = F.regexp_extract("_path", r"/range=(\d+)_", 1).cast("bigint")
    return rows.select("chain_id", "block_number", "block_hash", "block_time", start.alias("range_start"))


@query(
    "output_caps",
    """WITH files AS (SELECT o_custkey AS range_key, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS length FROM orders),
r AS (SELECT range_key, count(*) AS files, max(length) AS largest_file, CAST(sum(length) AS BIGINT) AS total_bytes FROM files GROUP BY range_key)
SELECT range_key, 'files' AS measure, files AS value, CAST(12 AS BIGINT) AS "limit" FROM r WHERE files > 12
UNION ALL SELECT range_key, 'largest_file', largest_file, 450000 FROM r WHERE largest_file > 450000
UNION ALL SELECT range_key, 'total_bytes', total_bytes, 2500000 FROM r WHERE total_bytes > 2500000""",
)
def output_caps_query(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("range_key"), F.floor("o_totalprice").cast("bigint").alias("length")
    )
    return output_caps(files, max_files=12, max_file_bytes=450_000, max_total_bytes=2_500_000)


# The registry holds two thirds of the versions; some publications differ, some come twice.
_REGISTER_SQL = """judged AS (
  SELECT o_orderkey, o_orderkey % 3 <> 0 AS recorded, o_orderkey % 10 = 0 AS changed, o_orderkey % 14 = 0 AS twice FROM orders)"""


def _publications(spark, sf_dir):
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")

    def rows(df, config):
        return df.select(
            text("v-", key).alias("dataset_version"),
            text("ds-", F.col("o_custkey")).alias("dataset_uuid"),
            text("s3://cold/", key).alias("storage_prefix"),
            F.lit("*.parquet").alias("storage_glob"),
            config.alias("config_hash"),
            (key * 10).alias("range_start"),
            (key * 10 + 10).alias("range_end"),
        )

    registry = rows(orders.filter(key % 3 != 0), F.lit("cfg"))
    once = rows(orders, F.when(key % 10 == 0, "changed").otherwise("cfg"))
    again = rows(orders.filter(key % 14 == 0), F.lit("second"))
    return registry, once.unionByName(once).unionByName(again)


@query(
    "register_versions",
    with_sql(
        _REGISTER_SQL,
        select="""SELECT 'v-' || j.o_orderkey AS dataset_version, 'ds-' || o_custkey AS dataset_uuid, 's3://cold/' || j.o_orderkey AS storage_prefix,
  '*.parquet' AS storage_glob, CASE WHEN changed THEN 'changed' ELSE 'cfg' END AS config_hash, j.o_orderkey * 10 AS range_start, j.o_orderkey * 10 + 10 AS range_end
FROM judged j JOIN orders o ON o.o_orderkey = j.o_orderkey WHERE NOT recorded AND NOT twice""",
    ),
)
def register_versions_query(spark, sf_dir):
    return versions.register_versions(*_publications(spark, sf_dir))[0]


@query(
    "version_conflicts",
    with_sql(
        _REGISTER_SQL,
        select="""SELECT 'v-' || o_orderkey AS dataset_version, config_hash, CASE WHEN recorded AND config_hash <> 'cfg' THEN 'differs from registry' ELSE 'differs within batch' END AS reason
FROM (SELECT *, unnest(CASE WHEN twice THEN [CASE WHEN changed THEN 'changed' ELSE 'cfg' END, 'second'] WHEN recorded AND changed THEN ['changed'] ELSE [] END) AS config_hash FROM judged)""",
    ),
)
def version_conflicts(spark, sf_dir):
    return versions.register_versions(*_publications(spark, sf_dir))[1].select("dataset_version", "config_hash", "reason")


@query("export_result", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def export_result_query(spark, sf_dir):
    """Exported as JSON and read back."""
    path = scratch_path(spark, "export")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    result = export_result(rows, path, "json")
    if result.bytes <= 0 or result.row_count != spark.read.schema(rows.schema).json(path).count():
        raise RuntimeError(f"export does not add up: {result}")
    return spark.read.schema(rows.schema).json(path)


def _compacted(spark, sf_dir):
    hot, cold = scratch_path(spark, "hot"), scratch_path(spark, "cold")
    replace_scopes(scoped_blocks(spark, sf_dir), hot)
    top = int(read_committed(spark, hot).agg(F.max("block_number")).first()[0])
    # Every scope, the newest alone and the others together: one partition may span many.
    last = top // SCOPE * SCOPE
    partitions = [f"0-{last - 1}"] * (last > 0) + [f"{last}-{last + SCOPE - 1}"]
    for partition in partitions:
        compact_finalized(read_committed(spark, hot), cold, partition, finality_depth=100, chunk_size=2000)
    return hot, cold, partitions


_FINAL_SQL = f"""final AS (SELECT s.* FROM scoped s JOIN (SELECT chain_id, max(block_number) AS tip FROM blocks GROUP BY chain_id) t ON s.chain_id = t.chain_id
  WHERE block_number <= tip - 100)"""


@query(
    "compact_finalized",
    with_sql(
        v.BLOCKS_SQL, SCOPED_SQL, _FINAL_SQL,
        select=f"""SELECT chain_id, block_number, block_hash, block_time,
  CASE WHEN block_number < last THEN '0-' || (last - 1) ELSE last || '-' || (last + {SCOPE} - 1) END AS partition_key
FROM final, (SELECT max(block_number) // {SCOPE} * {SCOPE} AS last FROM blocks)""",
    ),
)
def compact_finalized_query(spark, sf_dir):
    _, cold, _ = _compacted(spark, sf_dir)
    return read_committed(spark, cold)


@query(
    "purge_range",
    with_sql(
        v.BLOCKS_SQL, SCOPED_SQL, _FINAL_SQL,
        select="SELECT * FROM scoped WHERE (chain_id, block_number) NOT IN (SELECT chain_id, block_number FROM final)",
    ),
)
def purge_range_query(spark, sf_dir):
    hot, cold, partitions = _compacted(spark, sf_dir)
    for partition in partitions:
        purge_range(spark, hot, partition, cold)
    return read_committed(spark, hot)


# History: one DAG per brand; version 1 points every part dataset, the staged set changes some.
def _pointers(spark, sf_dir):
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")

    def rows(df, dag_version, version):
        return df.select(
            F.col("p_brand").alias("dag_name"), F.lit(dag_version).alias("dag_version"),
            text("ds-", key).alias("dataset_uuid"), F.lit(version).alias("dataset_version"),
        )

    history = rows(part, "d1", "v1").withColumn("seq", F.lit(1).cast("bigint"))
    staged = rows(part.filter("p_size % 4 = 0 AND p_brand <> 'Brand#3'"), "d2", "v2")
    return history, staged


_CUTOVER_SQL = """next AS (
  SELECT 2 AS seq, p_brand AS dag_name, 'd2' AS dag_version, 'ds-' || p_partkey AS dataset_uuid, CASE WHEN p_size % 4 = 0 THEN 'v2' ELSE 'v1' END AS dataset_version
  FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size % 4 = 0) AND p_brand <> 'Brand#3')"""


@query("cutover", with_sql(_CUTOVER_SQL, select="SELECT * FROM next"))
def cutover_query(spark, sf_dir):
    return versions.cutover(*_pointers(spark, sf_dir))


@query(
    "current_pointers",
    with_sql(
        _CUTOVER_SQL,
        select="""SELECT * FROM next UNION ALL SELECT 1, p_brand, 'd1', 'ds-' || p_partkey, 'v1' FROM part WHERE p_brand NOT IN (SELECT dag_name FROM next)""",
    ),
)
def current_pointers_query(spark, sf_dir):
    history, staged = _pointers(spark, sf_dir)
    return versions.current_pointers(history.unionByName(versions.cutover(history, staged)))


@query(
    "rollback",
    """SELECT 3 AS seq, p_brand AS dag_name, 'd1' AS dag_version, 'ds-' || p_partkey AS dataset_uuid, 'v1' AS dataset_version
FROM part WHERE p_brand = 'Brand#1'""",
)
def rollback_query(spark, sf_dir):
    history, staged = _pointers(spark, sf_dir)
    return versions.rollback(history.unionByName(versions.cutover(history, staged)), "Brand#1")


@query(
    "expired_staging",
    """SELECT 'crashed' AS attempt, (block_number // 5000 * 5000) || '-' || (block_number // 5000 * 5000 + 4999) AS partition_key, count(*) AS row_count
FROM (SELECT o_orderkey AS block_number FROM orders) GROUP BY ALL""",
)
def expired_staging_query(spark, sf_dir):
    """Rows of expired attempts; of three attempts one is superseded and one was never committed."""
    root, rows = scratch_path(spark, "staging"), scoped_blocks(spark, sf_dir)
    replace_scopes(rows, root)
    replace_scope(rows.filter("partition_key = '0-4999'"), root, "0-4999")
    rows.withColumn("scope", F.col("partition_key")).write.partitionBy("scope").parquet(f"{root}/data/attempt=a-crashed")
    later = F.lit(datetime.datetime.now() + datetime.timedelta(days=30))
    expired = expired_staging(list_files(spark, f"{root}/data"), commit_log(spark, root), later)
    found = [row.attempt for row in expired.select("attempt").collect()]
    lost = spark.read.parquet(*found).withColumn("attempt", F.regexp_extract(F.col("_metadata.file_path"), r"attempt=a-([^/]+)", 1))
    return lost.groupBy("attempt", "partition_key").agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "partition_versions",
    with_sql(
        v.BLOCKS_SQL, SCOPED_SQL,
        select="""SELECT 'ds' AS dataset_uuid, 'v1' AS dataset_version, partition_key, 'cfg' AS config_hash, true AS placed, count(*) AS row_count,
  sha256('chain_id:bigint,block_number:bigint,block_hash:string,block_time:timestamp_ntz,partition_key:string') AS schema_hash FROM scoped GROUP BY partition_key""",
    ),
)
def partition_versions_query(spark, sf_dir):
    root, rows = scratch_path(spark, "pointers"), scoped_blocks(spark, sf_dir)
    replace_scopes(rows, root)
    replace_scopes(rows, root, config_hash="cfg")
    # Folder and time differ from run to run; both must be there.
    placed = F.col("location").isNotNull() & F.col("materialized_at").isNotNull()
    return partition_versions(spark, root, "ds", "v1").withColumn("placed", placed).drop("location", "materialized_at")
