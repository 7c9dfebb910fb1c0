import datetime
import json
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from blockloom.plans import rules as ur
from blockloom.plans.audit import accessed_columns, audit_row
from blockloom.plans.query import QueryRejected, clamp_limit, encode_result, gated_sql, run_query

# Own rows: three alerts on two chains.
ALERTS = [
    ("large-transfer", "k-17", 5, 1, 7001, "0xaa17", "0xbb17", '{"wei":17}'),
    ("large-transfer", "k-23", 9, 1, 7002, "0xaa23", "0xbb23", '{"wei":23}'),
    ("stalled-chain", "k-42", 13, 137, 88, "0xaa42", "", "{}"),
]


@pytest.fixture(scope="module")
def alerts(spark):
    start = datetime.datetime(2024, 3, 5, 12)
    rows = [(a, b, start + datetime.timedelta(minutes=c), *rest) for a, b, c, *rest in ALERTS]
    return spark.createDataFrame(
        rows,
        "alert_definition_id string, dedupe_key string, event_time timestamp_ntz, chain_id bigint, block_number bigint, "
        "block_hash string, tx_hash string, payload string",
    )


@pytest.mark.parametrize(
    "sql",
    [
        "VALUES (1, 'a'), (2, 'b')",
        "SELECT chain_id + 1 AS next FROM dataset WHERE chain_id IN (1, 137) AND payload LIKE '%wei%'",
        "SELECT 'SELECT * FROM parquet.`/x`' AS quoted, \"a;b\" AS text FROM dataset -- FROM secret",
        "FROM dataset |> WHERE chain_id = 1 |> AGGREGATE count(*) AS n",
        "FROM dataset d SELECT d.chain_id, d.block_number",
        "SELECT * FROM dataset TABLESAMPLE (50 PERCENT)",
        "SELECT * FROM (SELECT chain_id, block_number FROM dataset) PIVOT (count(block_number) FOR chain_id IN (1, 137))",
        "SELECT * FROM (SELECT chain_id, block_number FROM dataset) UNPIVOT (value FOR name IN (chain_id, block_number))",
        "SELECT chain_id, block_number, count(*) FROM dataset GROUP BY GROUPING SETS ((chain_id), (block_number), ())",
        "SELECT chain_id, count(*) AS n FROM dataset GROUP BY ALL HAVING n > 1 ORDER BY ALL",
        "SELECT a.dedupe_key FROM dataset a LEFT ANTI JOIN dataset b ON a.chain_id < b.chain_id",
        "SELECT d.chain_id, n FROM dataset d, LATERAL (SELECT d.block_number * 2 AS n)",
        "SELECT chain_id FROM dataset EXCEPT ALL SELECT 1 INTERSECT SELECT 137",
        "SELECT sum(block_number) OVER w FROM dataset WINDOW w AS (PARTITION BY chain_id ORDER BY event_time)",
        "WITH one AS (WITH two AS (SELECT chain_id FROM dataset) SELECT * FROM two) SELECT max(chain_id) FROM one",
        "WITH one AS (SELECT chain_id FROM dataset), two AS (SELECT * FROM one) SELECT * FROM two JOIN one USING (chain_id)",
        "WITH dataset AS (SELECT chain_id FROM dataset) SELECT * FROM dataset",
        "WITH RECURSIVE up(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM up WHERE n < 5) SELECT sum(n) FROM up",
        "SELECT (SELECT max(block_number) FROM dataset i WHERE i.chain_id = o.chain_id) FROM dataset o",
        "SELECT pos, col FROM posexplode(array('x', 'y'))",
        "SELECT key FROM dataset LATERAL VIEW OUTER explode(map('k', 1)) AS key, value",
        "SELECT transform(array(1, 2), x -> x + chain_id) FROM dataset LIMIT 2 OFFSET 1",
        "SELECT /*+ BROADCAST(b) */ count(*) FROM dataset a JOIN dataset b USING (chain_id)",
        "SELECT DISTINCT get_json_object(payload, '$.wei') FROM dataset",
        "SELECT * FROM range(2, 5)",
    ],
)
def test_gate_accepts(alerts, sql):
    gated_sql(alerts, sql).collect()


def test_gate_reads_the_dataset_itself(alerts):
    assert gated_sql(alerts, "SELECT count(*) AS n FROM dataset a JOIN dataset b ON a.chain_id = b.chain_id").first().n == 5
    counted = alerts.groupBy("chain_id").count()
    joined = "SELECT max(a.count) AS n FROM dataset a JOIN dataset b ON a.chain_id >= b.chain_id"
    assert gated_sql(counted, joined).first().n == 2


# Each tries to leave the dataset, to run something, or to hide what it names.
REJECTED = [
    "SELECT chain_id FROM dataset; SELECT 1",
    "SELECT * FROM secret",
    "TABLE secret",
    "SELECT * FROM IDENTIFIER('secret')",
    "SELECT * FROM IDENTIFIER('se' || 'cret')",
    "SELECT (SELECT max(word) FROM IDENTIFIER('secret'))",
    "SELECT * FROM dataset WHERE EXISTS (TABLE secret)",
    "SELECT * FROM dataset WHERE dedupe_key NOT IN (SELECT word FROM secret)",
    "SELECT array(1, 2)[(SELECT count(*) FROM secret)]",
    "SELECT * FROM dataset d, LATERAL (SELECT word FROM secret)",
    "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret",
    "WITH a AS (SELECT * FROM secret), secret AS (SELECT 1 x) SELECT * FROM a",
    "WITH a AS (WITH b AS (SELECT * FROM secret) SELECT * FROM b) SELECT * FROM a",
    "WITH a AS (WITH secret AS (SELECT 1) SELECT * FROM secret) SELECT * FROM secret",
    "WITH RECURSIVE r AS (SELECT word FROM secret UNION ALL SELECT word FROM r WHERE false) SELECT * FROM r",
    "FROM secret |> SELECT word",
    "FROM dataset |> JOIN secret ON true",
    "FROM dataset |> UNION ALL (SELECT * FROM secret)",
    "SELECT * FROM default.secret",
    "SELECT * FROM global_temp.shared",
    "SELECT * FROM spark_catalog.default.dataset",
    "SELECT * FROM json.`/proc/self/environ`",
    "SELECT * FROM dataset NATURAL JOIN binaryFile.`/etc/hostname`",
    "SELECT IDENTIFIER('input_file_name')() FROM dataset",
    "SELECT input_file_block_start() FROM dataset",
    "SELECT java_method('java.lang.Runtime', 'getRuntime')",
    "SELECT try_reflect('java.lang.System', 'getProperty', 'user.home') FROM dataset",
    "SELECT builtin.reflect('java.lang.System', 'lineSeparator')",
    "SELECT twice(chain_id) FROM dataset",
    "SELECT system.session.twice(1)",
    "SELECT * FROM python_worker_logs()",
    "SELECT * FROM secret_rows(1)",
    "CREATE OR REPLACE TEMPORARY VIEW mine AS SELECT * FROM dataset",
    "CREATE TEMPORARY FUNCTION f AS 'x.Y'",
    "MERGE INTO t USING dataset ON true WHEN MATCHED THEN DELETE",
    "FROM dataset INSERT OVERWRITE TABLE t SELECT chain_id",
    "INSERT OVERWRITE LOCAL DIRECTORY '/tmp/out' USING json SELECT * FROM dataset",
    "ALTER TABLE t RENAME TO u",
    "TRUNCATE TABLE t",
    "ANALYZE TABLE t COMPUTE STATISTICS",
    "SET VAR x = 1",
    "CLEAR CACHE",
    "LIST FILES",
    "SHOW FUNCTIONS",
    "DESCRIBE QUERY SELECT * FROM dataset",
    "EXPLAIN FORMATTED SELECT 1",
    "EXECUTE IMMEDIATE 'TABLE secret'",
    "BEGIN DECLARE n INT; SELECT n; END",
    "CALL system.anything()",
    "SELECT nothing_known(1)",
    "SELEC 1",
    "",
]


@pytest.mark.parametrize("sql", REJECTED)
def test_gate_rejects(spark, alerts, sql):
    spark.createDataFrame([("hidden",)], "word string").createOrReplaceTempView("secret")
    spark.createDataFrame([("hidden",)], "word string").createOrReplaceGlobalTempView("shared")
    spark.udf.register("twice", lambda n: 2 * n, "bigint")
    try:
        with pytest.raises(QueryRejected):
            gated_sql(alerts, sql)
    finally:
        spark.catalog.dropTempView("secret")
        spark.catalog.dropGlobalTempView("shared")


def test_threads_do_not_meet(spark):
    def ask(n):
        own = spark.range(n).selectExpr("id", f"{n} AS mark")
        return [gated_sql(own, "SELECT count(*) AS n, max(mark) AS m FROM dataset").first() for _ in range(4)]

    with ThreadPoolExecutor(4) as pool:
        for n, rows in zip((3, 5, 7, 11), pool.map(ask, (3, 5, 7, 11))):
            assert all((r.n, r.m) == (n, n) for r in rows)


def test_view_is_gone_and_result_stays_pinned(spark, alerts):
    spark.catalog.dropTempView("dataset")
    result = gated_sql(alerts, "SELECT count(*) AS n FROM dataset")
    assert not spark.catalog.tableExists("dataset")
    assert result.first().n == 3
    assert spark.conf.get("spark.sql.runSQLOnFiles") == "true"


def test_a_view_of_the_same_name_is_left_alone(spark, alerts):
    spark.range(1).createOrReplaceTempView("dataset")
    assert gated_sql(alerts, "SELECT count(*) AS n FROM dataset").first().n == 3
    assert spark.table("dataset").count() == 1
    spark.catalog.dropTempView("dataset")


def test_run_query_fixture(alerts):
    result = run_query(alerts, "SELECT dedupe_key FROM dataset ORDER BY dedupe_key")
    assert [r[0] for r in result.rows] == ["k-17", "k-23", "k-42"] and not result.truncated
    assert result.columns == [("dedupe_key", "string")]


def test_limits(alerts):
    assert [clamp_limit(x) for x in (None, 0, -5, 7, 99999)] == [1000, 1, 1, 7, 10000]
    cut = run_query(alerts, "SELECT dedupe_key FROM dataset ORDER BY dedupe_key", limit=2)
    assert len(cut.rows) == 2 and cut.truncated
    assert not run_query(alerts, "SELECT dedupe_key FROM dataset", limit=3).truncated


def test_encoding_per_type(spark):
    df = spark.sql(
        """SELECT true AS flag, CAST(1 AS tinyint) AS tiny, 9223372036854775807 AS big, CAST(1.50 AS decimal(10, 2)) AS dec,
        CAST('NaN' AS double) AS nan, double('Infinity') AS inf, 0.5D AS half, float('-Infinity') AS finf, DATE '1970-01-11' AS day,
        TIMESTAMP_NTZ '1969-12-31 23:59:59.5' AS ntz, TIMESTAMP '1970-01-01 00:00:01' AS ts, X'00FF41' AS raw, X'' AS empty_raw,
        INTERVAL '2-3' YEAR TO MONTH AS ym, INTERVAL '1 02:03:04.5' DAY TO SECOND AS dt, array(1) AS list, map(1, 2) AS m,
        named_struct('a', 1) AS s, CAST(NULL AS array<int>) AS no_list, CAST(NULL AS binary) AS no_raw, 'x' AS txt, NULL AS nothing"""
    )
    row = encode_result(df).first()
    assert (row.flag, row.tiny, row.big, row.dec) == (True, 1, 2**63 - 1, "1.50")
    assert (row.nan, row.inf, row.finf, row.half) == (None, None, None, 0.5)
    assert (row.day, row.ntz, row.ts) == (10, -500_000, 1_000_000)
    assert (row.raw, row.empty_raw, row.no_raw) == ([0, 255, 65], [], None)
    assert tuple(row.ym) == (27, 0, 0) and tuple(row.dt) == (0, 1, 7384_500_000_000)
    assert (row.list, row.m, row.s, row.no_list) == ("<list>", "<unsupported>", "<unsupported>", None)
    assert (row.txt, row.nothing) == ("x", None)
    assert Decimal(row.dec) == Decimal("1.50")


def test_negative_interval(spark):
    row = encode_result(spark.sql("SELECT INTERVAL '-1 02:03:04.5' DAY TO SECOND AS dt, INTERVAL '-2-3' YEAR TO MONTH AS ym")).first()
    assert tuple(row.dt) == (0, -1, -7384_500_000_000) and tuple(row.ym) == (-27, 0, 0)


def test_sql_rule_keys_and_validation(spark, alerts):
    blocks = spark.createDataFrame([(1, b, f"0x{b:016x}") for b in (0, 1, 2)], "chain_id bigint, block_number bigint, block_hash string")
    definition = dataset = "5c1a0b52-3f56-4c7e-9a51-000000000001"
    now = F.lit(datetime.datetime(2025, 1, 1))
    sql = "SELECT chain_id, block_number, block_hash FROM dataset"
    events = ur.sql_rule(blocks, sql, definition, dataset, "v1", now, hash_in_key=False)
    assert sorted(r.dedupe_key for r in events.collect()) == [f"alert_eval:{definition}:v1:{n}" for n in (0, 1, 2)]
    good, bad = ur.validate_events(events)
    assert good.count() == 3 and bad.count() == 0
    with pytest.raises(ur.InvalidRuleOutput):
        ur.sql_rule(blocks, "SELECT chain_id FROM dataset", definition, dataset, "v1", now)
    with pytest.raises(ur.InvalidRuleOutput):
        ur.validate_events(events.withColumn("extra", F.lit(1)))


def test_rule_keeps_its_own_transaction_and_payload(spark):
    blocks = spark.createDataFrame(
        [(1, 5, "0x5", "0xt", '{"a":1}', "high"), (1, 6, "0x6", None, None, None), (1, 7, "0x7", "0xu", "{ }", "low")],
        "chain_id bigint, block_number bigint, block_hash string, tx_hash string, payload string, severity string",
    )
    rows = ur.sql_rule(blocks, "SELECT * FROM dataset", "d", "u", "v", F.lit(datetime.datetime(2025, 1, 1))).orderBy("block_number").collect()
    assert [r.tx_hash for r in rows] == ["0xt", "", "0xu"]
    assert [json.loads(r.payload) for r in rows] == [
        {"severity": "high", "a": 1}, {"dataset_uuid": "u", "dataset_version": "v", "block_hash": "0x6"}, {"severity": "low"},
    ]
    assert [r.dedupe_key for r in rows] == ["alert_eval:d:v:5:0x5:0xt", "alert_eval:d:v:6:0x6", "alert_eval:d:v:7:0x7:0xu"]


def test_group_rule_streams_groups_of_any_size(spark):
    import pandas as pd

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(200).selectExpr("if(id % 10 = 9, null, cast(id % 3 as string)) AS k", "id % 2 AS j", "id")

        def span(key, pieces):
            sizes, ids = [], []
            for piece in pieces:
                sizes.append(len(piece))
                ids += piece["id"].tolist()
            assert ids == sorted(ids) and max(sizes) <= 7
            yield pd.DataFrame({"k": [key[0]], "j": [key[1]], "n": [len(ids)], "last": [ids[-1]]})

        got = ur.sorted_group_rule(df, ["k", "j"], ["id"], span, "k string, j bigint, n bigint, last bigint").collect()
        want = df.groupBy("k", "j").agg(F.count("*"), F.max("id")).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want)))

        def first_only(key, pieces):
            yield next(pieces).head(1)

        assert ur.python_group_rule(df, ["j"], first_only, df.schema.simpleString()[7:-1].replace(":", " ")).count() == 2
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_small_frames_of_a_group_rule_go_out_together(spark):
    """A batch of many keys leaves as few frames; frames of other types and of later batches stay apart."""
    import itertools

    import pandas as pd

    class Rows:  # stands for the dealt and sorted DataFrame
        def repartition(self, *keys):
            return self

        sortWithinPartitions = repartition

        def mapInPandas(self, run, schema):
            return run

    def sizes(key, pieces):
        n = sum(len(piece) for piece in pieces)
        yield pd.DataFrame({"k": [key[0]], "n": [n if key[0] != 5 else None]})

    batches = [pd.DataFrame({"k": [None, None, 0, 0, 1, 2, 3]}), pd.DataFrame({"k": [3, 3, 4]}), pd.DataFrame({"k": [5, 6, 6]})]
    frames = list(ur.python_group_rule(Rows(), ["k"], sizes, "k bigint, n bigint")(iter(batches)))
    got = [[tuple(row) for row in frame.astype(object).itertuples(index=False)] for frame in frames]
    assert list(itertools.chain(*got)) == [(None, 2), (0, 2), (1, 1), (2, 1), (3, 3), (4, 1), (5, None), (6, 2)]
    assert len(frames) < 8 and max(map(len, frames)) == 3


def test_audit_row(spark, alerts):
    result = run_query(alerts, "SELECT dedupe_key FROM dataset")
    row = audit_row(spark, result, "org", "ds", datetime.datetime(2025, 1, 1), task_id="t").first()
    assert (row.org_id, row.task_id, row.user_sub, row.result_row_count, row.columns_accessed) == ("org", "t", None, 3, None)
    with pytest.raises(ValueError):
        audit_row(spark, result, "org", "ds", None, task_id="t", user_sub="u")


def test_accessed_columns(spark, folder, alerts):
    alerts.write.parquet(f"{folder}/alerts")
    stored = spark.read.parquet(f"{folder}/alerts")
    used = accessed_columns(gated_sql(stored, "SELECT upper(tx_hash) FROM dataset WHERE chain_id = 1"), stored)
    assert used == ["chain_id", "tx_hash"]
