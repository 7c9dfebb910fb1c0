import datetime
import uuid

from pyspark.sql import functions as F

from blockloom.functions import checks, ids, values


def one(spark, text, expression, kind="string"):
    return spark.createDataFrame([(text,)], f"x {kind}").select(expression.alias("y")).first().y


def test_uuid5_equals_python(spark):
    names = [f"chain_sync:job-{i}:blocks:{i}:{i + 7}é" for i in range(300)]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    for row in rows.select("name", ids.uuid5(ids.TASK_NAMESPACE, "name").alias("id")).collect():
        assert row.id == str(uuid.uuid5(uuid.UUID(ids.TASK_NAMESPACE), row["name"]))


def test_null_part_gives_null_id(spark):
    assert one(spark, None, ids.task_id("x", F.lit("blocks"), F.lit(0), F.lit(1))) is None


def test_hex_to_bigint(spark):
    cases = {
        "0x10": 16, " 0xff\n": 255, "ff": 255, "0x0": 0, "0x00000000000000000000000a": 10, "0x7fffffffffffffff": 2**63 - 1,
        "0x8000000000000000": None, "0x1ffffffffffffffff": None, "": None, "0x": None, "zz": None, "-1": None, "0X10": None,
    }
    for text, expected in cases.items():
        assert one(spark, text, ids.hex_to_bigint("x")) == expected, text


def test_partition_key_round_trip(spark):
    row = spark.createDataFrame([(10, 20)], "range_start bigint, range_end bigint").select(
        ids.partition_key("range_start", "range_end").alias("k")
    )
    start, end = ids.parse_partition_key("k")
    assert row.select("k", start.alias("s"), end.alias("e")).first() == ("10-19", 10, 20)
    for bad in ("10", "a-b", "-", "1-2-3", "10-"):
        first, after = ids.parse_partition_key("x")
        assert spark.createDataFrame([(bad,)], "x string").select(first, after).first() == (None, None)


def test_strict_json(spark):
    objects = ['{"a":1}', "{}", ' {"a":{"b":[1]}} ', '{"a":"}"}']
    others = ["[]", "1", '"x"', "null", "", "{", '{"a":1}}', '{"a":1}{}', '{"a":1},{}', '{"a":1}],[2', '{"a":1},"b":2', "not json", '{"a":1,"a":2}']
    for text in objects:
        assert one(spark, text, checks.is_json_object("x")) is True, text
    for text in [*others, None]:
        assert one(spark, text, checks.is_json_object("x")) is False, text


def test_parse_rfc3339(spark):
    utc = datetime.timezone.utc
    good = {
        "2025-01-01T00:00:01Z": datetime.datetime(2025, 1, 1, 0, 0, 1, tzinfo=utc),
        "2025-01-01t00:00:01.25z": datetime.datetime(2025, 1, 1, 0, 0, 1, 250000, tzinfo=utc),
        "2025-01-01T02:00:01+02:00": datetime.datetime(2025, 1, 1, 0, 0, 1, tzinfo=utc),
    }
    for text, expected in good.items():
        assert one(spark, text, F.unix_micros(checks.parse_rfc3339("x"))) == int(expected.timestamp() * 1_000_000)
    for text in ("2025-01-01", "2025-01-01T00:00:01", "2025-02-30T00:00:00Z", "x", "", "2025-01-01T25:00:00Z"):
        assert one(spark, text, checks.parse_rfc3339("x")) is None, text


def test_canonical_uuid(spark):
    plain = "906c0c0c-342d-472f-97a1-2c9b3d4eaab1"
    for text in (plain, plain.upper(), plain.replace("-", ""), "urn:uuid:" + plain, "{" + plain + "}"):
        assert one(spark, text, checks.canonical_uuid("x")) == plain
    for text in ("", "906c0c0c", plain + "0", plain.replace("9", "g")):
        assert one(spark, text, checks.canonical_uuid("x")) is None


def test_under_prefix_is_a_directory_prefix(spark):
    def allowed(uri, prefix):
        return one(spark, uri, checks.under_prefix("x", prefix))

    assert allowed("s3://b/foo/x", "s3://b/foo") and allowed("s3://b/foo/x", "s3://b/foo/") and allowed("s3://b/x", "s3://b/")
    assert not allowed("s3://b/foo-bar/x", "s3://b/foo")
    assert not allowed("s3://c/foo/x", "s3://b/foo")
    assert not allowed("https://b/foo/x", "s3://b/foo")


def test_clip_message_counts_bytes(spark):
    assert one(spark, "a" * 2000, values.clip_message("x")) == "a" * 1024
    assert one(spark, "é" * 600, values.clip_message("x", 1023)) == "é" * 511
    assert one(spark, "😀" * 300, values.clip_message("x", 1023)) == "😀" * 255
    assert one(spark, "short", values.clip_message("x")) == "short"
    assert one(spark, None, values.clip_message("x")) is None


def test_severity_and_backoff(spark):
    assert [one(spark, s, values.severity_rank("x")) for s in ("info", "warning", "critical", "x")] == [0, 1, 2, None]
    assert one(spark, 0, values.backoff("x", 5, 1800), "int") == 5.0
    assert one(spark, 20, values.backoff("x", 5, 1800), "int") == 1800.0
