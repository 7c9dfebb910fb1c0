"""Tables made of committed scopes: data first, then one small pointer file.

Layout of a table::

    data/attempt=<id>/scope=<key>/*.parquet   rows, written once
    commits/segment=<k>/*.parquet             pointers, one file per commit
    snapshots/segment=<k>/                    pointers that count before segment k
    writers/segment=<k>/                      commit ids before segment k, as runs of numbers
    schemas/<hash>/                           each schema once

A write goes to a new attempt folder; the commit is one pointer file with the rows of all
changed scopes, renamed into place by the Spark committer, so they become visible together.
A pointer replaces its scope, or extends it: it drops the stored rows from ``cut_from`` on and
adds its own, so a scope is a stack of pieces until it is replaced again. Readers take the
newest snapshot and the segments after it, a bounded number of files whatever the number
of commits, and never see an uncommitted attempt. Committed files are never touched. A
table has one writer at a time.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.sinks.append import child_names, path_exists

COMMIT_SCHEMA = (
    "seq bigint, commit_id string, scope string, location string, row_count bigint, cut_column string, cut_from bigint, "
    "high bigint, depth int, schema_hash string, config_hash string, committed_at timestamp"
)
WRITER_SCHEMA = "series string, first bigint, last bigint"

# Partition keys and slugs: what Spark writes as a folder name without escaping it.
SCOPE_NAME = r"^[A-Za-z0-9_.,@+~ -]+$"
SEGMENT = 32  # commits between two snapshots
MERGE_DEPTH = 16  # pieces on top of each other before a scope is written whole again
LOWEST = -(1 << 63)
_OWN_ID = "^a-[0-9a-f]{32}$"  # ids made here are never replayed
_NUMBERED = r"^(.*?)(0|[1-9][0-9]{0,17})$"
_MANY_CUTS = 64


def _folders(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the folders ``<prefix><number>`` in ``path``, ascending."""
    names = [name[len(prefix) :] for name in child_names(spark, path) if name.startswith(prefix)]
    return sorted(int(name) for name in names if name.isdigit())


def _read(spark: SparkSession, schema: str, *paths: str) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)


def commit_log(spark: SparkSession, table: str) -> DataFrame:
    """Every pointer ever committed. For audits; readers use ``recent_log``."""
    path = f"{table}/commits"
    return _read(spark, COMMIT_SCHEMA, *([path] if path_exists(spark, path) else []))


def _newest_snapshot(spark: SparkSession, table: str, as_of: int | None = None) -> int:
    """Segment of the newest complete snapshot that is not past ``as_of``; 0 without one."""
    for segment in reversed(_folders(spark, f"{table}/snapshots", "segment=")):
        in_time = as_of is None or segment * SEGMENT <= as_of
        if in_time and path_exists(spark, f"{table}/writers/segment={segment}/_SUCCESS"):
            return segment
    return 0


def _segment_paths(spark: SparkSession, table: str, first: int, as_of: int | None = None) -> list[str]:
    segments = [s for s in _folders(spark, f"{table}/commits", "segment=") if s >= first]
    return [f"{table}/commits/segment={s}" for s in segments if as_of is None or s * SEGMENT < as_of]


def recent_log(spark: SparkSession, table: str, as_of: int | None = None) -> DataFrame:
    """The pointers that count, and perhaps some that no longer do: a snapshot and what came after.

    At most ``SEGMENT`` commit files and one snapshot are opened, for any ``as_of`` too.
    """
    newest = _newest_snapshot(spark, table, as_of)
    snapshot = [f"{table}/snapshots/segment={newest}"] if newest else []
    log = _read(spark, COMMIT_SCHEMA, *snapshot, *_segment_paths(spark, table, newest, as_of))
    return log if as_of is None else log.filter(F.col("seq") <= as_of)


def is_committed(spark: SparkSession, table: str, commit_id: str) -> bool:
    """Whether a commit of this id is in the table, however long ago."""
    newest = _newest_snapshot(spark, table)
    tail = _read(spark, COMMIT_SCHEMA, *_segment_paths(spark, table, newest))
    if not tail.filter(F.col("commit_id") == commit_id).isEmpty():
        return True
    if not newest:
        return False
    series, number = spark.range(1).select(*_numbered(F.lit(commit_id))).first()
    known = _read(spark, WRITER_SCHEMA, f"{table}/writers/segment={newest}").filter(F.col("series") == series)
    inside = F.col("first").isNull() if number is None else F.lit(number).between(F.col("first"), F.col("last"))
    return not known.filter(inside).isEmpty()


def _numbered(commit_id: Column) -> tuple[Column, Column]:
    """An id without its last number, and that number; null if it ends in none."""
    number = F.regexp_extract(commit_id, _NUMBERED, 2).try_cast("bigint")
    return F.when(number.isNotNull(), F.regexp_extract(commit_id, _NUMBERED, 1)).otherwise(commit_id).alias("series"), number.alias("number")


def _counting(log: DataFrame) -> DataFrame:
    """Pointers from the last replacement of each scope on; earlier ones never matter again."""
    whole = Window.partitionBy("scope")
    replaced = F.max(F.when(F.col("cut_from").isNull(), F.col("seq"))).over(whole)
    kept = log.filter("scope IS NOT NULL").withColumn("_from", replaced)
    return kept.filter(F.col("_from").isNull() | (F.col("seq") >= F.col("_from"))).drop("_from")


def _snapshot(spark: SparkSession, table: str, segment: int) -> None:
    """Store what counts before ``segment``; one that was interrupted is written again."""
    newest = _newest_snapshot(spark, table)
    if newest >= segment:
        return
    _counting(recent_log(spark, table)).write.mode("overwrite").parquet(f"{table}/snapshots/segment={segment}")
    tail = _read(spark, COMMIT_SCHEMA, *_segment_paths(spark, table, newest))
    series, number = _numbered(F.col("commit_id"))
    new = tail.filter(~F.col("commit_id").rlike(_OWN_ID)).select(series, number).distinct()
    spans = new.select("series", F.col("number").alias("first"), F.col("number").alias("last"))
    if newest:
        spans = spans.unionByName(_read(spark, WRITER_SCHEMA, f"{table}/writers/segment={newest}"))
    # Runs of consecutive numbers become one row, so a stream takes one whatever its length.
    order = Window.partitionBy("series").orderBy("first")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(reach.isNull() | (F.col("first") > reach + 1), 1).otherwise(0)
    runs = spans.withColumn("_new", starts).withColumn("_run", F.sum("_new").over(order))
    merged = runs.groupBy("series", "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    merged.select("series", "first", "last").write.mode("overwrite").parquet(f"{table}/writers/segment={segment}")


def current_scopes(spark: SparkSession, table: str, as_of: int | None = None) -> DataFrame:
    """Newest pointer per scope; ``as_of`` reads the table as it was at that commit.

    ``row_count`` is that of the whole scope. ``location`` is where the last rows went.
    """
    log = recent_log(spark, table, as_of).filter("scope IS NOT NULL")
    newest = F.max_by(F.struct(*[c for c in log.columns if c != "scope"]), "seq")
    return log.groupBy("scope").agg(newest.alias("_newest")).select("scope", "_newest.*")


def live_pieces(spark: SparkSession, table: str, as_of: int | None = None) -> DataFrame:
    """``scope, location, cut_column, below`` of the pieces that hold live rows.

    Rows of a piece count where its cut column is under ``below``, or all if that is null: it
    is the lowest cut of the pointers after it.
    """
    later = Window.partitionBy("scope").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    cut = F.coalesce("cut_from", F.lit(LOWEST))
    pieces = _counting(recent_log(spark, table, as_of)).withColumn("below", F.min(cut).over(later))
    columns = pieces.withColumn("cut_column", F.max("cut_column").over(Window.partitionBy("scope")))
    live = columns.filter(F.col("location").isNotNull() & (F.col("below").isNull() | (F.col("below") > cut)))
    return live.select("scope", "location", "cut_column", "below")


_SCHEMAS: dict[str, T.StructType] = {}


def _schema_hash(schema: T.StructType) -> str:
    """What ``functions.values.schema_hash`` gives for rows of this schema."""
    return hashlib.sha256(",".join(f"{f.name}:{f.dataType.simpleString()}" for f in schema.fields).encode()).hexdigest()


def _store_schema(df: DataFrame, table: str) -> str:
    """The schema as one text, under the hash that pointers carry."""
    name = _schema_hash(df.schema)
    path = f"{table}/schemas/{name}"
    if not path_exists(df.sparkSession, f"{path}/_SUCCESS"):
        text = df.sparkSession.createDataFrame([(df.schema.json(),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(path)
    return name


def _stored_schema(spark: SparkSession, table: str, name: str) -> T.StructType:
    """Schemas never change under their hash, so a session reads each once."""
    path = f"{table}/schemas/{name}"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = T.StructType.fromJson(json.loads(spark.read.text(path, wholetext=True).first()[0]))
    return _SCHEMAS[path]


def _write(
    df: DataFrame, table: str, scope_column: str, max_records_per_file: int = 0, cut_column: str | None = None
) -> tuple[str, DataFrame]:
    """Rows in a new attempt folder; its place, and rows and highest cut value written by scope."""
    spark = df.sparkSession
    location = f"{table}/data/attempt=a-{uuid.uuid4().hex}"
    writer = df.withColumn("scope", F.col(scope_column).cast("string")).hint("rebalance", "scope").write
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    writer.partitionBy("scope").parquet(location)
    written = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("scope", T.StringType())])).parquet(location)
    high = F.max(F.col(cut_column).cast("bigint")) if cut_column else F.lit(None).cast("bigint")
    return location, written.groupBy("scope").agg(F.count(F.lit(1)).alias("_written"), high.alias("_high"))


def _commit(df: DataFrame, table: str, location: str, pointers: DataFrame, commit_id: str | None, config_hash: str | None) -> int:
    """Make ``pointers(scope, _written, row_count, cut_column, cut_from, high, depth)`` visible together."""
    spark = df.sparkSession
    seq = recent_log(spark, table).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] + 1
    segment = (seq - 1) // SEGMENT
    if segment:
        _snapshot(spark, table, segment)
    name = _store_schema(df, table)
    rows = pointers.select(
        F.lit(seq).cast("bigint").alias("seq"),
        F.lit(commit_id or location.rsplit("=", 1)[1]).alias("commit_id"),
        "scope",
        F.when(F.col("_written") > 0, F.lit(location)).alias("location"),
        F.col("row_count").cast("bigint"),
        "cut_column",
        F.col("cut_from").cast("bigint"),
        F.col("high").cast("bigint"),
        F.col("depth").cast("int"),
        F.lit(name).alias("schema_hash"),
        F.lit(config_hash).cast("string").alias("config_hash"),
        F.current_timestamp().alias("committed_at"),
    )
    # One file makes the flip atomic; it holds one row per changed scope, never data.
    rows.coalesce(1).write.mode("append").parquet(f"{table}/commits/segment={segment}")
    return seq


_POINTER = "scope string, _written bigint, row_count bigint, cut_column string, cut_from bigint, high bigint, depth int"


def _check_names(found: Iterable[str | None]) -> None:
    """Before a commit, so a name that could not be read back never becomes visible."""
    for name in found:
        if name is None or not re.match(SCOPE_NAME, name):
            raise ValueError(f"scope name not usable as a folder: {name!r}")


def replace_scopes(
    df: DataFrame,
    table: str,
    scope_column: str = "partition_key",
    scopes: DataFrame | None = None,
    config_hash: str | None = None,
    commit_id: str | None = None,
    max_records_per_file: int = 0,
) -> int:
    """Replace every scope in ``df`` and in ``scopes``, which may hold emptied ones, at once.

    Rows of ``df`` in further scopes replace those scopes too; none is left without a
    pointer. A null scope, or a name that is no plain folder name, fails before the commit.
    Returns the commit sequence number. ``rebalance`` splits a scope that holds most rows
    over several tasks and files instead of one.
    """
    location, written = _write(df, table, scope_column, max_records_per_file)
    if scopes is not None:
        wanted = scopes.select(F.col(scope_column).cast("string").alias("scope")).distinct()
        written = written.select("scope", "_written").unionByName(wanted.withColumn("_written", F.lit(0).cast("bigint")))
        written = written.groupBy("scope").agg(F.sum("_written").alias("_written"))
    none = F.lit(None).cast("bigint")
    pointers = written.select(
        "scope", "_written", F.col("_written").alias("row_count"), F.lit(None).cast("string").alias("cut_column"),
        none.alias("cut_from"), none.alias("high"), F.lit(0).alias("depth"),
    ).persist()
    poor = F.coalesce(~F.col("scope").rlike(SCOPE_NAME), F.lit(True))
    count, bad = pointers.agg(F.count("*"), F.min(F.when(poor, F.struct("scope")))).first()
    if bad is not None:
        pointers.unpersist()
        _check_names([bad.scope])
    if not count:  # a commit that changes nothing is still known by its id
        pointers = df.sparkSession.createDataFrame([(None, 0, 0, None, None, None, 0)], _POINTER)
    seq = _commit(df, table, location, pointers, commit_id, config_hash)
    pointers.unpersist()
    return seq


def extend_scopes(
    df: DataFrame,
    table: str,
    cuts: Mapping[str, int],
    cut_column: str,
    scope_column: str = "partition_key",
    config_hash: str | None = None,
    commit_id: str | None = None,
    merge_depth: int = MERGE_DEPTH,
) -> int:
    """In every scope of ``cuts`` drop the stored rows whose ``cut_column`` is at or over the cut,
    and add the rows of ``df``, at once.

    ``df`` must hold rows of those scopes only, and none under the cut. Only ``df`` is written,
    except that a scope with ``merge_depth`` pieces is written whole again. ``cuts`` names the
    changed scopes, as pointers do. Stored rows are counted only where a cut meets them.
    """
    spark, names = df.sparkSession, list(cuts)
    _check_names(names)
    known = scope_states(spark, table, names)
    full = [name for name in names if name in known and known[name].depth + 1 >= merge_depth]
    met = [n for n in names if n in known and known[n].row_count and (known[n].high is None or known[n].high >= cuts[n])]
    dropped = {}
    over = _over_cuts(spark, table, {n: cuts[n] for n in met if n not in full}, cut_column, scope_column)
    if over is not None:
        dropped = {row[0]: row[1] for row in over.groupBy(F.col(scope_column).cast("string")).count().collect()}
    if full:
        stored = read_committed(spark, table, full)
        bounds = spark.createDataFrame([(n, cuts[n]) for n in full], "_scope string, _cut bigint")
        under = stored.join(F.broadcast(bounds), stored[scope_column].cast("string") == F.col("_scope"))
        df = df.unionByName(under.filter(F.col(cut_column) < F.col("_cut")).select(*df.columns))
    location, written = _write(df, table, scope_column, cut_column=cut_column)
    added = {row.scope: row for row in written.collect()}
    _check_names(added)
    if not added.keys() <= cuts.keys():
        raise ValueError(f"rows outside the changed scopes: {sorted(added.keys() - cuts.keys())[:3]}")
    pointers = []
    for name in names:
        count, high = (added[name]._written, added[name]._high) if name in added else (0, None)
        if name in full:
            pointers.append((name, count, count, None, None, high, 0))
            continue
        old = known.get(name)
        left = old.row_count - dropped.get(name, 0) if old else 0
        if high is None and left and old.high is not None and old.high < cuts[name]:
            high = old.high
        pointers.append((name, count, left + count, cut_column, cuts[name], high, old.depth + 1 if old else 0))
    frame = spark.createDataFrame(pointers or [(None, 0, 0, None, None, None, 0)], _POINTER)
    return _commit(df, table, location, frame, commit_id, config_hash)


def scope_states(spark: SparkSession, table: str, names: Iterable[str]) -> dict[str, Row]:
    """``row_count, depth, high`` of the named scopes that have a pointer."""
    names = list(names)
    if not names or not path_exists(spark, f"{table}/commits"):
        return {}
    rows = current_scopes(spark, table).filter(F.col("scope").isin(*names))
    return {row.scope: row for row in rows.select("scope", "row_count", "depth", "high").collect()}


def _over_cuts(
    spark: SparkSession, table: str, cuts: Mapping[str, int], cut_column: str, scope_column: str
) -> DataFrame | None:
    """Stored rows at or over the cut of their scope; None if no scope is given.

    The lowest cut is a plain predicate that skips files; the cuts of each scope follow.
    """
    if not cuts:
        return None
    stored = read_committed(spark, table, list(cuts)).filter(F.col(cut_column) >= min(cuts.values()))
    bounds = spark.createDataFrame(list(cuts.items()), "_scope string, _cut bigint")
    met = stored.join(F.broadcast(bounds), stored[scope_column].cast("string") == F.col("_scope"))
    return met.filter(F.col(cut_column) >= F.col("_cut")).drop("_scope", "_cut")


def replace_scope(df: DataFrame, table: str, scope: str, config_hash: str | None = None, **options) -> int:
    """Replace one scope with ``df``; an empty ``df`` empties it."""
    spark = df.sparkSession
    only = spark.createDataFrame([(scope,)], "partition_key string")
    tagged = df.withColumn("partition_key", F.lit(scope))
    return replace_scopes(tagged, table, scopes=only, config_hash=config_hash, **options)


def read_committed(
    spark: SparkSession, table: str, scopes: Iterable[str] | None = None, as_of: int | None = None
) -> DataFrame:
    """Committed rows, optionally of some scopes only.

    The pointer rows (a bounded number per scope) are pinned here, as any file index is;
    rows are read by the executors. A superseded scope inside a still-used attempt is pruned
    as a partition, without opening its files; of a piece that was cut only rows under the
    cut come out.
    """
    pieces = live_pieces(spark, table, as_of)
    if scopes is not None:
        names = list(scopes)
        pieces = pieces.filter(F.col("scope").isin(*names)) if names else pieces.limit(0)
    # The newest schema comes with the pieces, as a row without a scope.
    none = F.lit(None)
    newest = recent_log(spark, table, as_of).agg(F.max_by("schema_hash", "seq").alias("location")).select(
        none.cast("string").alias("scope"), "location", none.cast("string").alias("cut_column"), none.cast("bigint").alias("below")
    )
    found = pieces.unionByName(newest).collect()
    pinned, name = [row for row in found if row.scope is not None], next(row.location for row in found if row.scope is None)
    if name is None:
        raise FileNotFoundError(f"no commit in {table}")
    schema = _stored_schema(spark, table, name)
    if not pinned:
        return spark.createDataFrame([], schema)
    paths = [f"{row.location}/scope={row.scope}" for row in pinned]
    parts = [T.StructField("attempt", T.StringType()), T.StructField("scope", T.StringType())]
    rows = (
        spark.read.schema(T.StructType([*schema.fields, *parts])).option("basePath", f"{table}/data").parquet(*paths)
    )
    cut = [row for row in pinned if row.below is not None]
    if cut:
        rows = _under_cuts(spark, rows, cut)
    return rows.select(*schema.names)


def _under_cuts(spark: SparkSession, rows: DataFrame, cut: list) -> DataFrame:
    """``rows`` without those at or over the cut of their piece; few cuts are plain predicates."""
    column = F.col(cut[0].cut_column)
    attempt = [(row.location.rsplit("attempt=", 1)[1], row.scope, row.below) for row in cut]
    if len(attempt) <= _MANY_CUTS:
        for name, scope, below in attempt:
            gone = (F.col("attempt") == name) & (F.col("scope") == scope) & (column >= below)
            rows = rows.filter(~F.coalesce(gone, F.lit(False)))
        return rows
    bounds = spark.createDataFrame(attempt, "attempt string, scope string, _below bigint")
    met = rows.join(F.broadcast(bounds), ["attempt", "scope"], "left")
    return met.filter(F.col("_below").isNull() | column.isNull() | (column < F.col("_below"))).drop("_below")


def partition_versions(spark: SparkSession, table: str, dataset_uuid: str, dataset_version: str) -> DataFrame:
    """Current materialization metadata of every scope."""
    return current_scopes(spark, table).select(
        F.lit(dataset_uuid).alias("dataset_uuid"),
        F.lit(dataset_version).alias("dataset_version"),
        F.col("scope").alias("partition_key"),
        F.col("committed_at").alias("materialized_at"),
        "config_hash",
        "schema_hash",
        "location",
        "row_count",
    )
