"""Row and column filters that stay plain predicates, so they reach the file scan."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.session import bounded_side, broadcast_if_bounded


class FilterError(ValueError):
    """A structured filter names a field or value that is not allowed."""


_VALUE_TYPES = (
    (T.BooleanType, bool),
    ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), int),
    ((T.FloatType, T.DoubleType, T.DecimalType), (int, float)),
    (T.StringType, str),
)


def _check_value(field: T.StructField, value) -> None:
    for spark_type, python_type in _VALUE_TYPES:
        if isinstance(field.dataType, spark_type):
            is_flag = isinstance(value, bool)
            if isinstance(value, python_type) and (python_type is bool) == is_flag:
                return
            break
    raise FilterError(f"value {value!r} does not fit {field.name} {field.dataType.simpleString()}")


def edge_where(df: DataFrame, where: Mapping, allow: Iterable[str]) -> DataFrame:
    """AND over ``field: scalar`` (equality) and ``field: [values]`` (membership)."""
    allowed = set(allow)
    fields = {f.name: f for f in df.schema.fields}
    terms: list[Column] = []
    for name, value in where.items():
        if name not in allowed or name not in fields:
            raise FilterError(f"field not allowed in where: {name}")
        values = value if isinstance(value, (list, tuple)) else [value]
        if not values:
            raise FilterError(f"empty list for {name}")
        for item in values:
            _check_value(fields[name], item)
        terms.append(F.col(name).isin(*values) if isinstance(value, (list, tuple)) else F.col(name) == value)
    return df.filter(reduce(lambda a, b: a & b, terms)) if terms else df


def row_range(df: DataFrame, row_filter: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """``{"block_number": {"gte": 700, "lte": 1200}}``, both bounds inclusive."""
    for name, bounds in row_filter.items():
        if name not in df.columns or not bounds or set(bounds) - {"gte", "lte"}:
            raise FilterError(f"bad row filter for {name}: {dict(bounds)}")
        if "gte" in bounds:
            df = df.filter(F.col(name) >= bounds["gte"])
        if "lte" in bounds:
            df = df.filter(F.col(name) <= bounds["lte"])
    return df


def read_since(
    df: DataFrame, cursor_column: str, cursor, where: Mapping | None = None, allow: Iterable[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """``(rows above the cursor that match, one-row next_cursor)``; no cursor reads everything.

    The next cursor is found first, by a job of its own, and the rows end at it: what a live
    table gains later belongs to the next read. It ignores ``where``, so it advances even
    when no row matches. Rows without a cursor value are never read.
    """
    column, kind = F.col(cursor_column), df.schema[cursor_column].dataType
    newer = df.filter(column.isNotNull() if cursor is None else column > F.lit(cursor))
    top = newer.agg(F.max(cursor_column)).first()[0]
    last = F.lit(cursor if top is None else top).cast(kind)
    rows = newer.limit(0) if top is None else newer.filter(column <= last)
    return edge_where(rows, where or {}, allow), df.sparkSession.range(1).select(last.alias("next_cursor"))


def finalized_only(
    df: DataFrame,
    finality_depth: int,
    tips: DataFrame | None = None,
    chain: str = "chain_id",
    block: str = "block_number",
) -> DataFrame:
    """Rows with ``block <= tip - finality_depth`` of their chain.

    ``tips`` (chain, tip) usually comes from head observations; without it the highest
    block of each chain is used. There is one tip per chain, checked before broadcasting.
    """
    if tips is None:
        tips = df.groupBy(chain).agg(F.max(block).alias("tip"))
    limits = tips.select(chain, (F.col("tip") - finality_depth).alias("_limit"))
    return df.join(bounded_side(limits), chain).filter(F.col(block) <= F.col("_limit")).drop("_limit")


def fresh_only(df: DataFrame, now, max_age_seconds: int, event_time: str = "event_time") -> DataFrame:
    """Drop events whose domain time is older than the allowed age at ``now``."""
    moment = now if isinstance(now, Column) else F.lit(now)
    oldest = moment - F.make_dt_interval(secs=F.lit(max_age_seconds))
    return df.filter(F.col(event_time) >= oldest.cast(df.schema[event_time].dataType))


def visible_rows(df: DataFrame, org_id, user_id, memberships: DataFrame) -> DataFrame:
    """Rows one user may read: own private rows, org rows, and rows of the user's roles.

    ``df`` has org_id, user_id (creator) and visibility; ``memberships`` has org_id,
    role_slug and user_id. Role names are unique per org, so the join adds no rows.
    """
    roles = (
        memberships.filter((F.col("org_id") == org_id) & (F.col("user_id") == user_id))
        .select(F.concat(F.lit("role:"), "role_slug").alias("_role"))
        .distinct()
        .withColumn("_member", F.lit(True))
    )
    readable = (
        (F.col("visibility") == "org")
        | ((F.col("visibility") == "private") & (F.col("user_id") == user_id))
        | F.coalesce("_member", F.lit(False))
    )
    return (
        df.filter(F.col("org_id") == org_id)
        .join(broadcast_if_bounded(roles), F.col("visibility") == F.col("_role"), "left")
        .filter(readable)
        .drop("_role", "_member")
    )


def visible_to(df: DataFrame, principals: DataFrame, memberships: DataFrame) -> DataFrame:
    """Rows with every ``reader`` of ``principals(org_id, user_id)`` who may read them.

    A row's visibility is of one kind, so the kinds are joined apart, each by equality:
    org rows by org, private rows by org and creator, role rows by org and role. Columns of
    ``df`` as for ``visible_rows``, with ``reader`` added.
    """
    readers = principals.select("org_id", F.col("user_id").alias("reader")).distinct()
    roles = (
        memberships.select("org_id", F.col("user_id").alias("reader"), F.concat(F.lit("role:"), "role_slug").alias("visibility"))
        .distinct()
        .join(readers, ["org_id", "reader"], "left_semi")
    )
    own = readers.withColumn("user_id", F.col("reader"))
    parts = [
        df.filter(F.col("visibility") == "org").join(readers, "org_id"),
        df.filter(F.col("visibility") == "private").join(own, ["org_id", "user_id"]),
        df.filter(F.col("visibility").startswith("role:")).join(roles, ["org_id", "visibility"]),
    ]
    return reduce(DataFrame.unionByName, [part.select(*df.columns, "reader") for part in parts])


def sample_blocks(df: DataFrame, sample_rate: float, block: str = "block_number") -> DataFrame:
    """Deterministic sample: a block is in or out by its hash, on every run and table."""
    if not 0 <= sample_rate <= 1:
        raise FilterError(f"sample_rate must be within [0, 1]: {sample_rate}")
    digest = F.substring(F.md5(F.col(block).cast("string")), 1, 8)
    return df.filter(F.conv(digest, 16, 10).cast("bigint") < F.lit(int(sample_rate * 2**32)))


def select_columns(
    df: DataFrame, columns: Iterable[str], pii_columns: Iterable[str] = (), granted: Iterable[str] = ()
) -> DataFrame:
    """Requested columns without the PII columns that were not granted."""
    hidden = set(pii_columns) - set(granted)
    return df.select(*[c for c in columns if c not in hidden])
