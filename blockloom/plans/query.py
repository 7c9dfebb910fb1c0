"""Read-only SQL over one attached relation, with capped and encoded results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.operators.sets import capped_rows
from blockloom.sources.attach import DATASET_VIEW

# Inline result limits.
DEFAULT_LIMIT = 1000
MAX_LIMIT = 10_000

# What the parser and the analyzer produce for queries that only compute. Anything else is
# refused: commands, writes, and nodes whose names are only known after evaluation.
QUERY_NODES = frozenset(
    """
    Aggregate AsOfJoin CTERelationDef CTERelationRef CollectMetrics Deduplicate Distinct Except Expand Filter Generate
    GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation$ OneRowRelation PipeOperator Pivot Project Range
    ResolvedHint Sample Sort SubqueryAlias Union UnionLoop UnionLoopRef Unpivot UnresolvedHaving UnresolvedHint
    UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedTVFAliases
    UnresolvedWith View Window WithCTE WithWindowDefinition
    """.split()
)
# Leaves that hold no table: constants, number ranges and the query's own common tables.
FREE_LEAVES = frozenset(["OneRowRelation", "OneRowRelation$", "LocalRelation", "Range", "CTERelationRef", "UnionLoopRef"])
# Expressions that run code of others, or reveal the host rather than the dataset.
FORBIDDEN_EXPRESSIONS = frozenset(
    """
    CallMethodViaReflection TryReflect InputFileName InputFileBlockStart InputFileBlockLength ScalaUDF PythonUDF PythonUDAF
    PythonUDTF UnresolvedPolymorphicPythonUDTF HiveSimpleUDF HiveGenericUDF HiveGenericUDTF HiveUDAFFunction ScalaAggregator
    ScalaUDAF TypedScalarSubquery CurrentUser FunctionTableSubqueryArgumentExpression
    """.split()
)
ALLOWED_TABLE_FUNCTIONS = frozenset(
    ["range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple"]
)


class QueryRejected(ValueError):
    """The statement is not a single read-only query over the dataset."""


@dataclass(frozen=True)
class QueryResult:
    columns: list[tuple[str, str]]
    rows: list[tuple]
    truncated: bool


def clamp_limit(limit: int | None) -> int:
    return max(1, min(DEFAULT_LIMIT if limit is None else limit, MAX_LIMIT))


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _subplans(jvm, expression) -> list:
    """Plans inside an expression and below it, with every expression checked."""
    holder, plans, pending = jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression"), [], [expression]
    while pending:
        node = pending.pop()
        kind = _kind(node)
        if kind in FORBIDDEN_EXPRESSIONS or "UnresolvedIdentifier" in kind:
            raise QueryRejected(f"expression not allowed: {kind}")
        if kind == "UnresolvedFunction" and node.nameParts().size() != 1:
            raise QueryRejected(f"function not allowed: {'.'.join(_items(node.nameParts()))}")
        if holder.isInstance(node):
            plans.append(node.plan())
        pending.extend(_items(node.children()))
    return plans


def check_read_only(spark: SparkSession, sql: str, relation: str = DATASET_VIEW) -> None:
    """Reject anything but one query over ``relation`` and its own common tables.

    The statement is parsed by the session's own parser and nothing is run. Only kinds of
    nodes that queries consist of pass, and a relation must be ``relation`` or a common table
    in its scope: one defined before, or the same one under RECURSIVE.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as error:
        raise QueryRejected(f"not a single valid statement: {type(error).__name__}") from error
    pending = [(plan, frozenset([relation.lower()]))]
    while pending:
        node, names = pending.pop()
        kind = _kind(node)
        if kind not in QUERY_NODES:
            raise QueryRejected(f"statement not allowed: {kind}")
        if kind == "UnresolvedWith":
            for common in _items(node.cteRelations()):
                own = common.productElement(0).lower()
                pending.append((common.productElement(1), names | {own} if node.allowRecursion() else names))
                names = names | {own}
        elif kind == "UnresolvedRelation":
            parts = [p.lower() for p in _items(node.multipartIdentifier())]
            if len(parts) != 1 or parts[0] not in names:
                raise QueryRejected(f"relation not allowed: {'.'.join(parts)}")
        elif kind == "UnresolvedTableValuedFunction":
            function = ".".join(_items(node.name())).lower()
            if function not in ALLOWED_TABLE_FUNCTIONS:
                raise QueryRejected(f"table function not allowed: {function}")
        for expression in _items(node.expressions()):
            pending.extend((p, names) for p in _subplans(spark.sparkContext._jvm, expression))
        pending.extend((child, names) for child in _items(node.children()))


def _check_analyzed(spark: SparkSession, plan, dataset) -> None:
    """Every leaf of the analyzed plan must be a constant or a leaf of the dataset."""
    own, pending = [leaf.canonicalized() for leaf in _items(dataset.collectLeaves())], [plan]
    if plan.canonicalized().equals(dataset.canonicalized()):
        return
    while pending:
        node = pending.pop()
        kind, children = _kind(node), _items(node.children())
        if kind == "SubqueryAlias" and any(_same(child, dataset) for child in children):
            continue  # the dataset itself, which may be any plan
        if not children and kind not in FREE_LEAVES and node.canonicalized() not in own:
            raise QueryRejected(f"relation not allowed: {kind}")
        for expression in _items(node.expressions()):
            pending.extend(_subplans(spark.sparkContext._jvm, expression))
        pending.extend(children)


def _same(node, dataset) -> bool:
    return node.canonicalized().equals(dataset.canonicalized())


def gated_sql(df: DataFrame, sql: str, relation: str = DATASET_VIEW) -> DataFrame:
    """``sql`` over ``df`` exposed as ``relation``, after the read-only check.

    Each call has a session of its own, with the settings of ``df``'s and nothing else: no
    views, no registered functions, so calls on several threads do not meet and names of
    the caller's session do not exist. The analyzed plan is checked again, so whatever a
    name resolved to, only ``df`` is read.
    """
    spark = df.sparkSession
    check_read_only(spark, sql, relation)
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    plan = df._jdf.queryExecution().analyzed()
    rows = spark.sparkContext._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, plan)
    rows.createOrReplaceTempView(relation)
    try:
        result = own.sql(sql)
    except (AnalysisException, ParseException) as error:
        raise QueryRejected(str(error).splitlines()[0]) from error
    _check_analyzed(own, result._jdf.queryExecution().analyzed(), rows.queryExecution().analyzed())
    return result


def run_query(df: DataFrame, sql: str, limit: int | None = None) -> QueryResult:
    """Capped rows of a read-only query: reads one row more than the limit to tell truncation."""
    result = gated_sql(df, sql)
    columns = [(f.name, f.dataType.simpleString()) for f in result.schema.fields]
    rows, truncated = capped_rows(encode_result(result), clamp_limit(limit))
    return QueryResult(columns, [tuple(r) for r in rows], truncated)


def _local_micros(c: Column) -> Column:
    # Built from calendar parts, so a timestamp without zone is not shifted by the session zone.
    day = F.unix_date(c.cast("date")).cast("bigint") * 86_400_000_000
    clock = (F.hour(c) * 3600 + F.minute(c) * 60).cast("bigint") * 1_000_000
    return day + clock + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")


def _bytes(c: Column) -> Column:
    digits = F.hex(c)
    byte = lambda i: F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("int")
    return F.when(F.length(c) == 0, F.array().cast("array<int>")).when(
        c.isNotNull(), F.transform(F.sequence(F.lit(1), F.length(c)), byte)
    )


def _interval(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.YearMonthIntervalType):
        months = F.extract(F.lit("YEAR"), c) * 12 + F.extract(F.lit("MONTH"), c)
        days, nanos = F.lit(0), F.lit(0).cast("bigint")
    else:
        months, days = F.lit(0), F.extract(F.lit("DAY"), c)
        clock = F.extract(F.lit("HOUR"), c) * 3600 + F.extract(F.lit("MINUTE"), c) * 60
        nanos = ((clock + F.extract(F.lit("SECOND"), c)) * 1_000_000_000).cast("bigint")
    fields = F.struct(months.cast("int").alias("months"), days.cast("int").alias("days"), nanos.alias("nanos"))
    return F.when(c.isNotNull(), fields)


def encode_column(name: str, dtype: T.DataType) -> Column:
    """One result column as a transport value."""
    c = F.col(f"`{name.replace('`', '``')}`")
    if isinstance(dtype, (T.BooleanType, T.IntegralType, T.StringType, T.NullType)):
        return c
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        finite = ~F.isnan(c) & ~c.isin(float("inf"), float("-inf"))
        return F.when(finite, c)
    if isinstance(dtype, T.DecimalType):
        return c.cast("string")
    if isinstance(dtype, T.DateType):
        return F.unix_date(c)
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(dtype, T.TimestampNTZType):
        return _local_micros(c)
    if isinstance(dtype, T.BinaryType):
        return _bytes(c)
    if isinstance(dtype, (T.YearMonthIntervalType, T.DayTimeIntervalType)):
        return _interval(c, dtype)
    placeholder = "<list>" if isinstance(dtype, T.ArrayType) else "<unsupported>"
    return F.when(c.isNotNull(), F.lit(placeholder))


def encode_result(df: DataFrame) -> DataFrame:
    """Every column as a transport value: exact numbers as text, times as integers,
    non-finite numbers as null, nested values as placeholders."""
    return df.select(*[encode_column(f.name, f.dataType).alias(f.name) for f in df.schema.fields])
