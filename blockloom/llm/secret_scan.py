"""Secret scan through an inverted trigram index, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.llm.tables import filled, unused_name
from blockloom.llm.trigram_query import conjunction
from blockloom.session import materialized


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The kinds asked for, in their order.
BASE_RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
)
# Formats of well-known tokens, which the scan adds.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES
PART = 256


def postings(docs: DataFrame, rules: tuple[Rule, ...], id_column: str, text_column: str) -> DataFrame:
    """``gram, id``: the texts that hold each trigram the rules ask for, letters in lower case.

    Trigrams that no rule asks for are never looked up, so they are not indexed.
    """
    grams = sorted({g for rule in rules for stretch in conjunction(rule.pattern) for clause in stretch for g in clause})
    folded = F.lower(filled(F.col(text_column)))
    held = F.array_compact(F.array(*[F.when(F.contains(folded, F.lit(g)), F.lit(g)) for g in grams]))
    if not grams:
        held = F.array().cast("array<string>")
    return docs.select(F.col(id_column).alias("id"), F.explode(held).alias("gram")).distinct()


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``id, kinds``: rules whose Boolean query the postings of a text satisfy.

    A clause holds if all its trigrams are there, a stretch if one of its clauses holds, and a
    rule if all its stretches hold.
    """
    spark = index.sparkSession
    asked = [
        (rule.kind, m, n, gram, len(clause), len(conjunction(rule.pattern)))
        for rule in rules
        for m, stretch in enumerate(conjunction(rule.pattern))
        for n, clause in enumerate(stretch)
        for gram in sorted(clause)
    ]
    # As many rows as the rules have trigrams, so a broadcast.
    wanted = F.broadcast(spark.createDataFrame(asked, "kind string, stretch int, clause int, gram string, needed int, stretches int"))
    met = index.join(wanted, "gram").groupBy("id", "kind", "stretches", "stretch", "clause", "needed").agg(F.count("*").alias("held"))
    held = met.filter("held = needed").groupBy("id", "kind", "stretches").agg(F.count_distinct("stretch").alias("held"))
    return held.filter("held = stretches").groupBy("id").agg(F.collect_set("kind").alias("kinds"))


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Fold of the first 1, 2, ... n values of an array of longs; 0 must be neutral to ``step``.

    A fold that appends copies its array at every step, so it only runs over parts of fixed
    length and over the results of the parts.
    """
    zero = F.lit(0).cast("long")

    def fold(array: Column) -> Column:  # starts with 0, so it has one value more
        return F.aggregate(array, F.array(zero), lambda done, v: F.concat(done, F.array(step(F.element_at(done, -1), v))))

    starts = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(PART))
    parts = F.transform(starts, lambda at: F.slice(values, at + 1, PART))
    before = F.slice(fold(F.transform(parts, lambda part: F.aggregate(part, zero, step))), 1, F.size(parts))
    shifted = F.zip_with(
        parts, before, lambda part, base: F.transform(F.slice(fold(part), 2, PART), lambda v: step(v, base))
    )
    return F.flatten(shifted)


def long_form(rule: Rule) -> str:
    """A rule that ends in a run of one class and needs a length asks for it in its repeat."""
    if rule.group or rule.least == 1 or not rule.pattern.endswith("]+"):
        return rule.pattern
    return f"{rule.pattern[:-1]}{{{rule.least - rule.pattern.index('[')},}}"


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of ``(start, order, end, kind)`` of a rule's matches, in code points."""
    pattern = long_form(rule)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(gaps, 1, F.size(whole)), whole, lambda gap, match: (F.length(gap) + F.length(match)).cast("long"))
    rows = F.arrays_zip(running(steps, lambda a, b: a + b).alias("end"), whole.alias("match"), measured.alias("value"))
    long_enough = F.filter(rows, lambda r: F.length(r["value"]) >= rule.least)
    return F.transform(
        long_enough,
        lambda r: F.struct(
            (r["end"] - F.length(r["match"])).alias("start"), F.lit(order).alias("order"), r["end"].alias("end"), F.lit(rule.kind).alias("kind")
        ),
    )


def secret_spans(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: tuple[Rule, ...] = RULES, to: str = "spans"
) -> DataFrame:
    """``docs`` with a column ``to``: array of ``(start, order, end, kind)`` sorted by start.

    Rules with mandatory trigrams are only run over texts that the index admits; the others
    scan every text. Offsets count code points, ends are exclusive. Null text counts as
    empty and has no spans; rows may repeat an id or have none, since the index only admits
    and every row is verified by itself. A column named as ``to`` is replaced, no other.
    """
    index = materialized(postings(docs, rules, id_column, text_column), "postings")
    kinds, own = unused_name(docs, "_kinds"), unused_name(docs, "_admitted")
    admitted = candidates(index, rules).select(F.col("id").alias(own), F.col("kinds").alias(kinds))
    rows = docs.join(admitted, docs[id_column].eqNullSafe(F.col(own)), "left").drop(own)
    text, none = filled(F.col(text_column)), F.array().cast("array<struct<start:long,order:int,end:long,kind:string>>")
    found = []
    for order, rule in enumerate(rules):
        if not conjunction(rule.pattern):
            run = F.rlike(text, F.lit(long_form(rule)))
        else:
            run = F.coalesce(F.array_contains(kinds, rule.kind), F.lit(False))
        found.append(F.when(run, rule_spans(text, rule, order)).otherwise(none))
    return rows.withColumn(to, F.array_sort(F.concat(*found))).drop(kinds)


def written(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: counts of the base kinds, a digest of their spans, and all spans as text."""
    found = secret_spans(docs.select("doc_id", "text"), rules=rules).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["order"] < len(BASE_RULES))
    counts = [
        F.size(F.filter("spans", lambda s: s["order"] == order)).cast("long").alias(f"n_{rule.kind}")
        for order, rule in enumerate(BASE_RULES)
    ]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; touching spans share one.

    All other columns stay as they are, whatever their names; null text stays null.
    """
    spans = unused_name(docs, "_spans")
    found = secret_spans(docs, to=spans, **options)
    length = F.length("text").cast("long")
    past = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    starts = F.transform(spans, lambda s: s["start"])

    def between(a: Column, b: Column) -> Column:
        piece = F.substr(F.col("text"), (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
        return F.when((b > a) | (a == 0) | (b == length), piece)

    pieces = F.zip_with(F.concat(F.array(F.lit(0).cast("long")), past), F.concat(starts, F.array(length)), between)
    clean = F.array_join(F.array_compact(pieces), mark)
    return found.withColumn("text", F.when(F.size(spans) > 0, clean).otherwise(F.col("text"))).drop(spans)
