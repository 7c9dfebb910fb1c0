"""Exact de-duplication by a 128-bit content hash with a byte comparison inside each group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.tables import filled, unused_name


def one_spaced(text: Column) -> Column:
    """Text with every run of ASCII white space replaced by one space.

    The five control characters are replaced one by one, which is much cheaper than a
    pattern; the pattern only runs over texts that have two spaces in a row.
    """
    for code in range(9, 14):
        text = F.replace(text, F.lit(chr(code)), F.lit(" "))
    return F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, " {2,}", " ")).otherwise(text)


def content_hash(text: Column) -> Column:
    """128-bit hash of a text as 16 bytes.

    Never null, and said so: else the join would test the keys for null below the shuffle,
    which computes the text once more for every test.
    """
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b""))


def exact_dedup(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    digest: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """Class of every row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Rows belong together when their one-spaced texts are the same bytes; null text counts as
    empty. The text itself is a grouping key beside its hash, so Spark compares bytes inside
    a hash group, and copies combine before the shuffle: each map task sends a text once,
    whatever the size of its group. Members then find their class by hash and SHA-256, so
    no text moves for them; a class that holds most rows is split by the skew join.

    The smallest id stays; nulls never win unless all ids of the class are null, in which
    case ``keep_id`` is null. Of rows that repeat the kept id exactly one has ``kept``. An
    empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), one_spaced(filled(F.col(text_column))).alias("_text"))
    rows = rows.withColumn("_hash", digest(F.col("_text")))
    sha = F.coalesce(F.sha2("_text", 256), F.lit("")).alias("text_sha256")
    classes = (
        rows.groupBy("_hash", "_text")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("_hash", sha, "keep_id", "group_size")
    )
    members = rows.select("doc_id", "_hash", sha).join(classes, ["_hash", "text_sha256"])
    # A row that repeats the kept id must not stay twice.
    same_row = Window.partitionBy("_hash", "text_sha256", "doc_id").orderBy("group_size")
    first = F.row_number().over(same_row) == 1
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & first
    return members.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def first_copies(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    digest: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One whole row of every class of equal texts: that with the smallest id, nulls last.

    Classes are those of ``exact_dedup``; repeated rows leave one. Columns stay as they are.
    """
    text, key, whole = (unused_name(docs, name) for name in ("_text", "_hash", "_row"))
    rows = docs.withColumn(text, one_spaced(filled(F.col(text_column)))).withColumn(key, digest(F.col(text)))
    order = F.struct(F.col(id_column).isNull(), F.col(id_column), F.col(text_column))
    kept = rows.groupBy(key, text).agg(F.min_by(F.struct(*[F.col(c) for c in docs.columns]), order).alias(whole))
    return kept.select(f"{whole}.*")
