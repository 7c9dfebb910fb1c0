"""Merkle manifest of a table: digests of rows, of runs of nodes up to one root, and proofs."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.tables import crc_of_id
from blockloom.session import broadcast_if_bounded, materialized

FANOUT = 8
ROWS_A_PART = 500_000  # of narrow rows that are put in order
PATH = "array<struct<left:string,right:string>>"


def digest_of(*inputs: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated inputs; never null for inputs that are not."""
    return F.sha2(F.concat(*inputs), 256)


def framed(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count of the value as text, ``:`` and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def lower_case(text: Column) -> Column:
    """Text with A-Z in lower case and everything else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def merkle_manifest(
    docs: DataFrame,
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_column: str = "doc_id",
    group_column: str = "lang",
    text_column: str = "text",
    fanout: int = FANOUT,
) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    A leaf is the digest of the framed ``fields``. Per group, leaves ascend by id and every
    ``fanout`` neighbours become their digest until one node is left, the subroot; the
    subroots, ordered by group, become the root in the same way. Per level a node finds the
    others of its run by lags and leads of fixed offsets, masked by its slot and the length
    of the run, and the first node of a run hashes the parent. The proof is the digest of all
    siblings on the way to the root. ``folded_root`` is made again from the proof and the
    leaf, or from the leaf of the tampered row (text in lower case) where 3 divides the crc32
    of the id; it equals the root unless tampering changed the row.

    Null fields are framed as ``-``, empty ones as ``0:``. A null group is a group of its own
    and the first. Null ids come first; they count as empty text in the crc32, which is 0, so
    their rows are tampered. Rows that share an id are ordered by their leaf; rows that are
    alike in all fields have the same leaf and a place each. A table of one row has that
    leaf as its root and the digest of nothing as its proof. An empty table gives no rows;
    other columns are ignored.

    Places come from one range shuffle of narrow rows, so no group is ever in one task;
    windows hold ``fanout`` runs each. Levels are written to the shared folder one by one.
    """
    columns = {name: F.col(name) for name in fields}
    changed = {**columns, text_column: lower_case(F.col(text_column))}
    group = F.coalesce(F.concat(F.lit("+"), F.col(group_column).cast("string")), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        group.alias("key"),
        digest_of(*map(framed, columns.values())).alias("digest"),
        F.when(crc_of_id(id_column) % 3 == 0, digest_of(*map(framed, changed.values()))).alias("tampered"),
        F.monotonically_increasing_id().alias("tie"),
    )
    leaves = numbered(materialized(rows, "leaves"), "key", ["doc_id", "digest", "tie"])
    levels, subroots = _tree(leaves, fanout)
    # Languages are the leaves of the tree above; their order is that of their keys.
    named = subroots.select(F.lit("").alias("key"), F.col("key").alias("of"), "digest", "level")
    tops = numbered(named, "key", ["of"])
    top_levels, roots = _tree(tops, fanout)
    nothing = F.array().cast(PATH)
    roots = roots.select("key", "pos", "level", F.struct(F.col("digest").alias("root"), nothing.alias("path")).alias("up"))
    groups = _with_paths(tops, top_levels, roots, fanout).select(
        F.col("of").alias("key"),
        F.lit(0).cast("long").alias("pos"),
        "level",
        F.struct("up.root", F.col("digest").alias("subroot"), "up.path").alias("up"),
    )
    found = _with_paths(leaves, levels, materialized(groups, "groups"), fanout)
    siblings = F.array_join(F.transform("up.path", lambda s: F.concat(s.left, s.right)), "")
    folded = F.aggregate(
        "up.path", F.coalesce("tampered", "digest"), lambda node, s: digest_of(s.left, node, s.right)
    ).alias("folded_root")
    proven = found.select(
        "doc_id", F.col("digest").alias("leaf"), "up.subroot", "up.root", F.sha2(siblings, 256).alias("proof_sha256"), folded
    )
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))


def numbered(rows: DataFrame, key: str, order: Sequence[str], rows_a_part: int = ROWS_A_PART) -> DataFrame:
    """``rows`` with ``pos``, the place inside its ``key`` by ``order``, and ``n``, the size of the key.

    Rows are dealt by ranges and numbered inside their task; the few counts by key and task
    give the place where a task begins. ``order`` must tell all rows of a key apart, or
    many alike would share a task. Nulls come first.
    """
    parts = max(1, -(-rows.count() // rows_a_part))
    if parts > 1 or not rows.isEmpty():
        parts = max(parts, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order)
    placed = materialized(dealt.withColumn("_at", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy(key, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(key)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        key,
        "_part",
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(whole).alias("n"),
    )
    joined = placed.join(broadcast_if_bounded(materialized(starts, "starts")), [key, "_part"])
    return joined.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """``nodes(key, pos, n, digest)`` with ``left`` and ``right``: the others of the run, joined.

    A window holds ``fanout`` whole runs, so offsets never leave it by more than the masks hide.
    """
    slot = F.pmod("pos", F.lit(fanout))
    length = F.least(F.lit(fanout), F.col("n") - F.col("pos") + slot)
    near = Window.partitionBy("key", F.floor(F.col("pos") / (fanout * fanout))).orderBy("pos")
    lags = [F.when(slot >= k, F.lag("digest", k).over(near)).otherwise("") for k in range(fanout - 1, 0, -1)]
    leads = [F.when(slot + k < length, F.lead("digest", k).over(near)).otherwise("") for k in range(1, fanout)]
    return nodes.withColumns({"left": F.concat(*lags), "right": F.concat(*leads)})


def _tree(leaves: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels of nodes that have siblings, from the leaves up, and the last node of every key.

    The latter is ``key, pos, digest, level``; ``level`` is the number of levels below it.
    Leaves keep their other columns in the first level.
    """
    place = ["key", "pos", "digest", "level"]
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, nodes = [], leaves
    tops = leaves.filter("n = 1").withColumn("level", F.lit(0)).select(*place)
    while most > 1:
        linked = materialized(with_siblings(nodes.filter("n > 1"), fanout), "level")
        levels.append(linked)
        nodes = linked.filter(F.pmod("pos", F.lit(fanout)) == 0).select(
            "key",
            F.floor(F.col("pos") / fanout).alias("pos"),
            F.ceil(F.col("n") / fanout).alias("n"),
            digest_of(F.col("digest"), F.col("right")).alias("digest"),
        )
        tops = tops.unionByName(nodes.filter("n = 1").withColumn("level", F.lit(len(levels))).select(*place))
        most = -(-most // fanout)
    return levels, materialized(tops, "tops")


def _with_paths(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """``leaves`` with ``up``, the struct of their key's top, its path led down to the leaf.

    ``tops`` is ``key, pos, level, up``. A path lists the siblings of a node, of its parent
    and so on. The nodes of a level meet those of the level above, a share as many.
    """

    def top_of(level: int) -> DataFrame:
        return tops.filter(F.col("level") == level).select("key", "pos", "up")

    alone = leaves.filter("n = 1").join(top_of(0), ["key", "pos"])
    if not levels:
        return alone
    above = top_of(len(levels))
    for level in range(len(levels) - 1, -1, -1):
        down = above.withColumnRenamed("pos", "_parent")
        met = levels[level].withColumn("_parent", F.floor(F.col("pos") / fanout)).join(down, ["key", "_parent"])
        path = F.concat(F.array(F.struct("left", "right")).cast(PATH), F.col("up.path"))
        met = met.withColumn("up", F.col("up").withField("path", path)).drop("_parent", "left", "right")
        if level:
            above = met.select("key", "pos", "up").unionByName(top_of(level))
    return met.unionByName(alone.select(*met.columns))
