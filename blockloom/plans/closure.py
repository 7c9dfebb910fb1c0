"""Transitive dependents in the job graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.session import materialized

SHALLOW = 8  # rounds of single steps before steps are doubled
ROUNDS_JOINED = 8
GROWTH = 4  # doubled steps may be so many times the edges


def downstream_closure(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Every dependent of the changed nodes with its distance, the changed ones at 0.

    ``edges``: src, dst. ``changed``: node. A round joins the pairs that are ``step`` edges
    apart with the nodes found in the last ``step`` levels, which gives the next ``step``
    levels with their distances; a node enters once, so diamonds and cycles cost nothing.
    Steps are single at first. A graph that is deep has its pairs joined with themselves,
    so steps double, as long as the pairs stay in proportion to the edges; so a long chain
    takes rounds with the logarithm of its length.

    Each round is written to the shared folder, so plans stay short and lost executors do not
    restart the walk; the nodes reached so far are written together every few rounds. The
    walk ends when a round finds nothing, which any finite graph comes to.
    """
    pairs = materialized(edges.select("src", "dst").distinct(), "pairs")
    most, step, doubling = None, 1, True
    reached = materialized(changed.select("node").distinct().withColumn("depth", F.lit(0)), "reached")
    known, rounds = 1, 0  # all nodes nearer than ``known`` are reached
    while True:
        frontier = reached.filter(F.col("depth") >= known - step).select(F.col("node").alias("src"), "depth")
        found = (
            pairs.join(frontier, "src")
            .groupBy(F.col("dst").alias("node"))
            .agg((F.min("depth") + step).alias("depth"))
            .join(reached.select("node"), "node", "left_anti")
        )
        found = materialized(found, "found")
        if found.isEmpty():
            return reached
        reached, known, rounds = reached.unionByName(found), known + step, rounds + 1
        if rounds % ROUNDS_JOINED == 0:
            reached = materialized(reached, "reached")
        if rounds >= SHALLOW and doubling:
            most = most or GROWTH * pairs.count()
            doubling = _joined_size(pairs) <= most
            if doubling:
                onward = pairs.toDF("dst", "end")
                pairs = materialized(pairs.join(onward, "dst").select("src", F.col("end").alias("dst")).distinct(), "pairs")
                step *= 2


def _joined_size(pairs: DataFrame) -> int:
    """Rows that the pairs joined with themselves would have, from their degrees alone."""
    into = pairs.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("a"))
    out = pairs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("b"))
    return into.join(out, "node").agg(F.coalesce(F.sum(F.col("a").cast("decimal(20,0)") * F.col("b")), F.lit(0))).first()[0]
