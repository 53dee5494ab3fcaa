"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import stored


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): for each node of ``links`` (a, b), the smallest node it can reach.

    Alternates large-star and small-star steps until no link changes; the number of rounds grows with the
    logarithm of the longest path. Every step is written to the shared folder, so a lost executor costs a
    step at most, and its join has plain exchanges on both sides, so a hub is split by skew handling.
    """
    edges = stored(_ordered(links.select("a", "b")), name)
    before = None
    while True:
        edges = stored(_star(edges, large=True, name=name), name)
        edges = stored(_star(edges, large=False, name=name), name)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    # every link now leads from a node to the smallest one of its component
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select("b", "b").distinct()
    )


def _ordered(edges: DataFrame) -> DataFrame:
    """Links from the larger to the smaller node, once each, no loops."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _star(edges: DataFrame, large: bool, name: str) -> DataFrame:
    """Connect the larger (large star) or the smaller (small star) neighbours of each node, and the node
    itself in a small star, to the smallest of its neighbourhood."""
    if large:
        around = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rows = around.where("b > a")
    else:
        around = rows = edges
    least = around.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
    linked = rows.join(stored(least, f"{name}-least"), "a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    if not large:
        linked = linked.union(least.select("a", F.col("_m").alias("b")))
    return _ordered(linked)
