"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, stage


def star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One step: every node points its larger (large-star) or smaller-or-equal (small-star) neighbours at the least one."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
    met = attach(both, least, "a", "n", total=total)
    if large:
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        # each smaller neighbour, and the node itself, point at the least neighbour
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(met.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def settled(edges: DataFrame) -> tuple[bool, int]:
    """Whether every node points at one other node that points nowhere, and the number of edges."""
    nodes = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    by_node = nodes.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    r = by_node.agg(F.count_if((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0))).alias("bad"), F.sum("out").alias("n")).first()
    return not r["bad"], r["n"] or 0


def components(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """(node, root) of every node of `edges` (a, b long) but the roots: root is the least node of its component.

    Nodes with many neighbours are handled by `attach`.  Every step is written to the shared folder.  Raises
    when `rounds` double steps do not settle (each one at least halves the depth, so 2^rounds nodes suffice).
    """
    now = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        done, n = settled(now)
        if done:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = stage(star(star(now, True, 2 * n), False, n), "star")
    raise RuntimeError("the components did not settle")
