"""Connected components of an edge table, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tables import Scratch, spread_join


def _stars(edges: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """Each node's neighbours are linked to the least of them and itself: the larger
    neighbours in a large star, the node and its smaller neighbours in a small one."""
    if large:
        pairs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = scratch.cut(pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n")))
    joined = spread_join(pairs, least, "a", "b")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return scratch.cut(out.filter("a <> b").distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node, and those have none: the roots are found."""
    own = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    inner = own.join(edges.select("b").distinct(), F.col("a") == F.col("b"), "left_semi").select("n")
    return own.filter("n > 1").select("n").unionByName(inner).isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the least node of its component.

    Edges of a node to itself don't count.  The edges of a node with many neighbours are
    spread over tasks.  Each step is a written table of ``scratch``; the number of rounds
    grows with the logarithm of the largest component."""
    scratch = scratch or Scratch(edges.sparkSession, "components")
    edges = scratch.cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _are_stars(edges):
        edges = _stars(_stars(edges, True, scratch), False, scratch)
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select("root", "root").distinct().toDF("node", "root"))
