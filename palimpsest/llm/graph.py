"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.runtime import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: neighbours of a node are linked to the least node near it.

    ``edges`` holds (u, v) with u > v. The large star looks at both ends and
    relinks greater neighbours; the small star looks at smaller ones alone.
    Only minima per node are gathered, never neighbour lists. Repeated edges
    may come out.
    """
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(low, "u")
    return linked.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v"))))).filter("u > v")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node that has a link to another; root is the least node of its component.

    Each round is cut by a checkpoint, and the driver sees one number a round.
    Done is when every node but the roots has one edge, to a node that has none
    of its own. Each round shortens what is left, so this ends; rounds grow with
    the logarithm of the longest path.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v")
    while True:
        edges = cut(_star(_star(edges, True), False).distinct())
        ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))))
        loose = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)")
        if loose.isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
