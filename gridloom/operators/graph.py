"""Connected components on tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import materialize, small


def components(edges: DataFrame, label: str = "graph") -> DataFrame:
    """(node, component) of all nodes with an edge; the component is its smallest node.

    ``edges`` has columns a and b, in any direction, with repeats and loops; loops
    are ignored. Every round links the neighbours of a node to the smallest
    of them, first the larger neighbours, then the smaller ones, until only stars
    are left: a logarithmic number of rounds, one stored table of
    edges each. No list of neighbours is gathered, and the smallest neighbours
    are broadcast where they are few, so that the edges of a hub stay where they are.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    links = materialize(links, f"{label}-links")
    while True:
        larger = materialize(_to_least(links, True), f"{label}-larger")
        links = materialize(_to_least(larger, False), f"{label}-smaller")
        # Stars: every node points once, at one that points nowhere.
        ends = links.groupBy("a").agg(F.count("*").alias("n"))
        middle = links.join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        if middle.isEmpty() and ends.filter("n > 1").isEmpty():
            break
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _to_least(links: DataFrame, larger: bool) -> DataFrame:
    """Links (a > b) of each node's larger, or smaller, neighbours to the smallest node among all its neighbours and itself."""
    if larger:
        around = links.union(links.select("b", "a"))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        own = least.filter("m < a").select("a", F.col("m").alias("b"))
        moved = links.select(F.col("b").alias("a"), F.col("a").alias("to")).join(small(least), "a")
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        own = least.select("a", F.col("m").alias("b"))
        moved = links.select("a", F.col("b").alias("to")).join(small(least), "a")
    moved = moved.select(F.col("to").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.union(own).distinct()
