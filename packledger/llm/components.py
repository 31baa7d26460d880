"""Connected components over an edge table, by alternating star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge; the root is the least node of its component.

    ``edges`` has columns a, b (long).  Each round hangs every node's larger
    neighbours on its least neighbour, then every node's smaller neighbours on
    the least of them; the rounds end when every node hangs on a root.  A
    node's neighbours are never gathered: its least one is an aggregate that
    combines before the shuffle, joined back to the edges (a hot node's edges
    are split by the skew join).  The edges of a round are a written table.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(now, "links")
    while True:
        both = _both(now)
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        # large star: larger neighbours of n hang on n's least
        large = both.join(least, both.a == least.n).where("b > a").select(
            F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: n and its smaller neighbours hang on the least of them
        floor = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        hung = large.join(floor, large.a == floor.n).select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = hung.where("a <> b").unionByName(floor.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()
        after = written(after, "links")
        # done when every edge's lower end is a root and no node has two
        roots = after.select(F.col("b").alias("n")).distinct()
        inner = after.select(F.col("a").alias("n")).distinct()
        if inner.join(roots, "n", "left_semi").isEmpty() and \
                after.groupBy("a").count().where("count > 1").isEmpty():
            break
        now = after
    return after.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
