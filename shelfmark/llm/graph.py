"""Connected components by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.shared import drop_written, written


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, root): for each node of a link, the smallest node that it reaches.

    Alternates two steps on the set of links until it no longer changes: every node links its larger neighbours to its
    smallest neighbour (large star), and its smaller ones and itself to the smallest (small star). Each step is a grouped
    minimum and a join. The minima are written before the join, whose sides are then both dealt for it alone: so Spark can split
    a hub's links, and no group is gathered. Rounds grow with the logarithm of the longest chain; each is written to the shared
    folder. Self links and repeated links are allowed; links with a null end go. An empty table gives an empty table.
    """
    edges = written(links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    known = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    mark = known(edges)
    while True:
        both = edges.union(edges.select("b", "a"))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = written(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        after = written(small.filter("a <> b").distinct(), "links")
        now = known(after)
        for x in (edges, least, large, low):
            drop_written(x)
        edges = after
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
