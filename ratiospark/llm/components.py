"""Connected components of a table of edges, in rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b): longs -> (node, root): every node of an edge and the smallest node of its component.

    Each round links the larger neighbours of a node, then its smaller ones, to the smallest of all: the number of rounds grows
    with the logarithm of the longest path. Minimums are aggregated before the shuffle and the joins' large partitions can
    be split, so that no node's neighbours meet in one task. Rounds are written down. Edges with a null don't count."""
    links = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a > b").distinct(), "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        large = written(large, "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a > b").distinct()
        discard(links)
        links = written(small, "links")
        discard(large)
        now = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"), F.countDistinct("a").alias("nodes")).first()
        if tuple(now) == before and now["n"] == now["nodes"]:
            break
        before = tuple(now)
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
