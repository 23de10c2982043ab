"""Distributed union-find: connected components of a table of links.

Alternates the large-star and small-star steps until no link changes.  Each
step is two aggregates and joins on a node; the minimum of a node's neighbours is an
aggregate with partial sums, so a node with very many links is never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._shared import drop, settle


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links``; root is the least node it reaches.

    Nodes are integers; links without a node (null) and loops are ignored.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    edges = settle(edges, "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written, so that both sides of a join are plain exchanges and a node with very many links is split
        low = settle(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "least")
        # large star: every larger neighbour, and the node itself, goes to the least
        large = edges.join(low, edges["v"] == low["k"]).select("u", F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        large = settle(large, "large-star")
        drop(edges, low)
        # small star: smaller neighbours and the node go to the least of them
        low = settle(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m"), "least")
        small = large.join(low, large["u"] == low["k"])
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = settle(small.where("u != v").distinct(), "small-star")
        drop(large, low)
        now = tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first())
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
