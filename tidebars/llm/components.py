"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.durable import written


def components(links: DataFrame) -> DataFrame:
    """(node, component): for every node of (a, b) links the smallest node of its component.

    Alternating large-star and small-star rounds: each node hands its larger, then its
    smaller neighbours to the smallest one, until a round changes no link: then all are stars
    around the minima. There is no limit on rounds; their number grows with the logarithm of the nodes.
    Rounds are written, the neighbours of a node are never gathered, and a node with very
    many links is split by the joins. Links of a node to itself keep it as its own component.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node that is the smallest of its own neighbourhood keeps no larger one, so small-star needs each link once
        large = large.union(edges.filter("u = v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(down, F.col("u") == F.col("k")).select("u", "v", "m")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        edges = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v")).groupBy("node").agg(F.min("component").alias("component"))
