"""Connected components by stars of least neighbours, and following links to their end. Both cut lineage each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import checkpoint


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root, the least node that it is joined to, for all nodes of the edges; an edge from a node to itself names a lone one, one from or to null is none.

    Every round hangs each node's larger neighbours on its least one, and then its smaller ones, so
    that components become stars in a number of rounds that grows with the logarithm of their size.
    A node's neighbours are never gathered: their least one is a sum before the shuffle.
    """
    plain = checkpoint(edges.dropna(subset=[a, b]).select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).distinct())
    nodes = plain.select(F.explode(F.array("low", "high")).alias("node")).distinct()
    links = plain.filter("low <> high")
    before = None
    while True:
        both = links.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(links.select(F.col("high").alias("u"), F.col("low").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("low"), F.col("v").alias("high")).filter("low <> high").distinct()
        # each node's smaller neighbours and itself go to the least of them
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(least, "high").select(F.explode(F.array("low", "high")).alias("high"), F.col("m").alias("low")).filter("low <> high")
        links = checkpoint(small.select("low", "high").distinct())
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return nodes.join(links.groupBy("high").agg(F.min("low").alias("low")), F.col("node") == F.col("high"), "left").select("node", F.coalesce("low", "node").alias("root"))


def followed(links: DataFrame, old: str = "old", new: str = "id") -> DataFrame:
    """Links of a forest, each to the end of its way: twice as far each round. A node has one link."""
    ends = checkpoint(links.select(F.col(old).alias("old"), F.col(new).alias("id")))
    while True:
        ahead = ends.select(F.col("old").alias("id"), F.col("id").alias("next"))
        step = checkpoint(ends.join(ahead, "id", "left").select("old", F.coalesce("next", "id").alias("id"), F.col("next").isNotNull().alias("moved")))
        ends = step.drop("moved")
        if step.filter("moved").isEmpty():
            return ends.select(F.col("old").alias(old), F.col("id").alias(new))
