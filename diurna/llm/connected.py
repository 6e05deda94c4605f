"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diurna.llm.common import staged, unstage


def _stars(edges: DataFrame) -> bool:
    """Does every node point at one node only, which itself points nowhere?"""
    ends = edges.select(F.col("u").alias("k"), F.lit(1).alias("out"), F.lit(0).alias("met")).unionByName(
        edges.select(F.col("v").alias("k"), F.lit(0).alias("out"), F.lit(1).alias("met")))
    per_node = ends.groupBy("k").agg(F.sum("out").alias("out"), F.max("met").alias("met"))
    return not per_node.filter("out > 1 or out = 1 and met = 1").limit(1).count()


def roots(links: DataFrame) -> DataFrame:
    """(u, v): every node u that is not the smallest of its component, with that smallest node v.

    links: (u, v) in either order. Each round points all neighbours of a node at the smallest
    one, first the larger neighbours, then the smaller ones, so paths shorten by half or more;
    rounds end when all edges are stars, which no round changes. Per-node minima are combined before the shuffle and
    a node with very many neighbours is only a skewed join, which adaptive execution splits.
    """
    edges = staged(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                   .filter("u > v").distinct(), "edges")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        after = staged(small.unionByName(smallest.withColumnRenamed("m", "v")).distinct(), "edges")
        unstage(edges)
        edges = after
    return edges
