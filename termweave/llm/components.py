"""Connected components of a table of links, by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, a: str = "node", b: str = "other") -> DataFrame:
    """node and component (its smallest node) for each node with a link.

    Each round is written to the shared folder, so lineage stays short. Null ends and links to itself are left out;
    no links give an empty table. A node with very many links is one key of a join that Spark can split.
    """
    low, high = F.least(a, b).alias("low"), F.greatest(a, b).alias("high")
    edges = written(links.filter(F.col(a) != F.col(b)).select(low, high).distinct(), "links")
    before = None
    while (now := tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first())) != before:
        before = now
        both = edges.select(F.col("high").alias("u"), F.col("low").alias("v")).unionByName(edges.select(F.col("low").alias("u"), F.col("high").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("low"), F.col("v").alias("high"))
        large = large.unionByName(least.filter("m < u").select(F.col("m").alias("low"), F.col("u").alias("high"))).distinct()
        lowest = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(lowest, "high").filter("low <> m").select(F.col("m").alias("low"), F.col("low").alias("high"))
        edges = written(small.unionByName(lowest.select(F.col("m").alias("low"), "high")).distinct(), "links")
    # In stars, every node but the smallest has one edge.
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(edges.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
