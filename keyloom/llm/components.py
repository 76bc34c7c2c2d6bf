"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, written


def _lowest(links: DataFrame, total: int) -> DataFrame:
    """links (u, v) with m, the least of u and its neighbours."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    out = lookup(links, least, ["u"], "n", total, F.col("v"), "_least")
    return out.select("u", "v", F.least("u", F.col("_least.m")).alias("m"))


def _flat(links: DataFrame) -> bool:
    """Whether each node has one link at most, to a node that has none."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(links.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, label (the least node reachable) of every node that has a link. links: columns a, b in either order, repeats allowed.

    Each pass reads and writes the links in the shared folder, and the rows of a node with many links are spread
    over tasks. The passes grow with the logarithm of the longest chain.
    """
    links = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    total = 2 * links.count()
    while not _flat(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest(both, total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = _lowest(written(large, "links"), total)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        links = written(small.where("u != v").distinct(), "links")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
