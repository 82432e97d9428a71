"""Connected components by alternating large and small stars, as grouped sums and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in `links` (u, v); the root is a component's smallest node.

    Each round hangs every node's larger neighbours, then the node itself, on the smallest neighbour; rounds
    go on until the links no longer change, after a number that grows with the log of the longest chain. No
    neighbour list is ever gathered, and links of a node that has very many of them meet its smallest neighbour where
    they are (`join_hot`), so such a node is no burden for a task.
    """
    links = common.cut(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _summary(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
        large = common.cut(common.join_hot(both.filter("v > u"), least.filter("n > 0"), "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = common.join_hot(large, low, "u", "n").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = common.cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = _summary(links)
        if now == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def _summary(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
