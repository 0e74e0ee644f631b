"""Connected components of a graph of links, by alternating large-star and small-star steps.

Each step joins the links with one row per node, so that a node with any number of links stays a set of plain rows; no
neighbourhood is gathered. Steps are cut with checkpoints in the shared folder and repeat until the links are stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the node's least neighbour, or the node itself."""
    pairs = _both(links)
    least = pairs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return pairs.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for each node of ``links`` (columns a and b) but the roots.

    Links may repeat, in either direction, and link a node to itself; rows with a null are no links.
    """
    links = checkpointed(links.select("a", "b").where("a <> b").distinct())
    mark = None
    while True:
        links = checkpointed(_small_star(_large_star(links)))
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
