"""Connected components by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalgraph.llm import common as C


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _least(pairs: DataFrame) -> DataFrame:
    """Smallest of each node and its neighbours."""
    return pairs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    pairs = _both_ways(edges)
    return pairs.filter("b > a").join(_least(pairs), "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down)
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b")))


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node it is linked to, by any number of steps)
    for every node of ``links`` (``a``, ``b``: long) that has a link to another node.

    Rounds are settled tables; the driver reads a count and a checksum of each. They go
    on until the table stays as it is: about the square of the logarithm of the nodes.
    """

    def normal(edges):
        return edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(edges):
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = C.settle(normal(links), "links")
    before = mark(edges)
    while True:
        stars = C.settle(normal(_small_star(normal(_large_star(edges)))), "stars")
        C.discard(edges)
        edges, after = stars, mark(stars)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
