"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root for every node of the edges (columns a, b, any integer type); root is the least node of its component.

    Each round moves every link to the least neighbour known so far: all greater neighbours
    first, then the smaller ones. Links only ever join nodes of one component, so the
    number of rows never grows, and the rounds are logarithmic in the longest path. Minima
    are combined before each shuffle; a node with very many links is a skewed key of an
    inner join, which adaptive execution splits.
    """
    links = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    for _ in range(max_rounds):
        before = _mark(links)
        links = cut(_small_star(_large_star(links)))
        if _mark(links) == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError("components did not settle")


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    moved = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
    moved = links.join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct()
