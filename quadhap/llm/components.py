"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadhap.llm.common import cut_lineage


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """Smallest neighbour of each left node. Stored, so that the join behind it can split a node with very many edges."""
    return cut_lineage(edges.groupBy("a").agg(F.min("b").alias("least")))


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns a, b: bigint); root is the smallest node reachable.

    Each round hangs larger neighbours on a node's smallest neighbour (large star), then
    smaller ones on the smallest (small star); edges never outgrow the input. Rounds are
    about the logarithm of the longest chain; a chain that is not flat after ``rounds`` is an error.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = cut_lineage(links)
    before = _signature(links)
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least_neighbour(both).select("a", F.least("a", "least").alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        large = cut_lineage(large)
        least = _least_neighbour(large)
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
        links = cut_lineage(small.where("a <> b").distinct())
        after = _signature(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components are not flat after {rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
