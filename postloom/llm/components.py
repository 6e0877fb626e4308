"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import join_one, materialise


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("links"))
    return join_one(both.filter("b > a"), least, "a", "links", 2 * count, 2 * count).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    """``edges`` point from the larger to the smaller node."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("links"))
    return join_one(edges, least, "a", "links", count, count).select(F.col("b").alias("a"), F.col("m").alias("b")).filter(
        "a > b").unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component): every node of ``links(a, b)`` with the smallest node it reaches.

    Each round is written under ``spark.checkpoint.dir`` and read by the next; rounds grow with the logarithm
    of the diameter. Groups are only ever reduced to their minimum, so a hub's links combine before the
    shuffle, and the minimum of a hub is sent to its links, which stay where they are. Raises when ``most_rounds`` do not suffice. Null ends and loops link nothing.
    """
    ends = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = materialise(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = state
        edges = materialise(_small_star(_large_star(edges, state[0]).distinct(), state[0]).distinct(), "links")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
