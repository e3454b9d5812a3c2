"""Connected components by alternating star contraction, in Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, settled


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) for each node of edges (a, b); comp is its least node.

    Large-star links every larger neighbour of u to u's least neighbour,
    small-star does the same for the smaller ones; both keep connectivity and
    end in one star per component, which is what the end of the rounds tests.
    Each step is joins and aggregates over the edges, settled in the shared
    folder; the aggregates are settled too, so that Spark can split a join on
    a centre with many edges. Nothing but whether to go on reaches the driver.
    Nodes without an edge to another are not in the result.
    """
    now = settled(edges.select("a", "b").where("a <> b").distinct())
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settled(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
        large = settled(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = settled(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = settled(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        twice = now.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
        inner = now.select("a").join(now.select(F.col("b").alias("a")), "a", "left_semi")
        more = twice.union(inner)
        done = more.isEmpty()
        freed(edges.sparkSession)
        if done:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return stars.union(stars.select(F.col("comp").alias("node"), "comp").distinct())
