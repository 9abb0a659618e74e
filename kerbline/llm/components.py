"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.operators.stage import stage


def _to_smallest(edges: DataFrame) -> DataFrame:
    """(u, v, m) with m the smallest of u and its neighbours v.

    The minimum is pre-aggregated and joined back, so that a node with very many
    neighbours is no single task's work.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (u, v); the root is the smallest node of the component.

    Alternates two steps until nothing moves: each node hands its larger
    neighbours to its smallest one, then itself and its smaller neighbours. Each
    round is written to the shared folder and needs a few narrow shuffles; the
    number of rounds grows with the logarithm of the longest path.
    """
    now = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        large = _to_smallest(_both(now)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _to_smallest(large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        small = small.select("v", "m").union(small.select(F.col("u").alias("v"), "m")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        now = stage(small, "edges")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 31)).alias("s")).first()
        if state == before:
            break
        before = state
    # now every edge leads to its component's smallest node
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
