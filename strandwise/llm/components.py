"""Connected components by alternating large-star and small-star rounds, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import materialize


def _to_smallest(pairs: DataFrame, keep: str) -> DataFrame:
    """For pairs (u, v): link every kept v to the smallest of u and its neighbours. A hub's rows are pre-aggregated, and its join can be split."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    both = pairs.filter(keep).join(least, "u")
    return both.select(F.col("v").alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label the nodes of an undirected edge table (columns a, b of one orderable type) with the smallest node they reach.

    Returns (node, root) for every node in an edge; null ends and self-loops are ignored, repeated edges
    count once, an empty table gives an empty result. Each round is written to the shared folder, which cuts lineage.
    """
    spark = edges.sparkSession
    now = edges.select("a", "b").filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(now, "edges")
    state = None
    for _ in range(max_rounds):
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (seen["n"], seen["x"]) == state or not seen["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        state = (seen["n"], seen["x"])
        two_way = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _to_smallest(two_way, "v > u").distinct()
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        now = materialize(small, "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
