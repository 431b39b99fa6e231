"""Connected components of a graph given as rows, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeway.runtime import cut, discard


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges``, root being the least node that it reaches.

    Large-star and small-star rounds on rows of node pairs: each round is two aggregations by minimum
    (summed before the shuffle) and two joins. The minima are written before they are joined, so that both sides
    of a join are exchanged and Spark splits a node with very many neighbours. Every round is written and the round
    before it deleted; the number of rounds grows with the logarithm of the graph's diameter.
    """
    e = cut(edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).filter("u != v").distinct())  # v < u
    seen = None
    for _ in range(max_rounds):
        # Large star: u's greater neighbours get the least of u's neighbourhood.
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = cut(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")))
        large = both.filter("y > x").join(least, "x").select(F.col("m").alias("v"), F.col("y").alias("u")).filter("u != v").distinct()
        # Small star: u and its lesser neighbours get the least of these.
        large = cut(large)
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("m").alias("v"), F.explode(F.array("v", "u")).alias("u")).filter("u != v").distinct()
        before, e = e, cut(small)
        discard(before, least, large, low)
        state = e.agg(F.count("*").alias("n"), F.countDistinct("u").alias("nodes"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if tuple(state) == seen and state["n"] == state["nodes"]:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
