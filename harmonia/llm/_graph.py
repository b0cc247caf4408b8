"""Connected components by alternating large-star and small-star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._store import discard, stash


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, component)`` for every node of some edge.

    ``component`` is the smallest node reachable.  Each round is two aggregations and two joins
    over the remaining edges and is written to the shared folder, so lineage never grows.  The
    minima of the large-star step are materialised before they are joined, which leaves both
    sides of that join plain exchanges: adaptive execution can split the edges of a hub.
    Nulls and self loops are ignored; an empty input gives an empty result.
    """
    current = stash(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    for _ in range(max_rounds):
        rows, nodes = current.agg(F.count("*"), F.countDistinct("u")).first()
        # Done when every node points to one other that points nowhere: stars, whose centres are the least nodes.
        if rows == nodes and current.join(current.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        both = current.select(F.col("u").alias("x"), F.col("v").alias("n")).unionByName(
            current.select(F.col("v").alias("x"), F.col("u").alias("n"))
        )
        least = stash(both.groupBy("x").agg(F.min("n").alias("m")).select("x", F.least("x", "m").alias("m")))
        large = (
            both.where("n > x").join(least, "x").select(F.col("n").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(small_min, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .unionByName(small_min.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = stash(small)
        discard(current, least)
        current = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
