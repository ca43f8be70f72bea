"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.runtime import materialize, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of every vertex on the smallest vertex that it sees."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(low, "u")
    if large:
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
    moved = moved.filter("u <> v")
    return moved if large else moved.distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether all edges are rays of stars whose centres are their smallest vertices."""
    hangs = F.when(F.col("u") < F.col("v"), 2).otherwise(1)  # an edge up is never settled
    ends = edges.select(F.col("u").alias("x"), hangs.alias("hangs"), F.lit(0).alias("holds")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("hangs"), F.lit(1).alias("holds"))
    )
    return ends.groupBy("x").agg(F.sum("hangs").alias("n"), F.max("holds").alias("m")).filter("n + m > 1").isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge to another; component is the smallest node reachable.

    Alternating large-star and small-star rounds: each round is two aggregations and two joins on
    vertices, the number of rounds grows with the logarithm of the longest path, and a vertex with very many
    neighbours only meets partial aggregation and joins that adaptive execution can split.
    Rows with a null end and self-loops are no edges.
    """
    state = materialize(
        edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
        .filter("u is not null and v is not null and u <> v")
        .distinct(),
        "edges",
    )
    for _ in range(max_rounds):
        if _settled(state):
            break
        before, state = state, materialize(_star(_star(state, large=True), large=False), "stars")
        release(before)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
