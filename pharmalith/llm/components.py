"""Connected components of a graph held in a DataFrame.

Alternating large-star and small-star rounds (Kiveris et al., "Connected
Components in MapReduce and Beyond").  Edges stay distributed: a round is
partial minima per node and joins that AQE may split where a node is hot, and
each round's edges are a written table, so no lineage grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import discard, materialise


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Join the neighbours of each node (larger ones, or no larger ones) to its least neighbour."""
    if larger:
        near = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select("u", "v")
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    # the key is an expression so that both sides are dealt for the join alone, which lets AQE split a hot node
    least = least.select(F.col("u").bitwiseXOR(F.lit(0)).alias("k"), F.least("u", "m").alias("m"))
    joined = near.join(least, F.col("u") == F.col("k"))
    if larger:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return out.where("u > v").distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` (the least node it reaches) for every node with an edge.

    Node ids are integers.  Self-loops, repeated edges and null ends are
    ignored; an empty edge table gives an empty result.
    """
    now = materialise(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(state) == seen or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen, before = tuple(state), now
        now = materialise(_star(_star(before, True), False), "edges")
        discard(before)
