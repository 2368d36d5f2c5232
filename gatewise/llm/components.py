"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum and a join; a node with very many neighbours is summed map-side and its
join is split by adaptive execution. The edge table is written after every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gatewise.session import written

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (u > v) linked to the least neighbour of each node, over all or over smaller ones."""
    near = edges.select("u", "v")
    if large:
        near = near.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = near.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """id and component (its least id) of every node of ``edges`` (two long columns) that is not the least."""
    a, b = edges.columns
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    now = written(pairs, "edges")
    state = None
    for _ in range(MAX_ROUNDS):
        now = written(_star(_star(now, True), False), "edges")
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = tuple(row)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
