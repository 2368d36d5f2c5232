"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of cells. Every shard owns some virtual nodes, each a cell; a key belongs to
the next virtual node clockwise. A shard takes at most its share of the rows, n / shards rounded up or
down so that shares add up to n. Each shard first takes keys of its own arcs, in ring order, up to its
share. What an arc holds beyond that continues clockwise to the next virtual nodes whose shards
have room. So row counts differ by one at most, and only overflowing keys leave their shard.

Who takes how many keys of which arc is decided on one count per virtual node, a table bounded by
``shards * nodes`` whatever the input; rows are then placed by their rank in their arc. Ranks are
made in two steps, counts per cell and row numbers inside; a cell with many rows (a hot or NULL key)
is split, so that no task ranks more than about ``CELL_ROWS`` of them.

Defined results: NULL text has no bytes; a NULL key is a key like any other; repeated rows each get a
slot of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gatewise.session import written

NODES = 64
CELL_ROWS = 1_000_000
ROW_BYTES = 16
SHARDS = 40


def ring(spark: SparkSession, shards: int, nodes: int = NODES) -> DataFrame:
    """cell, node (its cell's number), shard for every cell of the ring; at least 16 cells per node."""
    cells = 1 << max(16, (16 * shards * nodes - 1).bit_length())
    node = spark.range(shards * nodes).select((F.col("id") % shards).cast("int").alias("shard"), F.expr(f"id div {shards}").alias("v"))
    node = node.withColumn("cell", F.pmod(F.xxhash64("shard", "v"), F.lit(cells)))
    node = node.groupBy("cell").agg(F.min("shard").alias("shard"))  # of nodes on one cell one stays
    # One row per virtual node, a table of fixed size; an arc begins behind the node before it.
    line = Window.orderBy("cell")
    last = F.max("cell").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    node = node.withColumn("before", F.coalesce(F.lag("cell").over(line), last - cells))
    arc = F.explode(F.sequence(F.col("before") + 1, F.col("cell")))
    return node.select(F.col("cell").alias("node"), "shard", arc.alias("cell")).select(F.pmod("cell", F.lit(cells)).alias("cell"), "node", "shard")


def allot(arcs: list[tuple[int, int, int]], shards: int) -> list[dict]:
    """Ranges of arcs to shards, from (node, shard, keys) in ring order.

    Each entry gives the ranks [lo, hi) of an arc, the shard that takes them and the first slot there.
    """
    total = sum(n for _, _, n in arcs)
    free = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    out = []

    def take(node: int, lo: int, n: int, shard: int) -> None:
        if n:
            out.append({"node": node, "lo": lo, "hi": lo + n, "shard": shard, "slot": used[shard]})
            used[shard] += n
            free[shard] -= n

    over = []
    for node, shard, n in arcs:
        own = min(n, free[shard])
        take(node, 0, own, shard)
        over.append((node, own, n))
    moving: deque[list[int]] = deque()
    for lap in range(2):
        for (node, shard, _), (_, lo, hi) in zip(arcs, over):
            while moving and free[shard]:
                first = moving[0]
                n = min(free[shard], first[2] - first[1])
                take(first[0], first[1], n, shard)
                first[1] += n
                if first[1] == first[2]:
                    moving.popleft()
            if lap == 0 and lo < hi:
                moving.append([node, lo, hi])
    return out


def assign(rows: DataFrame, key: str, shards: int, nodes: int = NODES, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``; columns other than those are kept."""
    spark = rows.sparkSession
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    table = written(ring(spark, shards, nodes), "ring")
    cells = table.count()
    # The task that reads a row is part of the salt: repeated rows are alike otherwise.
    salt = F.xxhash64(*kept, F.spark_partition_id())
    keyed = rows.select(*kept).withColumn("_hash", F.xxhash64(key)).withColumn("_salt", salt)
    keyed = written(keyed.withColumn("_cell", F.pmod("_hash", F.lit(cells))), "keyed")
    parts = keyed.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / cell_rows).alias("_parts"))
    where = table.select(F.col("cell").alias("_cell"), F.col("node").alias("_node")).join(F.broadcast(parts), "_cell")
    where = written(where, "cells")
    placed = keyed.join(F.broadcast(where), "_cell").withColumn("_part", F.pmod("_salt", F.col("_parts")))
    counts = written(placed.groupBy("_node", "_cell", "_part").agg(F.count(F.lit(1)).alias("_n")), "counts")
    arcs = table.where("cell = node").join(counts.groupBy(F.col("_node").alias("node")).agg(F.sum("_n").alias("n")), "node", "left")
    arcs = arcs.select("node", "shard", F.coalesce("n", F.lit(0)).alias("n")).orderBy("node").collect()  # one row per virtual node
    ranges = json.dumps(allot([(r.node, r.shard, r.n) for r in arcs], shards))
    kind = "array<struct<node:bigint,lo:bigint,hi:bigint,shard:int,slot:bigint>>"
    ranges = spark.range(1).select(F.inline(F.from_json(F.lit(ranges), kind)))
    ahead = Window.partitionBy("_node").orderBy("_cell", "_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_node", "_cell", "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_cell", "_part").orderBy("_hash", "_salt")
    ranked = placed.withColumn("_rank", F.row_number().over(inside))
    ranked = ranked.join(before.drop("_node"), ["_cell", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_before") - 1)
    ranges = ranges.select(F.col("node").alias("_node"), "lo", "hi", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    hit = ranked.join(F.broadcast(ranges), "_node").where((F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi")))
    return hit.select(*kept, F.col("_shard").alias("shard"), (F.col("_slot") + F.col("_rank") - F.col("lo")).alias("slot"))


def shard_report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Documents over shards by row counts; the law that holds is ``rows``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    done = assign(rows, "doc_id", shards)
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
