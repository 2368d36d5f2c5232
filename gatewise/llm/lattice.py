"""Near duplicates among embeddings by lattice hashing on E8.

Vectors are normalised and projected at random to blocks of eight dimensions; each block is decoded to
the nearest point of the E8 lattice. A key is the points of two blocks; there are several tables of keys.
A vector is stored under its own key and looked up under that key and under keys with one block moved
to a neighbouring lattice point. Candidates are verified by their cosine in double precision.

Very close vectors are grouped first, in linear work: within a cell those within ``TIGHT`` of the
cell's least vector. All members of a group link with each other (twice that angle is below the
threshold's), so a group's pairs are counted, not listed. A group is hashed by its pivot, the mean
direction of some members; its radius is the largest angle of any member to it. Two groups whose
pivots' angle, plus or minus both radii, is within or beyond the threshold link wholly or not at all; for
the rest members are compared, block by block.

Vectors of different lengths never link: keys hold the length, so each length is hashed by its own projections in
the same job.

Defined results: vectors that are NULL, empty, zero or that hold NULL or non-finite
components link with nothing and are kept; equal vectors link, and only those of one length; repeated rows of one id are one vector
(the least by component order if they differ); rows without id are one row that links with nothing; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gatewise.llm import textbytes as tb
from gatewise.llm.components import components
from gatewise.session import written

COSINE = 0.9
TIGHT = 0.976
PIVOT_MEMBERS = 16
TABLES, BLOCKS, SCALE, PROBES = 14, 2, 1.8, 12
SEED = 11

#: The 240 shortest vectors of E8, doubled so that they are whole numbers.
SHORTEST = np.array(
    [v for v in itertools.product((-2, 0, 2), repeat=8) if sum(map(abs, v)) == 4]
    + [v for v in itertools.product((-1, 1), repeat=8) if sum(v) % 4 == 0], np.int64)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest point with whole coordinates of even sum."""
    r = np.rint(x)
    odd = (r.sum(1) % 2) != 0
    if odd.any():
        gap = x[odd] - r[odd]
        worst = np.abs(gap).argmax(1)
        rows = np.flatnonzero(odd)
        r[rows, worst] += np.where(gap[np.arange(len(rows)), worst] >= 0, 1, -1)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of every row, doubled."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.rint(2 * np.where(nearer[:, None], a, b)).astype(np.int64)


@functools.lru_cache(maxsize=16)
def projections(dim: int, tables: int = TABLES, blocks: int = BLOCKS) -> np.ndarray:
    """(tables, blocks, dim, 8) with orthonormal columns where the dimension allows, scaled to the lattice."""
    rng = np.random.default_rng(SEED)
    out = np.empty((tables, blocks, dim, 8))
    for t in range(tables):
        for b in range(blocks):
            g = rng.standard_normal((dim, 8))
            out[t, b] = np.linalg.qr(g)[0] if dim >= 8 else g / math.sqrt(dim)
    # Distances shrink by the root of 8 / dim when projected.
    return out * SCALE * math.sqrt(max(dim, 8) / 8)


_MIX = np.random.default_rng(SEED + 1).integers(1, 2**63, (16, 8), dtype=np.int64) | 1


def _block_keys(points: np.ndarray, block: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (points * _MIX[block % 16]).sum(-1)
        return (h ^ (h >> 29)) * _MIX[(block + 7) % 16, 0]


def keys(x: np.ndarray, proj: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Own keys (rows, tables) and probed keys (rows, tables, probes), the own key not among them.

    The neighbours probed are those nearest to the projected vector, over both blocks.
    """
    tables, blocks = proj.shape[:2]
    own = np.zeros((len(x), tables), np.int64)
    near = np.zeros((len(x), tables, probes), np.int64)
    with np.errstate(over="ignore"):
        for t in range(tables):
            points, ways, costs = [], [], []
            for b in range(blocks):
                y = x @ proj[t, b]
                p = decode(y)
                points.append(_block_keys(p, b))
                # |y - (p + v)|^2 - |y - p|^2 grows with -(y - p).v, all v being of one length
                gain = (y - p / 2) @ SHORTEST.T
                best = np.argpartition(-gain, probes, axis=1)[:, :probes]
                costs.append(-np.take_along_axis(gain, best, 1))
                ways.append(_block_keys(p[:, None, :] + SHORTEST[best], b))
            total = sum(points)
            own[:, t] = total
            cost = np.concatenate(costs, 1)
            moved = np.concatenate([total[:, None] - points[b][:, None] + ways[b] for b in range(blocks)], 1)
            pick = np.argpartition(cost, probes - 1, axis=1)[:, :probes] if probes else np.zeros((len(x), 0), np.int64)
            near[:, t] = np.take_along_axis(moved, pick, 1)
    return own, near


def _matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _hashed(tables: int, probes: int):
    """Rows (vec_id, table, key, own) of every vector; keys of different lengths differ."""
    def task(frames):
        for batch in frames:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                lengths = pc.list_value_length(part.column(1)).to_numpy()
                for dim in np.unique(lengths):
                    same = part.filter(pa.array(lengths == dim))
                    x = _matrix(same.column(1))
                    own, near = keys(x / np.linalg.norm(x, axis=1)[:, None], projections(int(dim), tables), probes)
                    every = np.concatenate([own[:, :, None], near], 2) ^ tb.mix(dim.astype(np.uint64).reshape(1)).astype(np.int64)
                    n, t, k = every.shape
                    ids = np.repeat(same.column(0).to_numpy(), t * k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids), pa.array(np.tile(np.repeat(np.arange(t, dtype=np.int32), k), n)), pa.array(every.ravel()), pa.array(np.tile(np.arange(k) == 0, n * t))],
                        ["vec_id", "t", "key", "own"],
                    )
    return task


def _dot(x: str, y: str):
    """NULL for vectors of different lengths."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def _cosine(x: str, y: str):
    return F.least(F.lit(1.0), _dot(x, y) / F.sqrt(_dot(x, x) * _dot(y, y)))


def tight_groups(vectors: DataFrame, turns: int = 4) -> DataFrame:
    """vec_id, vector and leader, who has the least id of the group."""
    hashed = vectors.mapInArrow(_hashed(turns, 0), "vec_id long, t int, key long, own boolean").drop("own")
    hashed = written(hashed.groupBy("vec_id").pivot("t", list(range(turns))).agg(F.first("key")), "cells")
    now = vectors.join(hashed, "vec_id").withColumn("leader", F.col("vec_id")).withColumn("alone", F.lit(True))
    for turn in range(turns):
        # Leaders so far and single vectors meet; of a cell only the least one takes others in.
        first = now.where("leader = vec_id").groupBy(F.col(str(turn)).alias("cell")).agg(F.min(F.struct(F.col("vec_id").alias("head"), F.col("vector").alias("center"))).alias("m"))
        met = now.join(first.select("cell", "m.head", "m.center"), F.col(str(turn)) == F.col("cell"), "left")
        cos = _cosine("vector", "center")
        joins = F.col("alone") & F.coalesce((F.col("head") < F.col("vec_id")) & (cos >= TIGHT), F.lit(False))  # a cell may have no leader
        met = met.withColumn("leader", F.when(joins, F.col("head")).otherwise(F.col("leader")))
        now = written(met.drop("cell", "head", "center", "alone"), "tight")
        if turn < turns - 1:
            # A leader with members is not moved any more.
            size = now.groupBy(F.col("leader").alias("vec_id")).agg((F.count(F.lit(1)) == 1).alias("alone"))
            now = now.join(size, "vec_id", "left").withColumn("alone", F.coalesce(F.col("alone"), F.lit(False)) & (F.col("leader") == F.col("vec_id")))
    return now.select("vec_id", "vector", "leader")


def group_pivots(members: DataFrame) -> DataFrame:
    """leader, size, radius and vector (the pivot) of every group; a single vector is its own pivot."""
    size = members.groupBy("leader").agg(F.count(F.lit(1)).alias("size"))
    many = members.join(size.where("size > 1"), "leader")
    drawn = F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("size") / PIVOT_MEMBERS)) == 0  # about so many of each group
    unit = F.transform("vector", lambda v: v / F.sqrt(_dot("vector", "vector")))
    parts = many.where(drawn | (F.col("vec_id") == F.col("leader"))).select("leader", F.posexplode(unit).alias("at", "v"))
    parts = parts.groupBy("leader", "at").agg(F.avg("v").alias("v"))
    pivots = parts.groupBy("leader").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda p: p["v"]).alias("pivot"))
    pivots = written(pivots, "pivots")
    reach = many.join(pivots, "leader").groupBy("leader").agg(F.max(F.acos(_cosine("vector", "pivot"))).alias("radius"))
    out = members.where("leader = vec_id").join(size, "leader").join(pivots, "leader", "left").join(reach, "leader", "left")
    return out.select("leader", "size", F.coalesce("radius", F.lit(0.0)).alias("radius"), F.coalesce("pivot", "vector").alias("vector"))


def candidate_pairs(vectors: DataFrame, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """Different pairs (a < b) of which one has a probed key that is the other's own."""
    hashed = written(vectors.mapInArrow(_hashed(tables, probes), "vec_id long, t int, key long, own boolean"), "keys")
    stored = hashed.where("own").select("t", "key", F.col("vec_id").alias("v"))
    met = hashed.select("t", "key", F.col("vec_id").alias("u")).join(stored, ["t", "key"]).where("u <> v")
    return met.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


def _count_blocks(frames):
    """Links between two blocks of members: the count of each member that has any."""
    for batch in frames:
        cols = {n: batch.column(n) for n in batch.schema.names}
        out_id, out_n, out_a, out_b = [], [], [], []
        for k in range(batch.num_rows):
            xs, ys = cols["xs"][k].values, cols["ys"][k].values
            x, y = _matrix(xs.field("vector")), _matrix(ys.field("vector"))
            cos = (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None])
            hit = cos >= COSINE
            for ids, n in ((xs.field("vec_id").to_numpy(), hit.sum(1)), (ys.field("vec_id").to_numpy(), hit.sum(0))):
                some = np.flatnonzero(n)
                out_id += ids[some].tolist()
                out_n += n[some].tolist()
                out_a += [cols["a"][k].as_py()] * len(some)
                out_b += [cols["b"][k].as_py()] * len(some)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (out_id, out_n, out_a, out_b)], ["vec_id", "n", "a", "b"])


def near_vectors(embeddings: DataFrame, block: int = 512) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = written(rows.groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")
    sound = rows.where(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & F.expr("forall(vector, v -> v is not null and not isnan(v) and abs(v) < double('Infinity'))"))
    # Scaled by the largest component, so that no square over- or underflows.
    top = F.array_max(F.transform("vector", lambda v: F.abs(v)))
    sound = sound.where(top > 0).withColumn("_top", top)
    sound = sound.select("vec_id", F.transform("vector", lambda v: v / F.col("_top")).alias("vector"))
    members = written(tight_groups(sound), "groups")
    leaders = written(group_pivots(members), "leaders")
    groups = leaders.select("leader", "size")
    pairs = candidate_pairs(leaders.select(F.col("leader").alias("vec_id"), "vector"))
    one = leaders.select([F.col(c).alias(f"a_{c}") for c in leaders.columns])
    two = leaders.select([F.col(c).alias(f"b_{c}") for c in leaders.columns])
    met = pairs.join(one, F.col("a") == F.col("a_leader")).join(two, F.col("b") == F.col("b_leader"))
    met = met.withColumn("cos", _cosine("a_vector", "b_vector")).withColumn("reach", F.col("a_radius") + F.col("b_radius"))
    limit, slack = math.acos(COSINE), 1e-7
    single = (F.col("a_size") == 1) & (F.col("b_size") == 1)
    verdict = (
        F.when(single, F.when(F.col("cos") >= COSINE, "all"))
        .when(F.acos("cos") + F.col("reach") <= limit - slack, "all")
        .when(F.acos("cos") - F.col("reach") <= limit + slack, "some"))
    met = written(met.withColumn("verdict", verdict).where("verdict is not null").select("a", "b", "a_size", "b_size", "verdict"), "verdicts")
    whole = met.where("verdict = 'all'")
    gained = whole.select(F.col("a").alias("leader"), F.col("b_size").alias("n")).unionByName(whole.select(F.col("b").alias("leader"), F.col("a_size").alias("n")))
    gained = gained.groupBy("leader").agg(F.sum("n").alias("gained"))
    # Members of groups that link in part are compared in blocks of bounded size.
    some = met.where("verdict = 'some'")
    asked = some.select(F.col("a").alias("leader")).unionByName(some.select(F.col("b").alias("leader"))).distinct()
    blocks = members.join(asked, "leader").join(groups, "leader")
    blocks = blocks.withColumn("blk", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("size") / block)))
    blocks = blocks.groupBy("leader", "blk").agg(F.collect_list(F.struct("vec_id", "vector")).alias("list"))
    compared = some.select("a", "b").join(blocks.select(F.col("leader").alias("a"), F.col("list").alias("xs")), "a").join(blocks.select(F.col("leader").alias("b"), F.col("list").alias("ys")), "b")
    partial = written(compared.mapInArrow(_count_blocks, "vec_id long, n long, a long, b long"), "partial")
    edges = whole.select("a", "b").unionByName(partial.select("a", "b").distinct())
    comps = components(edges).withColumnRenamed("id", "leader")
    counted = partial.groupBy("vec_id").agg(F.sum("n").alias("own"))
    out = members.select("vec_id", "leader").join(groups, "leader").join(gained, "leader", "left").join(comps, "leader", "left").join(counted, "vec_id", "left")
    zero = F.lit(0).cast("long")
    out = out.select("vec_id", (F.col("size") - 1 + F.coalesce("gained", zero) + F.coalesce("own", zero)).alias("n_links"), F.coalesce("component", "leader").alias("component_id"))
    done = rows.select("vec_id").join(out, "vec_id", "left").select("vec_id", F.coalesce("n_links", zero).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return done.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
