"""Hard negatives for anchors, found through segment summaries.

A vector is cut into equal segments; of each segment its mean and its deviation (the root of the mean squared
distance from the mean) are stored. For two vectors the inner product within a segment of m components is
``m * (mean * mean' + r * deviation * deviation')`` with r between -1 and 1, so
``m * (mean * mean' + deviation * deviation')`` summed over segments is never below the score and the same with
a minus never above it. A pair whose bounds rule it out is not scored; the others are looked at again with
segments of half the length, and what is left after the shortest segments is scored exactly, in integers.

Anchors are a stated share of the rows. They are taken in blocks of a bounded number, and every block is held
against all rows: tasks read row batches, keep the best of each anchor seen so far (which is what later rows
must reach), and hand over no more than that, so what is shuffled is a few rows per anchor and task.

Defined results: rows take no part that have no label, no vector or a component that is NULL or not finite;
vectors of different lengths are not compared; rows are told apart by id, so repeated rows, and rows of one id
and equal score, count once, and rows of the anchor's own id are neither its positives nor its negatives; rows
without id can be neither anchor nor answer; equal scores are ordered by id; an anchor without positives, or a
positive without negatives in its range, has no rows; an empty table gives an empty result; further columns are
not read. Scores are exact up to 2**53 in size, above that compared as doubles and held at 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gatewise.session import written

#: Components are scaled by this and rounded down.
SCALE = 256
#: Components of all anchors of a pass: 4096 vectors of 64, with their summaries about 6 MB for each executor.
BLOCK = 1 << 18
#: Pairs whose first bounds are worked out together, and components of pairs gathered together: 8 MB of doubles each.
PAIRS, GATHERED = 1 << 20, 1 << 20
#: While more than one in so many pairs is left, a matrix product over all of them is cheaper than gathering those left.
DENSE = 16
#: Lengths of segments, the longest first; the last level is followed by exact scores.
SEGMENTS = (16, 8, 4, 2)
_LARGEST = (1 << 63) - 1
_FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass(frozen=True)
class Mining:
    """How many positives an anchor has, how many negatives each of them gets, and their range in percent of its score."""

    positives: int = 5
    negatives: int = 10
    lowest: int = 30
    highest: int = 90


# ---- vectors ----------------------------------------------------------------------------------------------


class Summaries:
    """Integer vectors with the means and deviations of their segments on every level."""

    def __init__(self, x: np.ndarray):
        self.x = x
        width = x.shape[1]
        self.levels = []
        for size in SEGMENTS:
            if size < max(width, 2):
                begins = np.arange(0, width, size)
                sizes = np.diff(np.r_[begins, width]).astype(float)
                mean = np.add.reduceat(x, begins, axis=1) / sizes
                square = np.add.reduceat((x - np.repeat(mean, sizes.astype(int), axis=1)) ** 2, begins, axis=1)
                # weights of a segment are spread evenly over both vectors
                self.levels.append((mean * np.sqrt(sizes), np.sqrt(square)))
        self.norms = np.sqrt((x * x).sum(axis=1))

    def take(self, rows) -> "Summaries":
        out = object.__new__(Summaries)
        out.x, out.norms = self.x[rows], self.norms[rows]
        out.levels = [(m[rows], d[rows]) for m, d in self.levels]
        return out


def _exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether doubles hold all sums of products of these whole numbers exactly."""
    return float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2**53


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers held as doubles."""
    if _exact(a, b):
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    exact = [sum(int(p) * int(q) for p, q in zip(u, v)) for u, v in zip(a, b)]
    return np.array([max(-_LARGEST, min(_LARGEST, s)) for s in exact], np.int64)


def candidates(anchors: Summaries, rows: Summaries, wanted: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (anchor, row, score) among the ``wanted`` with ``least <= score <= most``, both per anchor.

    A level is worked out for all pairs while many are left, and then for those only.
    """
    # what rounding may add to a bound
    slack = 1e-9 * np.outer(anchors.norms, rows.norms) + 1e-6
    left, level, dense = wanted, 0, lambda pairs: np.count_nonzero(pairs) * DENSE > pairs.size
    while level < len(anchors.levels) and dense(left):
        (am, ad), (rm, rd) = anchors.levels[level], rows.levels[level]
        middle, spread = am @ rm.T, ad @ rd.T + slack
        left = left & (middle + spread >= least[:, None]) & (middle - spread <= most[:, None])
        level += 1
    if level == len(anchors.levels) and dense(left) and _exact(anchors.x, rows.x):
        whole = anchors.x @ rows.x.T
        a, r = np.nonzero(left & (whole >= least[:, None]) & (whole <= most[:, None]))
        return a, r, whole[a, r].astype(np.int64)
    every_a, every_r = np.nonzero(left)
    out = []
    step = max(1, GATHERED // max(1, anchors.x.shape[1]))
    for lo in range(0, len(every_a), step):
        a, r = every_a[lo:lo + step], every_r[lo:lo + step]
        for (am, ad), (rm, rd) in zip(anchors.levels[level:], rows.levels[level:]):
            middle = np.einsum("ij,ij->i", am[a], rm[r])
            spread = np.einsum("ij,ij->i", ad[a], rd[r]) + slack[a, r]
            stays = (middle + spread >= least[a]) & (middle - spread <= most[a])
            a, r = a[stays], r[stays]
        s = scores(anchors.x[a], rows.x[r])
        stays = (s >= least[a]) & (s <= most[a])
        out.append((a[stays], r[stays], s[stays]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(part) for part in zip(*out))


class Best:
    """The best rows so far in each of ``n`` lists of at most ``k``: highest scores first, then the smallest ids."""

    def __init__(self, n: int, k: int):
        self.k, self.size = k, np.zeros(n, np.int64)
        self.key, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, key: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        key, ids, score = np.r_[self.key, key], np.r_[self.id, ids], np.r_[self.score, score]
        order = np.lexsort((ids, -score, key))
        key, ids, score = key[order], ids[order], score[order]
        if len(key):
            new = np.r_[True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]) | (score[1:] != score[:-1])]
            key, ids, score = key[new], ids[new], score[new]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        stays = place < self.k
        self.key, self.id, self.score = key[stays], ids[stays], score[stays]
        self.size = np.bincount(self.key, minlength=len(self.size))

    def floor(self) -> np.ndarray:
        """What a row must score to enter each list."""
        out = np.full(len(self.size), -np.inf)
        ends = np.cumsum(self.size) - 1
        full = self.size == self.k
        out[full] = self.score[ends[full]]
        return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def _row_batches(frames, blocks: dict[int, "_Anchors"]) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Rows of one vector length that anchors have, so many at a time that their pairs are bounded."""
    for batch in frames:
        lengths = batch.column(batch.schema.get_field_index("width")).to_numpy()
        for width in set(np.unique(lengths).tolist()) & set(blocks):
            part = batch.filter(pa.array(lengths == width))
            step = max(1, PAIRS // len(blocks[width].id))
            for lo in range(0, len(part), step):
                yield part.slice(lo, step), width


@dataclass
class _Anchors:
    """Anchors of one block and one vector length; ``windows``: bounds (least, most) per anchor and positive, NaN for none."""

    id: np.ndarray
    number: np.ndarray
    label: np.ndarray
    vectors: Summaries
    windows: np.ndarray | None = None


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _best_same_label(blocks: dict[int, _Anchors], k: int):
    def work(frames):
        best = {w: Best(len(b.id), k) for w, b in blocks.items()}
        for batch, width in _row_batches(frames, blocks):
            block, held = blocks[width], best[width]
            rows, ids, label = Summaries(_matrix(batch.column(batch.schema.get_field_index("x")), width)), _column(batch, "id"), _column(batch, "label")
            for value in np.unique(label):  # an anchor meets rows of its own label only
                ours, theirs = np.flatnonzero(block.label == value), np.flatnonzero(label == value)
                if not len(ours):
                    continue
                mine, other = block.vectors.take(ours), rows.take(theirs)
                wanted = block.id[ours][:, None] != ids[theirs][None, :]
                a, r, s = candidates(mine, other, wanted, held.floor()[ours], np.full(len(ours), np.inf))
                held.add(ours[a], ids[theirs[r]], s)
        for width, held in best.items():
            yield pa.RecordBatch.from_pydict({"anchor": blocks[width].number[held.key], "id": held.id, "score": held.score})

    return work


def _best_in_windows(blocks: dict[int, _Anchors], k: int):
    """The rows that are among the best ``k`` of one of the anchor's windows, each once."""
    def work(frames):
        state = {}
        for width, block in blocks.items():
            state[width] = Best(block.windows.shape[0] * block.windows.shape[1], k)
        for batch, width in _row_batches(frames, blocks):
            block, held = blocks[width], state[width]
            n = block.windows.shape[1]
            rows, ids, label = Summaries(_matrix(batch.column(batch.schema.get_field_index("x")), width)), _column(batch, "id"), _column(batch, "label")
            least, most = block.windows[:, :, 0], block.windows[:, :, 1]
            floor = np.fmax(least, held.floor().reshape(least.shape))
            some = ~np.isnan(least).all(axis=1)
            lowest = np.where(some, np.nanmin(np.where(np.isnan(least), np.inf, floor), axis=1), np.inf)
            highest = np.where(some, np.nanmax(np.where(np.isnan(most), -np.inf, most), axis=1), -np.inf)
            wanted = (block.label[:, None] != label[None, :]) & (block.id[:, None] != ids[None, :])
            a, r, s = candidates(block.vectors, rows, wanted, lowest, highest)
            for j in range(n):
                inside = (s >= floor[a, j]) & (s <= most[a, j])
                if inside.any():
                    held.add(a[inside] * n + j, ids[r[inside]], s[inside])
        for width, held in state.items():
            block = blocks[width]
            found = pd.DataFrame({"anchor": block.number[held.key // block.windows.shape[1]], "id": held.id, "score": held.score})
            yield pa.RecordBatch.from_pandas(found.drop_duplicates(), preserve_index=False)

    return work


# ---- Spark ------------------------------------------------------------------------------------------------


def labelled_vectors(table: DataFrame, vec_id: str, vector: str, label: Column, anchors: Column) -> DataFrame:
    """Rows that take part: id, label, whole-number vector, its length and whether the row is an anchor."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = table.where(F.col(vec_id).isNotNull() & label.isNotNull() & x.isNotNull() & finite)
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("double"))
    return rows.select(
        F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), scaled.alias("x"),
        F.size(x).alias("width"), F.coalesce(anchors, F.lit(False)).alias("chosen"))


def _loaded(rows: pd.DataFrame) -> dict[int, _Anchors]:
    return {
        int(width): _Anchors(
            part["id"].to_numpy(np.int64), part["anchor"].to_numpy(np.int64), part["label"].to_numpy(np.int64),
            Summaries(np.array(part["x"].tolist(), float)))
        for width, part in rows.groupby("width")}


def mine(table: DataFrame, anchors: Column, vec_id: str = "vec_id", vector: str = "embedding", label: Column | None = None,
         mining: Mining = Mining(), block: int = BLOCK) -> DataFrame:
    """Hard negatives of every anchor and positive: anchor_id, positive_id, rank, negative_id and both scores.

    ``anchors`` says which rows are anchors; ``block`` bounds the components of those taken in one pass over the rows,
    which, with their positives, are all that a pass brings to the driver and broadcasts.
    """
    label = F.col("label") if label is None else label
    rows = written(labelled_vectors(table, vec_id, vector, label, anchors), "negatives-rows")
    chosen = rows.where("chosen").drop("chosen").distinct().withColumn("anchor", F.monotonically_increasing_id())
    chosen = written(chosen, "negatives-anchors")
    at_once = max(1, block // max(1, chosen.agg(F.max("width")).first()[0] or 0))
    results, last = [], -1
    while len(taken := chosen.where(F.col("anchor") > last).orderBy("anchor").limit(at_once).toPandas()):
        last = int(taken["anchor"].max())
        results.append(_pass(rows, taken, mining, len(results)))
    if not results:
        return table.sparkSession.createDataFrame([], _FOUND)
    return reduce(DataFrame.unionByName, results)


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` answers per key; tasks may have told the same one twice."""
    place = F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k).dropDuplicates([*keys, "place"])


def _pass(rows: DataFrame, anchors: pd.DataFrame, mining: Mining, number: int) -> DataFrame:
    """One block of anchors against all rows."""
    spark, found = rows.sparkSession, "anchor long, id long, score long"
    held = spark.sparkContext.broadcast(_loaded(anchors))
    same = rows.mapInArrow(lambda frames: _best_same_label(held.value, mining.positives)(frames), found)
    positives = written(_best(same, ["anchor"], mining.positives), f"negatives-positives-{number}")
    score = F.col("score").cast("decimal(20,0)")
    # bounds in whole numbers: least >= lowest % and most <= highest % of the positive's score
    ranges = positives.select(
        "anchor", "id", "score", "place",
        F.ceil(score * mining.lowest / 100).cast("double").alias("least"), F.floor(score * mining.highest / 100).cast("double").alias("most"))
    blocks, windows = _loaded(anchors), ranges.toPandas()  # at most ``positives`` rows per anchor of the block
    for b in blocks.values():
        bounds = np.full((len(b.id), mining.positives, 2), np.nan)
        at = {n: i for i, n in enumerate(b.number)}
        for r in windows.itertuples():
            if r.anchor in at and r.least <= r.most:
                bounds[at[r.anchor], r.place - 1] = r.least, r.most
        b.windows = bounds
    bounded = spark.sparkContext.broadcast(blocks)
    other = rows.mapInArrow(lambda frames: _best_in_windows(bounded.value, mining.negatives)(frames), found)
    ids = spark.createDataFrame(
        pd.DataFrame({"anchor": anchors["anchor"].astype("int64"), "anchor_id": anchors["id"].astype("int64")}), "anchor long, anchor_id long")
    # one row per (anchor, positive): a bounded side, as the block is
    windowed = ranges.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "place", "least", "most")
    windowed = windowed.join(F.broadcast(ids), "anchor")
    inside = other.join(F.broadcast(windowed.withColumnRenamed("place", "nth")), "anchor").where("score between least and most")
    ranked = _best(inside, ["anchor", "nth"], mining.negatives)
    return written(ranked.select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score")), f"negatives-{number}")


def negatives_report(table: DataFrame) -> DataFrame:
    """Anchors are the ids divisible by 100; every seventh label is the next one."""
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(table, F.col("vec_id") % 100 == 0, label=label)
