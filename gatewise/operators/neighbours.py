"""Exact nearest neighbours of weighted vectors, certified by boxes around their parts.

A k-d tree over a hash sample of the reference rows cuts space into leaves; the box of a leaf is the least and greatest
value of each coordinate among all its rows. A leaf with many reference rows is dealt into parts by hash. For a row and a
box the coordinates say how near the box's members can be at best, and how far they are at most; the latter bounds the
row's k-th distance. A first search inside the row's own part tightens the bound, a second one visits the parts of all
leaves that can hold something nearer. Rows that lie together are held against the boxes together and halved until few
boxes are left, so a row's own work does not grow with their number. Nothing that could be a neighbour is skipped, so the
result equals brute force, whatever the data.

What reaches the driver and is broadcast is one row per leaf and ``SAMPLE`` sample rows for each, ``pivots * rings`` leaves
at most. A task holds a few times ``block`` reference rows and asking rows: parts follow the reference rows of a leaf,
shares of a part the rows that ask. Vectors in the midst of many equally far ones visit many parts; that is time, not memory.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from gatewise.session import written

PIVOTS, RINGS = 256, 128  # their product bounds the number of leaves
SAMPLE = 8  # sample rows of a leaf
_FOUND = "vid bigint, nid bigint, d double, nw double"
_ASKED = "vid bigint, x binary, upper double, cell int, part int"
_SLACK = 1e-9  # bounds are widened by this share, far above rounding


def _distances(x: np.ndarray, y: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Scaled Euclidean distances of all rows of ``x`` to all rows of ``y``, summed in the order of the columns."""
    total, apart = np.zeros((len(x), len(y))), np.empty((len(x), len(y)))
    for j, p in enumerate(scale):
        if p == 0:
            continue
        if (y[:, j] == y[0, j]).all():  # one value, as flags in a leaf: one addition, none if all agree
            same = x[:, j] - y[0, j]
            if same.any():
                total += (same * same * p)[:, None]
            continue
        np.subtract(x[:, j, None], y[None, :, j], out=apart)
        np.multiply(apart, apart, out=apart)
        apart *= p
        total += apart
    return np.sqrt(total, out=total)


def _matrix(column: pd.Series) -> np.ndarray:
    """Rows of doubles from their bytes."""
    return np.frombuffer(b"".join(column)).reshape(len(column), -1)


def _steps(n: int, size: int = 256):
    return ((lo, min(lo + size, n)) for lo in range(0, n, size))


@dataclass(frozen=True)
class Tree:
    """Inner nodes send values up to ``cut`` of one column to ``left``, others to the node after it; leaves have a number."""

    column: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    leaf: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=int)
        todo = np.flatnonzero(self.leaf[at] < 0)
        while len(todo):
            node = at[todo]
            at[todo] = self.left[node] + (x[todo, self.column[node]] > self.cut[node])
            todo = todo[self.leaf[at[todo]] < 0]
        return self.leaf[at]


def _grow(points: np.ndarray, scale: np.ndarray, most: int) -> Tree:
    """The fullest node is cut first, in the column in which it is widest, near the median."""
    column, cut, left, leaf = [-1], [0.0], [-1], [-1]
    todo, root = [(-len(points), 0, points)], np.sqrt(scale)
    leaves = 1
    while todo and leaves < most:
        size, node, rows = heapq.heappop(todo)
        if -size <= SAMPLE:
            break
        width = (rows.max(axis=0) - rows.min(axis=0)) * root
        j = int(width.argmax())
        if not width[j] > 0:
            continue
        values = np.sort(rows[:, j])
        at = values[(len(values) - 1) // 2]
        if at == values[-1]:
            at = values[values < at][-1]
        column[node], cut[node], left[node] = j, float(at), len(leaf)
        goes_left = rows[:, j] <= at
        for part in (rows[goes_left], rows[~goes_left]):
            heapq.heappush(todo, (-len(part), len(leaf), part))
            column.append(-1), cut.append(0.0), left.append(-1), leaf.append(-1)
        leaves += 1
    ends = np.array(left) < 0
    return Tree(np.array(column), np.array(cut), np.array(left), np.where(ends, np.cumsum(ends) - 1, -1))


@dataclass(frozen=True)
class Boxes:
    """What is known of the leaves that hold reference rows; some ten thousand rows whatever the table."""

    cell: np.ndarray  # per box: its leaf, reference rows, least and greatest values, parts
    rows: np.ndarray
    least: np.ndarray
    most: np.ndarray
    parts: np.ndarray
    scale: np.ndarray

    def visits(self, x: np.ndarray, upper: np.ndarray, k: int):
        """(rows, boxes, upper) of all pairs of a row and a box that can hold a member as near as the row's bound."""
        upper = upper.copy()
        todo = [(np.arange(len(x)), np.arange(len(self.cell)))] if len(x) else []
        while todo:
            rows, at = todo.pop()
            low, high = x[rows].min(axis=0), x[rows].max(axis=0)
            far = np.maximum(self.most[at] - low, high - self.least[at])
            near = np.maximum(np.maximum(self.least[at] - high, low - self.most[at]), 0.0)
            full = self.rows[at] > k  # such a box has k rows besides the one that asks
            if full.any():
                upper[rows] = np.minimum(upper[rows], np.sqrt((far[full] ** 2 @ self.scale).min()) * (1 + _SLACK))
            at = at[np.sqrt(near**2 @ self.scale) <= upper[rows].max() * (1 + _SLACK) + _SLACK]
            if len(rows) > 16 and len(rows) * len(at) > 8192:
                width = (high - low) ** 2 * self.scale
                j = int(width.argmax())
                if width[j] > 0:
                    order = rows[np.argsort(x[rows, j], kind="stable")]
                    todo += [(order[: len(order) // 2], at), (order[len(order) // 2 :], at)]
                    continue
            for lo, hi in _steps(len(rows), 64):
                some = rows[lo:hi]
                near, far = np.zeros((len(some), len(at))), np.zeros((len(some), len(at)))
                for j, p in enumerate(self.scale):
                    below, above = self.least[at, j][None, :] - x[some, j, None], x[some, j, None] - self.most[at, j][None, :]
                    near += np.maximum(np.maximum(below, above), 0.0) ** 2 * p
                    far += np.minimum(below, above) ** 2 * p  # the farther side is the more negative one
                full = self.rows[at] > k
                if full.any():
                    upper[some] = np.minimum(upper[some], np.sqrt(far[:, full].min(axis=1)) * (1 + _SLACK))
                own, box = np.nonzero(np.sqrt(near) <= (upper[some] * (1 + _SLACK) + _SLACK)[:, None])
                yield some[own], at[box], upper[some][own]


def _nearest_bound(x: np.ndarray, vid: np.ndarray, y: np.ndarray, nid: np.ndarray, scale: np.ndarray, k: int) -> np.ndarray:
    """The distance of each row's k-th of the reference rows given; infinite if there are fewer."""
    bound = np.full(len(x), np.inf)
    if len(nid) >= k:
        for lo, hi in _steps(len(x)):
            d = _distances(x[lo:hi], y, scale)
            d[vid[lo:hi, None] == nid[None, :]] = np.inf
            bound[lo:hi] = np.partition(d, k - 1, axis=1)[:, k - 1]
    return bound


def _within(ask: pd.DataFrame, refs: pd.DataFrame, scale: np.ndarray, k: int) -> pd.DataFrame:
    """The reference rows nearest to each asking row up to a weight of ``k``, all equally far ones included."""
    out = []
    if len(ask) and len(refs):
        y, nid, nw = _matrix(refs["x"]), refs["vid"].to_numpy(), refs["w"].to_numpy(float)
        x, vid, upper = _matrix(ask["x"]), ask["vid"].to_numpy(), ask["upper"].to_numpy(float)
        for lo, hi in _steps(len(vid)):
            d = _distances(x[lo:hi], y, scale)
            d[vid[lo:hi, None] == nid[None, :]] = np.inf
            limit = upper[lo:hi] * (1 + _SLACK) + _SLACK
            # No more than k rows are needed for a weight of k; what is as far as the last of them stays.
            many = np.flatnonzero((d <= limit[:, None]).sum(axis=1) > k)
            if len(many):
                limit[many] = np.minimum(limit[many], np.partition(d[many], k - 1, axis=1)[:, k - 1])
            rows, cols = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
            out.append(pd.DataFrame({"vid": vid[lo:hi][rows], "nid": nid[cols], "d": d[rows, cols], "nw": nw[cols]}))
    return pd.concat(out) if out else pd.DataFrame({"vid": [], "nid": [], "d": [], "nw": []}).astype({"vid": "int64", "nid": "int64"})


def nearest_lists(found: DataFrame, k: int) -> DataFrame:
    """Of (vid, nid, d, nw) the nearest of each ``vid`` up to a weight of ``k``, with all as far as the last of them."""
    upto = W.partitionBy("vid").orderBy("d").rangeBetween(W.unboundedPreceding, W.currentRow)
    before = F.sum("nw").over(upto) - F.sum("nw").over(W.partitionBy("vid", "d"))
    return found.withColumn("_before", before).where(F.col("_before") < k).drop("_before")


def _place(vectors: DataFrame, scale: np.ndarray, most: int, block: int) -> DataFrame:
    """``vectors`` with ``cell``, the leaf they lie in, and ``x`` as bytes; the tree is grown over a hash sample."""
    fitted = vectors.where("w > 0")
    total = fitted.count()
    leaves = max(1, min(most, 2 * total // max(block, 1)))
    share = int(min(1.0, SAMPLE * max(1, min(most, total // max(block, 1))) / max(total, 1)) * 2**30)
    drawn = fitted.where(F.pmod(F.xxhash64("vid", F.lit(2)), F.lit(2**30)) < share).select("x").toPandas()
    points = np.array(drawn["x"].tolist(), dtype=float).reshape(-1, len(scale))
    tree = _grow(points[np.lexsort(points.T)], scale, leaves)

    def assign(frames):
        for frame in frames:
            x = np.array(frame["x"].tolist(), dtype=float).reshape(-1, len(scale))
            yield frame.assign(x=[row.tobytes() for row in x], cell=tree.leaves(x))

    made = vectors.select("vid", "w", "asks", "x").mapInPandas(assign, "vid bigint, w double, asks boolean, x binary, cell int")
    return written(made, "placed")


def _boxes(refs: DataFrame, scale: np.ndarray, block: int) -> Boxes:
    """The boxes of all leaves, merged from those that each batch of rows has of a leaf."""

    def span(frames):
        for frame in frames:
            x, cell = _matrix(frame["x"]), frame["cell"].to_numpy()
            order = np.argsort(cell, kind="stable")
            own, at, n = np.unique(cell[order], return_index=True, return_counts=True)
            if len(own):
                least, most = np.minimum.reduceat(x[order], at), np.maximum.reduceat(x[order], at)
                yield pd.DataFrame({"cell": own, "n": n, "least": list(least), "most": list(most)})

    made = refs.select("cell", "x").mapInPandas(span, "cell int, n bigint, least array<double>, most array<double>")
    sides = [
        F.array(*[side(F.col(name)[j]) for j in range(len(scale))]).alias(name) for side, name in ((F.min, "least"), (F.max, "most"))
    ]
    seen = made.groupBy("cell").agg(F.sum("n").alias("n"), *sides).toPandas().sort_values("cell")
    n = seen["n"].to_numpy()
    least, most = (np.array(seen[name].tolist(), dtype=float).reshape(-1, len(scale)) for name in ("least", "most"))
    return Boxes(seen["cell"].to_numpy(), n, least, most, np.maximum(1, -(-n // (2 * block))), scale)


def _leaf_table(spark, known: Boxes) -> DataFrame:
    """(cell, parts), one row per leaf."""
    return spark.createDataFrame(pa.table({"cell": pa.array(known.cell, pa.int32()), "parts": pa.array(known.parts, pa.int32())}))


def _paired(refs: DataFrame, asked: DataFrame, known: Boxes, block: int):
    """``asked`` rows (vid, x, upper, cell, part) beside the reference rows of the part they name, as a cogroup.

    A part that many rows ask is handed out as often as they fill shares of their own.
    """
    c = F.col
    asks = asked.groupBy("cell").agg(F.count(F.lit(1)).alias("asks"))
    shares = F.ceil(c("asks") / (c("parts") * 8 * block)).cast("int").alias("shares")
    shares = F.broadcast(_leaf_table(refs.sparkSession, known).join(asks, "cell").select("cell", "parts", shares))
    dealt = refs.join(shares, "cell").withColumn("part", F.pmod(F.xxhash64("vid"), c("parts")).cast("int"))
    dealt = dealt.withColumn("share", F.explode(F.sequence(F.lit(0), c("shares") - 1)))
    asked = asked.join(shares, "cell").withColumn("share", F.pmod(F.xxhash64("vid", F.lit(1)), c("shares")).cast("int"))
    group = ["cell", "part", "share"]
    asked = asked.select(*[c(n).alias(n) for n in ("vid", "x", "upper", *group)]).groupBy(*group)  # both sides may be one table
    return asked.cogroup(dealt.select("vid", "w", "x", *group).groupBy(*group))


def nearest(vectors: DataFrame, scale, k: int, pivots: int = PIVOTS, rings: int = RINGS, block: int = 2048) -> DataFrame:
    """(vid, nid, d, nw): for each row that ``asks`` the nearest reference rows up to a weight of ``k``.

    ``vectors``: vid (unique), w (copies; 0 for rows that are no reference rows), asks, x (doubles, none missing).
    The distance is the root of ``sum(scale * (x - y)**2)``. Rows equally far as the last one are all included, a row
    is not its own neighbour, and with fewer reference rows all of them are neighbours. Without any there is no result.
    There are ``pivots * rings`` leaves at most, of about ``block`` reference rows while that suffices.
    """
    scale = np.asarray(scale, dtype=float)
    placed = _place(vectors, scale, pivots * rings, block)
    refs, asking = placed.where("w > 0"), placed.where("asks")
    known = _boxes(refs, scale, block)

    def bound(ask: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        """The k-th of any reference rows is no nearer than the k-th of all."""
        if len(ask) and len(refs):
            x, y = _matrix(ask["x"]), _matrix(refs["x"])
            ask = ask.assign(upper=_nearest_bound(x, ask["vid"].to_numpy(), y, refs["vid"].to_numpy(), scale, k))
        return ask[["vid", "x", "upper"]]

    def visit(frames):
        """One row per part that can hold a neighbour."""
        for frame in frames:
            if not len(known.cell) or not len(frame):
                continue
            vid, x = frame["vid"].to_numpy(), frame["x"].to_numpy()
            for rows, at, upper in known.visits(_matrix(frame["x"]), frame["upper"].to_numpy(float), k):
                again = known.parts[at]
                number = np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again)
                rows, at, upper = np.repeat(rows, again), np.repeat(at, again), np.repeat(upper, again)
                for a, b in _steps(len(rows), 8192):
                    own = rows[a:b]
                    yield pd.DataFrame({"vid": vid[own], "x": x[own], "upper": upper[a:b], "cell": known.cell[at[a:b]], "part": number[a:b]})

    own = F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int").alias("part")
    first = asking.join(F.broadcast(_leaf_table(vectors.sparkSession, known)), "cell").select(
        "vid", "x", F.lit(float("inf")).alias("upper"), "cell", own)
    bounds = _paired(refs, first, known, block).applyInPandas(bound, "vid bigint, x binary, upper double")
    second = written(bounds.mapInPandas(visit, _ASKED), "second")
    look = lambda left, right: _within(left, right, scale, k)
    return nearest_lists(_paired(refs, second, known, block).applyInPandas(look, _FOUND), k)
