"""Models over feature rows: a lookup prior, two supervised and three anomaly models.

``fit`` steps run jobs and return small fitted objects, as Spark ML does; scoring is
lazy. Scores are rounded to four digits so that evaluation works on a small histogram.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gatewise.functions.risk import FEATURES
from gatewise.functions.text import seeded_hash
from gatewise.operators.neighbours import nearest, nearest_lists
from gatewise.session import written

_DIGITS = 4


def numeric(features: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """Features as doubles, other columns untouched."""
    return features.withColumns({n: F.col(n).cast("double") for n in names})


def train_share(train: DataFrame, label: str = "is_attack_ip") -> DataFrame:
    """Rows, positives and share of positives of the train side."""
    return train.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(label).alias("positives"),
        F.avg(F.when(F.col(label), 1.0).otherwise(0.0)).alias("share"),
    )


# ------------------------------------------------------------------- IP prior

def ip_prior(train: DataFrame, test: DataFrame, label: str = "is_gold") -> DataFrame:
    """Test rows scored by the label mean of their address in train, else the global mean.

    Train is combined per address on the map side; in the left join AQE splits an
    address that holds many test rows.
    """
    hit = F.when(F.col(label), 1.0).otherwise(0.0)
    means = train.groupBy("ip").agg(F.avg(hit).alias("prior"))
    overall = train.agg(F.avg(hit).alias("m"))
    joined = test.join(means, "ip", "left")
    return joined.withColumn("score", F.coalesce("prior", overall.scalar())).drop("prior")


# ------------------------------------------------------------ supervised models

def _fit(estimator, train: DataFrame, label: str, scale: bool):
    stages = [VectorAssembler(inputCols=list(FEATURES), outputCol="_raw_vector")]
    if scale:
        stages.append(StandardScaler(inputCol="_raw_vector", outputCol="_vector", withMean=True))
    estimator.setFeaturesCol("_vector" if scale else "_raw_vector").setLabelCol("_label")
    data = numeric(train).withColumn("_label", F.when(F.col(label), 1.0).otherwise(0.0))
    return Pipeline(stages=[*stages, estimator]).fit(data.select("_label", *FEATURES))


@dataclass(frozen=True)
class Logistic:
    """Weights per raw feature and intercept."""

    weights: tuple[float, ...]
    intercept: float


def fit_logistic(train: DataFrame, label: str = "is_gold", max_iter: int = 50) -> Logistic:
    """Logistic regression on standardised features, folded back to raw ones.

    Scoring is then a plain expression in generated code, and the training summary,
    which holds the session and cannot be sent to tasks, stays on the driver.
    """
    model = _fit(LogisticRegression(maxIter=max_iter, regParam=1e-4), train, label, scale=True)
    scaler, regression = model.stages[1], model.stages[2]
    mean, std = np.array(scaler.mean), np.array(scaler.std)
    weights = np.divide(np.array(regression.coefficients), std, out=np.zeros_like(std), where=std > 0)
    return Logistic(tuple(float(w) for w in weights), float(regression.intercept - weights @ mean))


def fit_boosting(train: DataFrame, label: str = "is_gold", trees: int = 10, depth: int = 4):
    """Gradient-boosted trees on binned features."""
    return _fit(GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=64, seed=7), train, label, scale=False)


#: Features that are true or false.
FLAGS = tuple(f for f in FEATURES if f not in ("hour", "rapid_login_rate", "login_frequency_today"))


def fit_log_odds(train: DataFrame, label: str = "is_gold") -> Logistic:
    """Weights from counts: log odds of each flag among positives against negatives (naive Bayes, one added to each count).

    One aggregate and no iterations, so it can be refitted as often as a live path likes; counted features weigh nothing.
    """
    positive = F.coalesce(F.col(label), F.lit(False))
    sums = train.agg(
        F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"),
        *[F.count_if(F.col(f) & positive).alias(f"p_{f}") for f in FLAGS], *[F.count_if(F.col(f) & ~positive).alias(f"q_{f}") for f in FLAGS],
    ).first()
    p, q, weights, intercept = sums["p"], sums["q"], [], float(np.log((sums["p"] + 1) / (sums["q"] + 1)))
    for f in FEATURES:
        if f not in FLAGS:
            weights.append(0.0)
            continue
        yes = np.log((sums[f"p_{f}"] + 1) / (p + 2)) - np.log((sums[f"q_{f}"] + 1) / (q + 2))
        no = np.log((p - sums[f"p_{f}"] + 1) / (p + 2)) - np.log((q - sums[f"q_{f}"] + 1) / (q + 2))
        weights.append(float(yes - no))
        intercept += float(no)
    return Logistic(tuple(weights), intercept)


def probability(model: Logistic) -> Column:
    """The model as an expression over feature columns."""
    terms = [F.col(f).cast("double") * w for f, w in zip(FEATURES, model.weights)]
    odds = reduce(lambda a, b: a + b, terms, F.lit(model.intercept))
    return F.round(1 / (1 + F.exp(-odds)), _DIGITS)


def with_model_score(model, features: DataFrame, name: str = "model_score") -> DataFrame:
    """Adds the probability of the positive class and keeps the features as they are."""
    if isinstance(model, Logistic):
        return features.withColumn(name, probability(model))
    plain = features.withColumns({f"_kept_{n}": F.col(n) for n in FEATURES})
    scored = score_supervised(model, plain).withColumnsRenamed({f"_kept_{n}": n for n in FEATURES})
    return scored.select(*features.columns, F.col("score").alias(name))


def score_supervised(model, test: DataFrame) -> DataFrame:
    """Adds ``score``: probability of the positive class."""
    keep = [c for c in test.columns if c not in FEATURES]
    if isinstance(model, Logistic):
        return test.select(*keep, probability(model).alias("score"))
    predicted = model.transform(numeric(test))
    return predicted.select(*keep, F.round(vector_to_array("probability")[1], _DIGITS).alias("score"))


# --------------------------------------------------------------- isolation forest

@dataclass(frozen=True)
class Forest:
    """Flat trees: per tree arrays of feature, cut, left child and path length at a leaf."""

    trees: tuple
    sample_size: int


def _average_path(n):
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    big = np.where(n > 2, n, 3.0)
    value = 2 * (np.log(big - 1) + 0.5772156649) - 2 * (big - 1) / big
    return np.where(n > 2, value, np.where(n == 2, 1.0, 0.0))


def _grow(points: np.ndarray, seed: int) -> list[tuple]:
    """Nodes of one tree as (node, feature, cut, left, path); the right child is left + 1."""
    rng = np.random.default_rng(seed)
    limit = int(np.ceil(np.log2(max(len(points), 2))))
    nodes, todo, used = [], [(0, points, 0)], 1
    while todo:
        node, rows, depth = todo.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(usable) == 0:
            nodes.append((node, -1, 0.0, -1, float(depth + _average_path(len(rows)))))
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(low[f], high[f]))
        goes_left = rows[:, f] <= cut
        nodes.append((node, f, cut, used, 0.0))
        todo += [(used, rows[goes_left], depth + 1), (used + 1, rows[~goes_left], depth + 1)]
        used += 2
    return nodes


def fit_isolation_forest(train: DataFrame, trees: int = 64, sample_size: int = 256, seed: str = "forest") -> Forest:
    """Each tree grows in one task on its own hash sample of ``sample_size`` rows.

    The sample is part of the method. Rows are thinned by hash before they are dealt
    to trees, so a tree's group holds a few sample sizes of rows, whatever the table.
    """
    total = train.count()
    per_row = max(1, min(trees, -(-trees * sample_size * 2 // max(total, 1))))
    keep = min(1.0, trees * sample_size * 4 / max(total * per_row, 1))
    h = seeded_hash(seed, F.col("row_id"))
    dealt = numeric(train).where(h < int(keep * 2**32)).select(
        *FEATURES, h.alias("_h"), "row_id", F.explode(F.sequence(F.lit(0), F.lit(per_row - 1))).alias("_i")
    )
    tree = F.pmod(F.xxhash64("row_id") + F.col("_i"), F.lit(trees)).cast("int")
    ranked = dealt.withColumn("tree", tree).withColumn(
        "_rank", F.row_number().over(W.partitionBy("tree").orderBy("_h", "row_id"))
    ).where(F.col("_rank") <= sample_size)

    def grow(key, pdf):
        ordered = pdf.sort_values(["_h", "row_id"])
        nodes = _grow(ordered[list(FEATURES)].to_numpy(dtype=float), int(key[0]))
        out = pd.DataFrame(nodes, columns=["node", "feature", "cut", "left", "path"])
        out.insert(0, "tree", int(key[0]))
        return out

    schema = "tree int, node int, feature int, cut double, left int, path double"
    # at most trees * 2 * sample_size nodes come to the driver
    flat = ranked.groupBy("tree").applyInPandas(grow, schema).toPandas()
    packed = []
    for _, t in flat.sort_values(["tree", "node"]).groupby("tree"):
        packed.append((t.feature.to_numpy(), t.cut.to_numpy(), t.left.to_numpy(), t.path.to_numpy()))
    return Forest(tuple(packed), min(sample_size, max(total, 2)))


def score_isolation_forest(forest: Forest, test: DataFrame) -> DataFrame:
    """Adds ``score`` in 0..1; near 1 is isolated quickly."""
    norm = float(_average_path(forest.sample_size))
    trees = forest.trees

    @F.pandas_udf("double")
    def anomaly(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        depth = np.zeros(len(x))
        for feature, cut, left, path in trees:
            at = np.zeros(len(x), dtype=int)
            inner = feature[at] >= 0
            while inner.any():
                rows = np.flatnonzero(inner)
                node = at[rows]
                right = x[rows, feature[node]] > cut[node]
                at[rows] = left[node] + right
                inner[rows] = feature[at[rows]] >= 0
            depth += path[at]
        return pd.Series(2.0 ** (-depth / (len(trees) * norm)))

    keep = [c for c in test.columns if c not in FEATURES]
    score = anomaly(*[F.col(n).cast("double") for n in FEATURES])
    return test.select(*keep, F.round(score, _DIGITS).alias("score"))


# ------------------------------------------------------------ local outlier factor

def _distinct(features: DataFrame, probes: DataFrame | None = None) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Distinct feature vectors with multiplicity, written, and mean and variance of each feature.

    ``probes`` are among them with multiplicity 0; rows of ``features`` alone give the two moments.
    """
    base = numeric(features).select(*FEATURES, F.lit(1.0).alias("w"))
    if probes is not None:
        base = base.unionByName(numeric(probes).select(*FEATURES, F.lit(0.0).alias("w")))
    base = written(base.groupBy(*FEATURES).agg(F.sum("w").alias("w")), "vectors")
    mass = base.agg(F.sum("w").alias("n"), *[
        e for f in FEATURES for e in (
            F.sum(F.col(f) * F.col("w")).alias(f"s_{f}"), F.sum(F.col(f) * F.col(f) * F.col("w")).alias(f"q_{f}")
        )
    ]).first()
    n = mass["n"] or 1.0
    means = {f: (mass[f"s_{f}"] or 0.0) / n for f in FEATURES}
    return base, {f: (m, max((mass[f"q_{f}"] or 0.0) / n - m * m, 0.0)) for f, m in means.items()}


def _standardised(features: DataFrame, probes: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Distinct feature vectors with multiplicity and z-scored coordinates.

    ``probes`` are placed on the same scale with multiplicity 0.
    """
    base, moments = _distinct(features, probes)
    varied = {f: (m, v**0.5) for f, (m, v) in moments.items() if v > 0}
    cols = [((F.col(f) - mean) / sd).alias(f"z_{f}") for f, (mean, sd) in varied.items()]
    ids = F.xxhash64(*FEATURES).alias("vid")
    return base.select(ids, "w", *FEATURES, *cols), [f"z_{f}" for f in varied]


def _exact_lists(features: DataFrame, probes: DataFrame | None, k: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Vectors (vid, w, asked) and their exact neighbour lists (vid, nid, d, nw, probing), all ties included.

    Squared differences are divided by the variance, kept to seven digits so that equal distances stay equal. A
    vector's copies are neighbours at distance 0: of a reference row all but itself, of a probe (``probing``) all.
    Vectors with a missing feature take no part.
    """
    c = F.col
    base, moments = _distinct(features, probes)
    varied = [f for f, (_, v) in moments.items() if v > 0]
    scale = [float(f"{1 / moments[f][1]:.6e}") for f in varied]
    known = base.where(reduce(lambda a, b: a & b, [c(f).isNotNull() & ~F.isnan(f) for f in FEATURES]))
    x = F.array(*[c(f) for f in varied]) if varied else F.array(F.lit(0.0))
    vectors = written(known.select(F.xxhash64(*FEATURES).alias("vid"), "w", F.lit(True).alias("asks"), x.alias("x")), "vectors")
    found = nearest(vectors, scale or [0.0], k, block=block).withColumn("probing", F.lit(False))
    copies = lambda n, probing: vectors.where(n > 0).select(
        "vid", c("vid").alias("nid"), F.lit(0.0).alias("d"), n.alias("nw"), F.lit(probing).alias("probing"))
    found = written(found, "found")
    lists = nearest_lists(found.join(vectors.where("w > 0").select("vid"), "vid", "left_semi").unionByName(copies(c("w") - 1, False)), k)
    if probes is not None:
        asked = numeric(probes).select(F.xxhash64(*FEATURES).alias("vid")).distinct()
        looked = found.withColumn("probing", F.lit(True)).unionByName(copies(c("w"), True)).join(asked, "vid", "left_semi")
        lists = lists.unionByName(nearest_lists(looked, k))
    return vectors, written(lists, "lists")


def _blocks(vectors: DataFrame, directions: list[Column], size: int) -> DataFrame:
    """Rows with (_dir, _block): half-overlapping runs of ``size`` reference rows along each direction.

    Ranks come from a histogram of grid cells plus the rank inside a cell, so the
    blocks are the same on every run and no task sorts the table. Probes (multiplicity 0) have no
    rank of their own: they go where a reference row at their place would, so they never push reference rows away.
    """
    c = F.col
    half = size // 2
    fitted = vectors.where("w > 0").count()
    along = F.array(*[F.struct(F.lit(i).alias("i"), d.alias("p")) for i, d in enumerate(directions)])
    placed = vectors.select("*", F.explode(along).alias("_a")).select(
        *vectors.columns, c("_a.i").alias("_dir"), c("_a.p").alias("_p"), F.floor(c("_a.p") * 1024).alias("_cell")
    )
    # one row per occupied cell of a fixed grid
    cells = placed.groupBy("_dir", "_cell").agg(F.count_if(c("w") > 0).alias("n"))
    below = W.partitionBy("_dir").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    starts = cells.select("_dir", "_cell", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("_start"))
    before = W.partitionBy("_dir", "_cell").orderBy("_p", "vid").rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.count_if(c("w") > 0).over(before), F.lit(0))
    ranked = placed.withColumn("_inside", inside).join(starts, ["_dir", "_cell"])
    ranked = ranked.withColumn("_run", F.floor(F.least(c("_start") + c("_inside"), F.lit(max(fitted - 1, 0))) / half))
    both = F.array_compact(F.array(c("_run"), F.when(c("_run") > 0, c("_run") - 1)))
    return ranked.select(*vectors.columns, "_dir", F.explode(both).alias("_block"))


def _neighbours(vectors: DataFrame, zs: list[str], k: int, projections: int, block: int, probed: bool = False) -> DataFrame:
    """(vid, nid, d, nw): near neighbours found inside blocks of projection-sorted vectors.

    For each random direction the vectors are cut into blocks of a fixed number of
    rows along their projection. A block yields the k nearest of each member, so nothing
    grows with a dense region: it is cut into more blocks. Vectors are distinct, so
    copies cannot crowd out other neighbours.

    ``probed``: some vectors are probes. Those of a block are dealt into parts of about ``block`` rows, each
    with all reference rows of the block, so a probe meets at least ``min(k, half a block, all)`` of them.
    """
    rng = np.random.default_rng(11)

    def nearest(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values("vid")
        fits = chunk.w.to_numpy() > 0
        asks = ~fits | (chunk["_part"].to_numpy() == 0)  # reference rows ask once
        x, vid = chunk[zs].to_numpy(dtype=float), chunk.vid.to_numpy()
        y, nid, nw = x[fits], vid[fits], chunk.w.to_numpy()[fits]
        x, vid = x[asks], vid[asks]
        d = np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T, 0.0))
        d[vid[:, None] == nid[None, :]] = np.inf
        m = min(k, len(nid))
        idx = np.argsort(d, axis=1, kind="stable")[:, :m]
        rows = np.repeat(np.arange(len(vid)), m)
        cols = idx.ravel()
        found = np.isfinite(d[rows, cols])
        rows, cols = rows[found], cols[found]
        return pd.DataFrame({"vid": vid[rows], "nid": nid[cols], "d": d[rows, cols], "nw": nw[cols]})

    directions = [
        reduce(lambda a, b: a + b, [F.col(z) * float(c) for z, c in zip(zs, rng.normal(size=len(zs)))])
        for _ in range(projections)
    ]
    placed = _blocks(vectors.select("vid", "w", *zs), directions, block)
    if probed:
        placed = written(placed, "blocks")
        parts = placed.where("w = 0").groupBy("_dir", "_block").agg(F.ceil(F.count(F.lit(1)) / block).alias("_parts"))
        placed = placed.join(parts, ["_dir", "_block"], "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
        every = F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)
        own = F.array(F.pmod(F.xxhash64("vid"), F.col("_parts")))
        placed = placed.withColumn("_part", F.explode(F.when(F.col("w") > 0, every).otherwise(own))).drop("_parts")
    else:
        placed = placed.withColumn("_part", F.lit(0).cast("bigint"))
    found = placed.groupBy("_dir", "_block", "_part").applyInPandas(nearest, "vid bigint, nid bigint, d double, nw double")
    # a pair may be found in several blocks; at most 2 * projections * k rows per vector
    return found.groupBy("vid", "nid").agg(F.min("d").alias("d"), F.first("nw").alias("nw"))


def _nearest_lists(found: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """The nearest rows of each vector up to ``k``, copies counted by their number."""
    near = W.partitionBy("vid").orderBy("d", "nid").rowsBetween(W.unboundedPreceding, -1)
    lists = found.unionByName(own).withColumn("_before", F.coalesce(F.sum("nw").over(near), F.lit(0.0)))
    return lists.where(F.col("_before") < k).drop("_before")


def _densities(lists: DataFrame, reach_of: DataFrame) -> DataFrame:
    """Local reachability density per vector."""
    joined = lists.join(reach_of.select(F.col("vid").alias("nid"), F.col("kd").alias("nkd")), "nid")
    weighted = F.sum(F.col("nw") * F.greatest("d", "nkd"))
    return joined.groupBy("vid").agg((F.sum("nw") / (weighted + 1e-10)).alias("lrd"))


def _factors(fitted: DataFrame, asked: DataFrame) -> DataFrame:
    """(vid, lof) of the lists ``asked``, with reach and densities from the lists of reference rows, ``fitted``."""
    c = F.col
    reach_of = fitted.groupBy("vid").agg(F.max("d").alias("kd"))
    other = _densities(fitted, reach_of).select(c("vid").alias("nid"), c("lrd").alias("nlrd"))
    around = asked.join(other, "nid").groupBy("vid").agg((F.sum(c("nw") * c("nlrd")) / F.sum("nw")).alias("around"))
    return around.join(_densities(asked, reach_of), "vid").select("vid", (c("around") / c("lrd")).alias("lof"))


def _with_factor(features: DataFrame, factor: DataFrame) -> DataFrame:
    keep = [n for n in features.columns if n not in FEATURES]
    rows = numeric(features).withColumn("vid", F.xxhash64(*FEATURES))
    return rows.join(factor, "vid", "left").select(*keep, F.round("lof", _DIGITS).alias("score"))


def novelty_outlier_factor(
    reference: DataFrame, features: DataFrame, k: int = 20, projections: int = 4, block: int = 512, exact: bool = True,
) -> DataFrame:
    """``features`` with ``score``: local outlier factor against the rows of ``reference`` only.

    Fitted on one table, usually undisturbed training rows, and applied to another: scale, neighbours and
    densities come from the reference. Without reference rows no row has a score. Neighbours are exact, with all
    rows as far as the k-th; ``exact=False`` takes near ones from ``projections`` random directions, in bounded time.
    """
    c = F.col
    if exact:
        _, lists = _exact_lists(reference, features, k, block)
        return _with_factor(features, _factors(lists.where("not probing"), lists.where("probing")))
    vectors, zs = _standardised(reference, features)
    found = written(_neighbours(vectors, zs, k, projections, block, probed=True), "neighbours")
    asked = numeric(features).select(F.xxhash64(*FEATURES).alias("vid")).distinct()
    copies = lambda n: vectors.where(n > 0).select("vid", c("vid").alias("nid"), F.lit(0.0).alias("d"), n.alias("nw"))
    fitted = found.join(vectors.where("w > 0").select("vid"), "vid", "left_semi")
    fitted = written(_nearest_lists(fitted, copies(c("w") - 1), k), "lists")
    probed = found.join(asked, "vid", "left_semi").unionByName(copies(c("w")).join(asked, "vid", "left_semi"))
    probed = written(_nearest_lists(probed, copies(F.lit(0.0)), k), "lists")
    return _with_factor(features, _factors(fitted, probed))


def local_outlier_factor(features: DataFrame, k: int = 20, projections: int = 4, block: int = 512, exact: bool = True) -> DataFrame:
    """Rows with ``score``: local outlier factor among all rows.

    Neighbour search runs on distinct vectors; a vector's copies count as neighbours at distance 0. Rows get the
    factor of their vector, NULL where it has no neighbours or a feature is missing. ``exact`` as in
    :func:`novelty_outlier_factor`.
    """
    c = F.col
    if exact:
        _, lists = _exact_lists(features, None, k, block)
        return _with_factor(features, _factors(lists, lists))
    vectors, zs = _standardised(features)
    found = _neighbours(vectors, zs, k, projections, block)
    own = vectors.where("w > 1").select("vid", c("vid").alias("nid"), F.lit(0.0).alias("d"), (c("w") - 1).alias("nw"))
    lists = written(_nearest_lists(found, own, k), "lists")
    return _with_factor(features, _factors(lists, lists))


# ---------------------------------------------------------------- elliptic envelope

@dataclass(frozen=True)
class Envelope:
    """Mean and inverse covariance, or why there is none."""

    names: tuple[str, ...]
    mean: tuple[float, ...]
    precision: tuple[tuple[float, ...], ...]
    worst_skew: float
    skipped: bool


def _moments(rows: DataFrame, names: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, skews and sample covariances of ``names``, doubles, each over the rows that have a value.

    A task adds up its rows around the means and gives one row of sums. As one aggregate the pairs make too much code to compile.
    """
    size = len(names)
    means = rows.agg(*[F.avg(n).alias(n) for n in names]).first()
    mean = np.array([np.nan if m is None else m for m in means], dtype=float)

    def add(frames):
        total = np.zeros((3 * size + 1, size))
        for frame in frames:
            x = frame.to_numpy(dtype=float) - mean
            there = ~np.isnan(x)
            x, there = np.where(there, x, 0.0), there.astype(float)
            total += np.r_[x.T @ x, x.T @ there, there.T @ there, [(x**3).sum(axis=0)]]
        yield pd.DataFrame({"sums": [total.ravel()]})

    made = rows.select(*names).mapInPandas(add, "sums array<double>").toPandas()["sums"]
    total = np.sum([np.reshape(t, (3 * size + 1, size)) for t in made] or [np.zeros((3 * size + 1, size))], axis=0)
    square, own, n, cube = total[:size], total[size : 2 * size], total[2 * size : 3 * size], total[-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = (square - own * own.T / n) / (n - 1)
        n, shift, second = n.diagonal(), own.diagonal() / n.diagonal(), square.diagonal()
        skew = np.sqrt(n) * (cube - 3 * shift * second + 2 * n * shift**3) / (second - n * shift**2) ** 1.5
    return mean, skew, cov


def fit_envelope(train: DataFrame, max_skew: float = 2.0, names: tuple[str, ...] = FEATURES) -> Envelope:
    """Gaussian envelope; skipped when a feature is more skewed than ``max_skew``.

    One pass gives the means, a second one skews and all covariances.
    """
    mean, skew, cov = _moments(numeric(train, names), names)
    usable = [i for i, v in enumerate(cov.diagonal()) if np.isfinite(v) and v > 0]
    finite = tuple(names[i] for i in usable)
    worst = max([abs(float(skew[i])) for i in usable] or [0.0])
    if worst > max_skew or not finite:
        return Envelope(finite, (), (), worst, True)
    inverse = np.linalg.pinv(cov[np.ix_(usable, usable)])
    return Envelope(finite, tuple(float(mean[i]) for i in usable),
                    tuple(tuple(float(v) for v in r) for r in inverse), worst, False)


def score_envelope(env: Envelope, test: DataFrame) -> DataFrame:
    """Adds ``score``: squared Mahalanobis distance, NULL when the fit was skipped."""
    keep = [c for c in test.columns if c not in FEATURES]
    score: Column = F.lit(None).cast("double")
    if not env.skipped:
        centred = [F.col(n).cast("double") - m for n, m in zip(env.names, env.mean)]
        terms = [centred[i] * centred[j] * env.precision[i][j] for i in range(len(centred)) for j in range(len(centred))]
        score = F.round(reduce(lambda a, b: a + b, terms), _DIGITS)
    return test.select(*keep, score.alias("score"))


# --------------------------------------------------------------------- combination

def stack_scores(**models: DataFrame) -> DataFrame:
    """Long form: (model, row_id, labels..., score) of several scored tables."""
    parts = [df.withColumn("model", F.lit(name)) for name, df in models.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def averaged_score(stacked: DataFrame, *carry: str) -> DataFrame:
    """Mean over models of min-max scaled scores, one row per ``row_id``; missing scores do not count.

    The ranges are one row per model (a fixed handful) and are broadcast.
    """
    c = F.col
    ranges = stacked.groupBy("model").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    scaled = stacked.join(F.broadcast(ranges), "model").withColumn(
        "scaled", F.when(c("score").isNotNull(), F.coalesce(F.try_divide(c("score") - c("lo"), c("hi") - c("lo")), F.lit(0.0)))
    )
    return scaled.groupBy("row_id").agg(
        *[F.first(n).alias(n) for n in carry], F.round(F.avg("scaled"), _DIGITS).alias("score")
    )
