"""Evaluation of scores against labels from one histogram per score.

Everything except the confusion matrix works on (score -> positives, negatives).
Rule scores have at most 155 values; model scores are rounded to four digits
first, so the histogram stays below about 10,001 rows per model and the ordered
windows over it never see the events. For scores that are not rounded the histogram grows with the
events; ``spread`` then takes running totals over ranges of scores, so no task sees all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gatewise.operators.ordered import running_totals
from gatewise.session import cut_lineage


def confusion(events: DataFrame, flagged: Column, label: Column) -> DataFrame:
    """Counts and precision, recall, F1 and false-positive rate, one row."""
    counts = events.agg(
        F.count_if(flagged & label).alias("tp"),
        F.count_if(flagged & ~label).alias("fp"),
        F.count_if(~flagged & label).alias("fn"),
        F.count_if(~flagged & ~label).alias("tn"),
    )
    return _rates(counts)


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def _rates(counts: DataFrame) -> DataFrame:
    c = F.col
    return counts.select(
        "*",
        _ratio(c("tp"), c("tp") + c("fp")).alias("precision"),
        _ratio(c("tp"), c("tp") + c("fn")).alias("recall"),
        _ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"),
        _ratio(c("fp"), c("fp") + c("tn")).alias("fpr"),
    )


def score_histogram(events: DataFrame, label: Column, score: str = "score", *by: str) -> DataFrame:
    """(by..., score, pos, neg); combined on the map side."""
    return events.groupBy(*by, F.col(score).alias("score")).agg(
        F.count_if(label).alias("pos"), F.count_if(~label).alias("neg")
    )


def _everything(by):
    return W.partitionBy(*by) if by else W.partitionBy(F.lit(0))


def _spread_curve(hist: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Counts at every score and in all, with no window over all scores."""
    c = F.col
    run = running_totals(hist, by, [F.desc("score")], {"tp": "pos", "fp": "neg"})
    totals = (F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    if by:  # a row per model
        every = hist.groupBy(*by).agg(*totals)
        every = every.withColumnsRenamed({b: f"_by_{b}" for b in by})
        same = F.lit(True)
        for b in by:
            same &= c(b).eqNullSafe(c(f"_by_{b}"))
        run = run.join(F.broadcast(every), same)
    else:
        run = run.withColumns({n: hist.agg(t).scalar() for n, t in zip(("_pos", "_neg"), totals)})
    return run.select(*by, c("score").alias("threshold"), "tp", "fp", "_pos", "_neg")


def threshold_curve(hist: DataFrame, *by: str, spread: bool = False) -> DataFrame:
    """One row per distinct score, flagging everything at or above it."""
    c = F.col
    if spread:
        counts = _spread_curve(hist, by)
        full = counts.withColumn("fn", c("_pos") - c("tp")).withColumn("tn", c("_neg") - c("fp"))
        return _rates(full.drop("_pos", "_neg"))
    down = _everything(by).orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    every = _everything(by)
    counts = hist.select(
        *by, c("score").alias("threshold"),
        F.sum("pos").over(down).alias("tp"),
        F.sum("neg").over(down).alias("fp"),
        F.sum("pos").over(every).alias("_pos"),
        F.sum("neg").over(every).alias("_neg"),
    )
    full = counts.withColumn("fn", c("_pos") - c("tp")).withColumn("tn", c("_neg") - c("fp"))
    return _rates(full.drop("_pos", "_neg"))


def best_under_budget(curve: DataFrame, budget: float = 0.05, *by: str) -> DataFrame:
    """The threshold with the best F1 whose false-positive rate fits the budget.

    Equal F1 prefers the higher threshold. Tuned on the labels it is given.
    """
    c = F.col
    fits = curve.where(c("fpr") <= budget)
    best = F.max(F.struct(F.coalesce(c("f1"), F.lit(-1.0)).alias("f"), c("threshold").alias("t"), *[
        c(n) for n in ("threshold", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "fpr")
    ])).alias("best")
    names = ("threshold", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "fpr")
    picked = fits.groupBy(*by).agg(best) if by else fits.agg(best)
    return picked.select(*by, *[c(f"best.{n}").alias(n) for n in names])


def roc_auc(hist: DataFrame, *by: str, spread: bool = False) -> DataFrame:
    """Share of (positive, negative) pairs ranked right, ties half (Mann-Whitney)."""
    c = F.col
    if spread:
        ranked = running_totals(hist, by, [F.asc("score")], {"lower": "neg"}, own=False)
    else:
        below = _everything(by).orderBy("score").rowsBetween(W.unboundedPreceding, -1)
        ranked = hist.withColumn("lower", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    rows = ranked.select(*by, *[c(n).cast("double").alias(n) for n in ("pos", "neg", "lower")])
    sums = [
        F.sum(c("pos") * (c("lower") + 0.5 * c("neg"))).alias("won"),
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
    ]
    agg = rows.groupBy(*by).agg(*sums) if by else rows.agg(*sums)
    return agg.select(*by, F.try_divide(c("won"), c("pos") * c("neg")).alias("auc"))


def replay(hist: DataFrame, rates: tuple[float, ...] = (0.01, 0.05, 0.1, 0.2), *by: str, spread: bool = False) -> DataFrame:
    """Re-check the top share of events by score: attacks caught, normal events bothered.

    ``rate`` is the wanted share. The cut is the highest score that reaches it and
    takes all ties, so ``challenged_share`` may exceed the rate.
    """
    c = F.col
    curve = threshold_curve(hist, *by, spread=spread).withColumn("n", c("tp") + c("fp"))
    total = c("tp") + c("fp") + c("fn") + c("tn")
    rated = curve.withColumn("rate", F.explode(F.array(*[F.lit(r) for r in rates])))
    reaching = rated.where(c("n") >= c("rate") * total)
    top = F.max(F.struct("threshold", "tp", "fp", "fn", "tn", "n")).alias("cut")
    total = c("cut.n") + c("cut.fn") + c("cut.tn")
    return reaching.groupBy(*by, "rate").agg(top).select(
        *by, "rate", c("cut.threshold").alias("threshold"), c("cut.n").alias("challenged"),
        _ratio(c("cut.n"), total).alias("challenged_share"),
        _ratio(c("cut.tp"), c("cut.tp") + c("cut.fn")).alias("caught_share"),
        _ratio(c("cut.fp"), c("cut.fp") + c("cut.tn")).alias("bothered_share"),
    )


def replay_exact(events: DataFrame, label: Column, rate: float, score: str = "score") -> DataFrame:
    """As ``replay`` for one rate, but exactly ``ceil(rate * rows)`` events; ties go by row id.

    Events above the cut score are taken whole. Only ties at the cut are ordered,
    through a histogram of row-id ranges, because one score may hold a large part
    of the table.
    """
    from gatewise.operators.sampling import take_smallest

    c = F.col
    # three narrow columns, written once: the steps below read them five times
    slim = cut_lineage(events.select("row_id", c(score).alias("score"), label.alias("label")))
    hist = score_histogram(slim, c("label"))
    cut = (
        threshold_curve(hist)
        .withColumn("n", c("tp") + c("fp"))
        .withColumn("want", F.ceil((c("n") + c("fn") + c("tn")) * rate))
        .where(c("n") >= c("want"))
        .join(hist, c("threshold") == c("score"))
        .agg(F.max_by(F.struct("threshold", "want", (c("n") - c("pos") - c("neg")).alias("above")), "threshold").alias("x"))
    )
    cut_score = cut.select("x.threshold").scalar()
    left = cut.select(c("x.want") - c("x.above")).scalar()
    bounds = slim.agg(F.min("row_id").alias("lo"), F.max("row_id").alias("hi"))
    low = bounds.select("lo").scalar()
    span = bounds.select(F.coalesce(F.greatest(F.ceil((c("hi") - c("lo") + 1) / 65536), F.lit(1)), F.lit(1)).cast("bigint")).scalar()
    ties = slim.where(c("score") == cut_score).withColumn("_k", F.lit(0))
    # rows without an id come last, in a bucket behind all others
    place = F.coalesce(F.floor((c("row_id") - low) / span), F.lit(1 << 20))
    taken = take_smallest(ties, "_k", left, c("row_id"), place).drop("_k")
    chosen = slim.where(c("score") > cut_score).union(taken)
    whole = slim.agg(F.count(F.lit(1)).alias("rows"), F.count_if("label").alias("pos"))
    got = chosen.agg(F.count(F.lit(1)).alias("challenged"), F.count_if("label").alias("caught"))
    return got.select(
        F.lit(rate).alias("rate"), "challenged", "caught",
        _ratio(c("caught"), whole.select("pos").scalar()).alias("caught_share"),
        _ratio(c("challenged") - c("caught"), whole.select(c("rows") - c("pos")).scalar()).alias("bothered_share"),
    )


def compare_models(scored: DataFrame, labels: dict[str, Column], score: str = "score",
                   budget: float = 0.05) -> DataFrame:
    """Long-form (model, score) rows to one line per model and label.

    ``scored`` holds a ``model`` column; the result has the best threshold under
    the budget, its rates and the ranking quality.
    """
    parts = []
    for name, label in labels.items():
        hist = score_histogram(scored, label, score, "model")
        best = best_under_budget(threshold_curve(hist, "model"), budget, "model")
        parts.append(best.join(roc_auc(hist, "model"), "model", "left").withColumn("label", F.lit(name)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def bounds_study(curve: DataFrame, bounds: tuple[float, ...], base: float) -> DataFrame:
    """Alternative alert bounds: rates at each and the change against ``base``.

    A bound between two scores behaves like the next higher score.
    """
    c = F.col
    tried = curve.withColumn("bound", F.explode(F.array(*[F.lit(float(b)) for b in bounds])))
    first = F.min_by(F.struct("tp", "fp", "recall", "fpr"), "threshold").alias("x")
    at = tried.where(c("threshold") >= c("bound")).groupBy("bound").agg(first)
    at = at.select("bound", c("x.tp").alias("tp"), c("x.fp").alias("fp"),
                   c("x.recall").alias("recall"), c("x.fpr").alias("fpr"))
    ref = at.where(c("bound") == base)
    return at.select(
        "*",
        (c("fp") - ref.select("fp").scalar()).alias("fp_delta"),
        (c("recall") - ref.select("recall").scalar()).alias("recall_delta"),
    )
