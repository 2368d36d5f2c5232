"""Running totals and curves over scores that are nearly all different."""

import random

from pyspark.sql import functions as F

from gatewise.operators import evaluate
from gatewise.operators.ordered import running_totals


def _events(spark, n=3000):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.random(), 0.5, -1.0]), rng.random() < 0.2) for _ in range(n)]
    return spark.createDataFrame(rows, "model string, score double, hit boolean")


def test_ranges_give_what_one_window_gives(spark):
    events = _events(spark)
    for by in ((), ("model",)):
        hist = evaluate.score_histogram(events, F.col("hit"), "score", *by)
        for f in (evaluate.threshold_curve, evaluate.roc_auc):
            one, many = f(hist, *by).collect(), f(hist, *by, spread=True).collect()
            assert sorted(one, key=repr) == sorted(many, key=repr)
        one, many = evaluate.replay(hist, (0.05, 0.3), *by).collect(), evaluate.replay(hist, (0.05, 0.3), *by, spread=True).collect()
        assert sorted(one, key=repr) == sorted(many, key=repr)


def test_no_window_sees_all_scores(spark):
    hist = evaluate.score_histogram(_events(spark), F.col("hit"))
    plan = evaluate.threshold_curve(hist, spread=True)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line or "Window(" in line]
    over_scores = [line for line in windows if "score" in line]
    assert over_scores and all("_range" in line for line in over_scores)


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "score double, pos long, neg long")
    assert evaluate.threshold_curve(none, spread=True).count() == 0
    one = spark.createDataFrame([(1.0, 2, 3)], "score double, pos long, neg long")
    assert running_totals(one, (), [F.asc("score")], {"x": "pos"}, own=False).first().x == 0
    assert evaluate.roc_auc(one, spread=True).first().auc == 0.5
