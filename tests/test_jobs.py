"""Sampling, evaluation, audits and models against brute force on small fixtures."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewise.functions.risk import FEATURES
from gatewise.operators import audit, contract, evaluate, models, sampling
from gatewise.operators.features import FeatureParams


@pytest.mark.parametrize("quota", [1, 7, 99, 5000])
def test_take_smallest_is_exact(spark, quota):
    df = spark.range(3000).select(
        F.col("id").alias("row_id"), (F.col("id") % 2).alias("k"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("o")
    )
    got = sampling.take_smallest(df, "k", F.lit(quota), F.col("o"), F.shiftright("o", 4)).collect()
    for key in (0, 1):
        rows = sorted((r.o, r.row_id) for r in df.where(F.col("k") == key).collect())[:quota]
        assert sorted((r.o, r.row_id) for r in got if r.k == key) == rows


def test_takeover_rows_and_rows_without_user_stay(events):
    """Above the cap takeover rows stay; rows without a user id are a user of their own."""
    logins = [(i, 1 if i < 300 else None, f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", {"is_ato": i % 300 < 40}) for i in range(330)]
    everyone = tuple((tier, 100) for tier in ("robot", "ato", "heavy", "light", "normal"))
    for slot_rows in (50, 1_000_000):  # user 1 heavy, and not
        spec = sampling.SampleSpec(user_cap=20, robot_cap=25, keep_percent=everyone, params=FeatureParams(slot_rows=slot_rows))
        got = sampling.sample_events(events(logins), spec)
        assert got.where("user_id = 1 and is_ato").count() == 40 and got.where("user_id = 1").count() == 40
        assert got.where("user_id is null").count() == 30
        assert contract.sample_violations(events(logins), got, spec).where("n <> 0").count() == 0
        assert "Coalesce 1" not in got._jdf.queryExecution().executedPlan().toString()


def test_sample_is_whole_reproducible_and_capped(events):
    rng = random.Random(1)
    df = events([(i, 0 if i % 2 else rng.randrange(1, 30), "2024-01-01 10:00:00",
                  dict(is_attack_ip=i % 5 == 0, is_ato=i in (3, 8))) for i in range(600)])
    spec = sampling.SampleSpec(user_cap=10, robot_cap=50, params=FeatureParams(slot_rows=100))
    a = {r.row_id for r in sampling.sample_events(df, spec).collect()}
    b = {r.row_id for r in sampling.sample_events(df.repartition(3, "ip").orderBy(F.desc("row_id")), spec).collect()}
    per_user = sampling.sample_events(df, spec).groupBy("user_id").count().collect()
    assert a == b and {3, 8} <= a
    assert all(r["count"] <= (50 if r.user_id == 0 else 10) for r in per_user)
    assert contract.sample_violations(df, sampling.sample_events(df, spec), spec).where("n <> 0").count() == 0


def test_rebuild_check_sees_a_changed_duplicate(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(2,), (2,), (2,)], "x int")
    assert contract.rebuild_differences(a, a.repartition(3)).first().n == 0
    assert contract.rebuild_differences(a, b).first().n == 1


@pytest.fixture
def scored(spark):
    rng = random.Random(3)
    rows = [(i, float(rng.randrange(8)), rng.random() < 0.3) for i in range(300)]
    return rows, spark.createDataFrame(rows, "row_id bigint, score double, hit boolean")


def test_auc_equals_pairs(scored):
    rows, df = scored
    pairs = [(p[1] > n[1]) + 0.5 * (p[1] == n[1]) for p in rows if p[2] for n in rows if not n[2]]
    auc = evaluate.roc_auc(evaluate.score_histogram(df, F.col("hit"))).first().auc
    assert auc == pytest.approx(sum(pairs) / len(pairs))


def test_replay_exact_takes_exactly_the_share(scored):
    rows, df = scored
    for rate in (0.01, 0.1, 0.37, 1.0):
        top = sorted(rows, key=lambda r: (-r[1], r[0]))[: int(np.ceil(len(rows) * rate))]
        got = evaluate.replay_exact(df, F.col("hit"), rate).first()
        assert (got.challenged, got.caught) == (len(top), sum(r[2] for r in top))


def test_curve_and_budget(scored):
    rows, df = scored
    curve = evaluate.threshold_curve(evaluate.score_histogram(df, F.col("hit")))
    for r in curve.collect():
        assert r.tp == sum(x[2] and x[1] >= r.threshold for x in rows)
        assert r.fp == sum((not x[2]) and x[1] >= r.threshold for x in rows)
    best = evaluate.best_under_budget(curve, 0.5).first()
    assert best.f1 == max(r.f1 for r in curve.collect() if r.fpr <= 0.5)


def test_duplicates_and_dependency(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, None), (2, "b"), (3, None)], "k int, v string")
    d = audit.duplicate_rows(df).first()
    assert (d.duplicate_groups, d.surplus_rows) == (1, 2)
    f = audit.functional_dependency(df, "k", "v").first()
    assert (f.keys_total, f.keys_mixed, f.rows_mixed) == (3, 1, 2)


def feature_rows(spark, p=0.5, n=300, odd=3):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        strange = i < odd
        values = {f: bool(rng.random() < p) for f in FEATURES} if not strange else {f: False for f in FEATURES}
        values |= {"hour": int(rng.integers(8, 18)), "rapid_login_rate": int(rng.integers(0, 3)),
                   "login_frequency_today": int(rng.integers(0, 9))}
        if strange:
            values |= {"hour": 3, "rapid_login_rate": 60 + 300 * i, "login_frequency_today": 200 + 500 * i}
        rows.append((i, strange, *values.values()))
    kinds = ["int" if isinstance(v, int) and not isinstance(v, bool) else "boolean" for v in rows[0][2:]]
    names = [f"{f} {k}" for f, k in zip(values, kinds)]
    return spark.createDataFrame(rows, f"row_id bigint, is_gold boolean, {', '.join(names)}")


def exact_lof(x, w, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    lists = []
    for i in range(len(x)):
        near = sorted(((d[i, j], j) for j in range(len(x)) if j != i))
        near = ([(0.0, i)] if w[i] > 1 else []) + near
        taken, have = [], 0
        for dist, j in near:
            if have >= k:
                break
            weight = w[j] - 1 if j == i else w[j]
            taken.append((dist, j, weight))
            have += weight
        lists.append(taken)
    kd = np.array([max(t[0] for t in ls) for ls in lists])
    lrd = np.array([sum(t[2] for t in ls) / (sum(t[2] * max(t[0], kd[t[1]]) for t in ls) + 1e-10) for ls in lists])
    return np.array([sum(t[2] * lrd[t[1]] for t in ls) / sum(t[2] for t in ls) / lrd[i] for i, ls in enumerate(lists)])


def test_novelty_factor_equals_exact(spark, events):
    """Reference rows give scale, neighbours and densities; scored rows only look."""
    rng, k = np.random.default_rng(4), 7
    make = lambda n, first: spark.createDataFrame(
        [(first + i, *[float(v) for v in rng.integers(0, 4, len(FEATURES))]) for i in range(n)],
        "row_id bigint, " + ", ".join(f"{f} double" for f in FEATURES))
    reference, probes = make(60, 0), make(20, 1000)
    probes = probes.unionByName(reference.limit(1).withColumn("row_id", F.lit(2000).cast("bigint")))
    got = {r.row_id: r.score for r in models.novelty_outlier_factor(reference, probes, k=k, block=1000).collect()}
    data = lambda df: np.array([[r[f] for f in FEATURES] for r in df.orderBy("row_id").collect()])
    ref, test = data(reference), data(probes)
    mean, sd = ref.mean(0), ref.std(0)
    ref, test = (ref - mean) / sd, (test - mean) / sd
    dist = lambda a: np.sqrt(((a[:, None] - ref[None]) ** 2).sum(-1))
    own = dist(ref)
    np.fill_diagonal(own, np.inf)
    order = np.argsort(own, axis=1, kind="stable")[:, :k]
    reach = np.take_along_axis(own, order, 1)[:, -1]
    dense = lambda d, o: k / (np.maximum(np.take_along_axis(d, o, 1), reach[o]).sum(1) + 1e-10)
    lrd = dense(own, order)
    d = dist(test)
    o = np.argsort(d, axis=1, kind="stable")[:, :k]
    want = lrd[o].mean(1) / dense(d, o)
    # equal distances at the k-th place may be taken in another order
    clear = [i for i in range(len(test)) if np.sort(d[i])[k] - np.sort(d[i])[k - 1] > 1e-9]
    ids = sorted(got)
    assert len(got) == len(test) and len(clear) > 5
    assert [got[ids[i]] for i in clear] == pytest.approx([want[i] for i in clear], abs=0.05)


def test_lof_equals_exact_when_one_block_holds_all(spark):
    df = feature_rows(spark)
    got = {r.row_id: r.score for r in models.local_outlier_factor(df, k=10, block=1000).collect()}
    vectors, zs = models._standardised(df)
    v = vectors.collect()
    lof = exact_lof(np.array([[r[z] for z in zs] for r in v]), np.array([r.w for r in v]), 10)
    by_vector = {tuple(r[f] for f in FEATURES): s for r, s in zip(v, lof)}
    for r in df.collect():
        assert got[r.row_id] == pytest.approx(by_vector[tuple(float(r[f]) for f in FEATURES)], abs=2e-4)


def test_anomaly_models_rank_odd_rows_high(spark):
    df = feature_rows(spark, p=0.0)
    forest = models.fit_isolation_forest(df, trees=32, sample_size=64)
    env = models.fit_envelope(df, max_skew=100.0)
    assert models.fit_envelope(df, max_skew=2.0).skipped
    for out in (models.score_isolation_forest(forest, df), models.score_envelope(env, df),
                models.local_outlier_factor(df, k=10, block=128)):
        rows = out.collect()
        odd = [r.score for r in rows if r.row_id < 3]
        usual = sorted(r.score for r in rows if r.row_id >= 3)
        assert len(rows) == 300 and min(odd) > usual[len(usual) // 2] and max(odd) > usual[-5]


def test_supervised_and_average(spark):
    df = feature_rows(spark)
    logistic = models.score_supervised(models.fit_logistic(df), df)
    assert {r.row_id for r in logistic.orderBy(F.desc("score")).limit(3).collect()} == {0, 1, 2}
    stacked = models.stack_scores(a=logistic, b=logistic.withColumn("score", F.col("score") * 10))
    mean = models.averaged_score(stacked, "is_gold").agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert (mean.lo, mean.hi) == (0.0, 1.0)


def test_ip_prior_falls_back_to_the_mean(spark):
    train = spark.createDataFrame([("a", True), ("a", False), ("b", False), ("b", False)], "ip string, is_gold boolean")
    test = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "ip string")
    got = {r.ip: r.score for r in models.ip_prior(train, test).collect()}
    assert got == {"a": 0.5, "b": 0.0, "c": 0.25, None: 0.25}


def test_logistic_expression_equals_the_fitted_model(spark):
    from pyspark.ml.classification import LogisticRegression

    df = feature_rows(spark, odd=40)
    pipeline = models._fit(LogisticRegression(maxIter=50, regParam=1e-4), df, "is_gold", scale=True)
    want = pipeline.stages[2]
    row = pipeline.stages[1].transform(pipeline.stages[0].transform(models.numeric(df))).limit(20).collect()
    got = {r.row_id: r.score for r in models.score_supervised(models.fit_logistic(df), df).collect()}
    for r in row:
        assert got[r.row_id] == pytest.approx(want.predictProbability(r._vector)[1], abs=1e-4)


def test_every_log_record_is_a_login_or_a_reject(spark):
    from gatewise.sources import normalize

    lines = {
        "web": ['{"user": "u", "time": "x"}', '{"time": "2024-01-01T00:00:00Z"}', "{", "", None, "[1]", '{"user": null}'],
        "ssh": ["Jan  1 10:00:00 h sshd[1]: Accepted password for u from 1.1.1.1 port 1 ssh2", "Jan  1 10:00:00 h sshd[1]: Connection closed", "cron: x", " "],
        "active_directory": ['{"EventID": 4624}', '{"EventID": 4634}', '{"x": 1}', "4624"],
        "vpn": ["action=tunnel-up user=u", "action=tunnel-down", "user=u", "\t"],
        "cloud_console": ['{"eventName": "ConsoleLogin"}', '{"eventName": "GetObject"}', "{}", "no"],
        "sign_in": ['{"userPrincipalName": "u"}', '{"status": {"errorCode": 0}}', '{"userPrincipalName"'],
        "database": ["20240101 10:00:00,s,u,c,1,2,CONNECT,d,,0", "20240101 10:00:00,s,u,c,1,2,QUERY,d,,0", "a,b", ""],
    }
    readers = {
        "web": normalize.web_logins, "ssh": lambda v: normalize.ssh_logins(v, 2024), "active_directory": normalize.directory_logins,
        "vpn": normalize.vpn_logins, "cloud_console": normalize.cloud_console_logins, "sign_in": normalize.signin_logins, "database": normalize.database_logins,
    }
    for source, records in lines.items():
        table = spark.createDataFrame([(r,) for r in records], "value string")
        assert readers[source](table).count() == 1, source
        found = normalize.rejects(table, source).collect()
        assert len(found) == len(records) - 1 and all(r.reason for r in found), source
        counts = {r.reason: r.records for r in normalize.reject_counts(table, source).collect()}
        assert counts["login"] == 1 and sum(counts.values()) == len(records)
