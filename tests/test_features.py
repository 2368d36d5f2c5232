"""Sequences by hand, and the split timeline against a plain reading of the definitions."""

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gatewise.functions.risk import FEATURES, KINDS, RiskParams
from gatewise.operators.features import FeatureParams, behaviour_features, heavy_users
from gatewise.operators.scoring import score_events


def run(df, **kw):
    return {r.row_id: r for r in behaviour_features(df, FeatureParams(**kw)).collect()}


def test_first_event_changes_nothing(events):
    r = run(events([(1, 1, "2024-01-01 10:00:00")]))[1]
    assert not r.country_change and not r.device_change and not r.ip_seen_before and r.login_frequency_today == 0
    assert not r.unusual_hour and not r.has_history


def test_equal_times_do_not_see_each_other(events):
    got = run(events([(1, 1, "2024-01-01 10:00:00"), (2, 1, "2024-01-01 10:00:00")]))
    assert all(not r.has_history and not r.ip_seen_before and r.rapid_login_rate == 0 for r in got.values())


def test_failure_lookback_is_five_minutes(events):
    fail = dict(login_success=False)
    got = run(events([
        (1, 1, "2024-01-01 10:00:00", fail), (2, 1, "2024-01-01 10:05:00"), (3, 2, "2024-01-01 10:00:00", fail),
        (4, 2, "2024-01-01 10:05:00.000001"),
    ]))
    assert got[2].failed_recently and not got[4].failed_recently and not got[1].failed_recently


def test_return_to_a_known_country_is_no_change(events):
    got = run(events([
        (1, 1, "2024-01-01 10:00:00"), (2, 1, "2024-01-01 11:00:00", dict(country="RU")),
        (3, 1, "2024-01-01 12:00:00"),
    ]))
    assert [got[i].country_change for i in (1, 2, 3)] == [False, True, False]


def test_daily_count_restarts_at_midnight(events):
    got = run(events([
        (1, 1, "2024-01-01 23:58:00"), (2, 1, "2024-01-01 23:59:00"), (3, 1, "2024-01-02 00:00:00"),
        (4, 1, "2024-01-02 00:01:00"),
    ]))
    assert [got[i].login_frequency_today for i in (1, 2, 3, 4)] == [0, 1, 0, 1]


def brute_force(rows, p=RiskParams()):
    out = {}
    for r in rows:
        past = [q for q in rows if q.user_id == r.user_id and q.us < r.us]
        seen = {k: any(q[c] == r[c] for q in past) for k, c in KINDS.items()}
        hour = r.ts.hour
        same = sum(q.ts.hour == hour for q in past)
        out[r.row_id] = (
            hour, 0 <= hour <= 5, r.ts.weekday() >= 5, *[seen[k] for k in KINDS],
            *[bool(past) and not seen[k] for k in ("country", "device", "browser")],
            any(q.login_success is False and q.us >= r.us - p.lookback_us for q in past),
            sum(q.us >= r.us - p.burst_us for q in past), sum(q.ts.date() == r.ts.date() for q in past),
            bool(past) and same / len(past) < p.unusual_share,
        )
    return out


def random_logins(events, n=500, seed=5, users=4):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1, 20)
    rows = []
    for i in range(n):
        # user 0 holds most rows, in bursts, with ties and across midnights
        user = 0 if rng.random() < 0.6 else rng.randrange(1, users)
        at = start + dt.timedelta(seconds=rng.choice([rng.randrange(200_000), rng.randrange(300), 7200]))
        rows.append((i, user, at, dict(
            login_success=rng.choice([True, True, False, None]), ip=f"ip{rng.randrange(40)}",
            country=rng.choice(["NO", "SE", None]), asn=rng.choice([1, 2, 3, None]),
            device_type=rng.choice(["mobile", "desktop"]), os_family=rng.choice(["iOS", "Linux"]),
            browser_family=rng.choice(["A", "B", "", None]))))
    return events(rows)


@pytest.mark.parametrize("slot_rows", [10_000, 100, 3])
def test_against_definition(events, slot_rows):
    df = random_logins(events)
    rows = df.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).collect()
    want = brute_force(rows)
    heavy = heavy_users(df, FeatureParams(slot_rows=slot_rows))
    assert heavy.count() == {10_000: 0, 100: 1, 3: 4}[slot_rows]
    got = run(df, slot_rows=slot_rows)
    assert {i: tuple(r[f] for f in FEATURES) for i, r in got.items()} == want


def test_heavy_list_is_bounded(events):
    df = random_logins(events)
    assert heavy_users(df, FeatureParams(slot_rows=1, max_heavy_share=0.5)).count() <= 2


def test_order_and_later_events_do_not_matter(events):
    df = random_logins(events, 200)
    p = dict(slot_rows=20)
    whole = run(df, **p)
    assert run(df.repartition(7, "ip"), **p) == whole
    cut = dt.datetime(2024, 1, 2)
    for i, r in run(df.where(F.col("ts") < F.lit(cut)), **p).items():
        assert r == whole[i]


def test_rows_without_time_have_no_history(events, spark):
    df = random_logins(events, 60)
    extra = df.limit(20).withColumn("ts", F.lit(None).cast("timestamp_ntz")).withColumn("row_id", F.col("row_id") + 1000)
    got = run(df.unionByName(extra), slot_rows=5)
    base = run(df, slot_rows=5)
    assert len(got) == 80 and all(got[i] == base[i] for i in base)
    assert all(not r.has_history and not r.ip_seen_before for i, r in got.items() if i >= 1000)


def test_kept_counts(events):
    df = random_logins(events, 200)
    rows = behaviour_features(df, FeatureParams(slot_rows=30), keep_counts=True).collect()
    totals = {r.user_id: r["count"] for r in df.groupBy("user_id").count().collect()}
    assert all(r.user_rows == totals[r.user_id] for r in rows)
    first = {u: min(r.ts for r in rows if r.user_id == u) for u in totals}
    assert all((r.prior_events == 0) == (r.ts == first[r.user_id]) for r in rows)


def test_score_bounds(spark):
    df = spark.createDataFrame([(s,) for s in (0, 29, 30, 64, 65, 89, 90, 154)], "score int")
    from gatewise.functions import risk

    got = [r.level for r in df.select(risk.level(F.col("score"), RiskParams()).alias("level")).collect()]
    assert got == ["low", "low", "medium", "medium", "high", "high", "critical", "critical"]


def test_all_rules_sum_to_154(events):
    old = dict(login_success=False)
    new = dict(ip="9", country="RU", asn=9, device_type="mobile", os_family="iOS", browser_family="Z")
    df = events([*[(i, 1, "2024-01-02 03:00:00", old) for i in range(12)], (50, 1, "2024-01-02 03:00:30", new)])
    r = {x.row_id: x for x in score_events(behaviour_features(df)).collect()}[50]
    assert r.score == 154 and r.level == "critical" and r.decision == "block" and len(r.reasons) == 10


def test_window_tasks_follow_the_rows(spark, events):
    """More rows are more tasks, whatever size Spark would merge shuffle partitions to; the features stay the same."""
    start = dt.datetime(2024, 1, 1)
    df = events([(i, i % 40, start + dt.timedelta(minutes=i), dict(ip=str(i % 3))) for i in range(400)])
    made = behaviour_features(df, FeatureParams(task_rows=20)).withColumn("task", F.spark_partition_id())
    rows = made.collect()
    assert len({r.task for r in rows}) > spark.sparkContext.defaultParallelism
    want = run(df)
    assert len(rows) == len(want) and all(r[:-1] == tuple(want[r.row_id]) for r in rows)


def test_window_tasks_with_few_shuffle_partitions(spark, events):
    """Fewer shuffle partitions than cores make no task larger; a table of one task's rows is left to Spark."""
    start = dt.datetime(2024, 1, 1)
    df = events([(i, i % 40, start + dt.timedelta(minutes=i), dict(ip=str(i % 3))) for i in range(400)])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        most, tasks = {}, {}
        for limit in (150, 400):
            made = behaviour_features(df, FeatureParams(task_rows=limit)).withColumn("task", F.spark_partition_id())
            rows = made.collect()
            sizes = collections.Counter(r.task for r in rows)
            most[limit], tasks[limit] = max(sizes.values()), len(sizes)
            assert len(rows) == 400
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert tasks[150] > 1 and most[150] < 300 and tasks[400] == 1
