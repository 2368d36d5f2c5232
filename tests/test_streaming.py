"""Stream against batch, and the rules of learning."""

import pytest
from pyspark.sql import functions as F

from gatewise.functions.risk import FEATURES
from gatewise.operators.features import FeatureParams, behaviour_features
from gatewise.streaming import live
from tests.test_features import random_logins


def stored(df, folder, cuts):
    """One file per time slice, oldest first."""
    import time

    edges = [None, *cuts, None]
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        part = df.where(f"ts >= timestamp_ntz'{lo}'") if lo else df
        part = part.where(f"ts < timestamp_ntz'{hi}'") if hi else part
        part.coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # the file source orders files by modification time


def test_three_batches_equal_one_pass(spark, events, tmp_path):
    df = random_logins(events, 150).where("ts is not null")
    folder = str(tmp_path / "in")
    stored(df, folder, ["2024-01-01 20:03:00", "2024-01-02 02:00:00"])
    stream = live.replay_source(spark, folder, df.schema)
    got = live.run_to_table(live.live_scores(stream), str(tmp_path / "out")).collect()
    want = {r.row_id: r for r in behaviour_features(df, FeatureParams(slot_rows=20)).collect()}
    assert len(got) == len(want)
    for r in got:
        assert [r[f] for f in FEATURES] == [want[r.row_id][f] for f in FEATURES], r.row_id


def test_only_accepted_logins_and_confirmations_are_learned(spark, events, tmp_path):
    away = dict(country="RU", ip="9", asn=9)
    rows = events([
        (1, 1, "2024-01-01 10:00:00"), (2, 1, "2024-01-01 11:00:00", away), (3, 1, "2024-01-01 12:00:00", away),
        (5, 1, "2024-01-01 14:00:00", away),
    ])
    told = events([(4, 1, "2024-01-01 13:00:00", away)])
    for name, df in (("in", rows), ("told", told)):
        df.coalesce(1).write.parquet(str(tmp_path / name))
    policy = live.LiveParams(policy=live.LearnPolicy(everything=False))
    feedback = live.confirmations(live.replay_source(spark, str(tmp_path / "told"), rows.schema))
    scores = live.live_scores(live.replay_source(spark, str(tmp_path / "in"), rows.schema), policy, feedback)
    got = {r.row_id: r for r in live.run_to_table(scores, str(tmp_path / "out")).collect()}
    assert set(got) == {1, 2, 3, 5}
    # the strange country stays strange until the user confirms it
    assert [got[i].country_change for i in (1, 2, 3, 5)] == [False, True, True, False]
    assert [got[i].learned for i in (1, 2, 3)] == [True, False, False]
    assert got[2].decision == "challenge" and got[2].reasons


def test_late_rows_are_scored_but_teach_nothing(spark, events, tmp_path):
    folder = str(tmp_path / "in")
    first = events([(1, 1, "2024-01-01 10:00:00"), (2, 1, "2024-01-01 12:00:00")])
    late = events([(3, 1, "2024-01-01 11:00:00", dict(country="SE"))])
    after = events([(4, 1, "2024-01-01 13:00:00", dict(country="SE"))])
    import time
    for df in (first, late, after):
        df.coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    out = live.run_to_table(live.live_scores(live.replay_source(spark, folder, first.schema)), str(tmp_path / "out"))
    got = {r.row_id: r for r in out.collect()}
    assert len(got) == 4 and not got[3].learned and got[3].country_change and got[4].country_change


def test_untimed_logins_are_scored_and_teach_nothing(spark, events, tmp_path):
    df = events([(1, 1, "2024-01-01 12:00:00"), (2, 1, "2024-01-01 13:00:00", {"country": "SE"})])
    untimed = df.where("row_id = 2").withColumns({"row_id": F.lit(3).cast("bigint"), "ts": F.lit(None).cast("timestamp_ntz")})
    df.unionByName(untimed).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.replay_source(spark, str(tmp_path / "in"), df.schema)
    got = {r.row_id: r for r in live.run_to_table(live.live_scores(stream), str(tmp_path / "out")).collect()}
    assert set(got) == {1, 2, 3}
    assert got[3].score == 0 and not got[3].has_history and not got[3].learned
    assert got[2].country_change  # the untimed login from there taught nothing


def test_only_accepted_logins_are_learned_from(spark):
    from gatewise.plans import queries as registered

    table = registered.accepted_only_scores(spark, "/root/testdata/sf0.001")
    assert table.count() == 1000
    assert table.where("learned <> (decision = 'allow')").count() == 0
    # an agent string of a bot or a player changes nothing: history counts for all
    assert table.where("has_history").count() > 900


@pytest.mark.parametrize("slide", [None, "30 minutes"])
def test_window_totals(spark, events, tmp_path, slide):
    df = events([(i, 1, f"2024-01-01 10:{i:02d}:00") for i in range(0, 60, 5)]).selectExpr("*", "'allow' as decision")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.replay_source(spark, str(tmp_path / "in"), df.schema)
    totals = live.decision_totals(stream, "1 hour", slide)
    got = live.run_upserts(totals, str(tmp_path / "out"), "window_start", "window_end", "decision").collect()
    assert sum(r.events for r in got) == (24 if slide else 12)


def test_a_busy_user_is_cut_and_all_others_lie_whole(spark, events, tmp_path):
    base = random_logins(events, 300)
    df = base.withColumn("user_id", F.when(F.col("row_id") % 2 == 0, 0).otherwise(F.col("user_id") + 1).cast("bigint"))
    folder = str(tmp_path / "in")
    n = live.user_slices(df, folder, F.col("user_id"), live.micros(F.col("ts")), slice_rows=40)
    files = spark.read.schema(df.schema).parquet(folder).withColumn("f", F.input_file_name())
    per_user = {(r.user_id, r.f): r["count"] for r in files.groupBy("user_id", "f").count().collect()}
    assert n >= 4 and max(per_user.values()) <= 80
    busy = {u for u, _ in per_user if sum(v for (w, _), v in per_user.items() if w == u) > 40}
    assert 0 in busy and all(sum(u == w for w, _ in per_user) == 1 for u, _ in per_user if u not in busy)
    scores = live.live_scores(live.replay_source(spark, folder, df.schema))
    got = live.run_to_table(scores, str(tmp_path / "out")).collect()
    want = {r.row_id: r for r in behaviour_features(df, FeatureParams(slot_rows=20)).collect()}
    assert sorted(r.row_id for r in got) == sorted(want)
    for r in got:
        assert [r[f] for f in FEATURES] == [want[r.row_id][f] for f in FEATURES], r.row_id
