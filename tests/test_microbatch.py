"""Slots and the keyed store by themselves, and micro-batches with late, untimed, repeated and expiring rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gatewise.functions.risk import FEATURES
from gatewise.operators import models, scoring
from gatewise.operators.features import behaviour_features
from gatewise.operators.slots import even_cuts, running_before, slotted
from gatewise.plans import queries
from gatewise.session import scratch_dir
from gatewise.streaming import live, microbatch
from gatewise.streaming.history import LOGIN
from gatewise.streaming.microbatch import BatchParams
from gatewise.streaming.store import KeyedStore

@pytest.fixture(autouse=True, scope="module")
def interpreted(spark):
    """Rows are few and plans large, so compiling and dealing them out would take most of the time."""
    settings = {"spark.sql.codegen.wholeStage": "false", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


START = dt.datetime(2024, 1, 1, 10)


def test_a_burst_inside_one_second_is_cut_evenly(spark):
    rng = random.Random(1)
    rows = [("hot", rng.randrange(1_000_000)) for _ in range(6000)] + [(f"u{k % 50}", rng.randrange(10**9)) for k in range(1000)]
    table = spark.createDataFrame(rows, "who string, at bigint")
    cuts = even_cuts(table, "who", "at", 500)
    assert [r.who for r in cuts.collect()] == ["hot"]
    sizes = slotted(table, cuts, "who", "at").where("_slot is not null").groupBy("_slot").count()
    counts = [r["count"] for r in sizes.collect()]
    assert len(counts) == 12 and max(counts) <= 1.1 * 500


def test_running_aggregates_with_and_without_slots(spark):
    rng = random.Random(2)
    rows = [(k, None if k % 11 == 0 else "a" if k % 2 else f"u{k % 7}", k % 3, rng.randrange(60), rng.choice([None, 1, 5, 9])) for k in range(400)]
    table = spark.createDataFrame(rows, "id bigint, who string, sub int, at bigint, x bigint")
    for limit in (10, 1000):
        parts = slotted(table, even_cuts(table, "who", "at", limit), "who", "at")
        for keys in (["who"], ["who", "sub"]):
            got = running_before(parts, keys, "at", {"s": F.col("x")}, {"m": F.col("x")}).collect()
            assert len(got) == len(rows)
            for r in got:
                past = [q[4] for q in rows if q[1] == r.who and q[3] < r["at"] and (len(keys) == 1 or q[2] == r["sub"]) and q[4] is not None]
                assert (r.s, r.m) == ((sum(past), max(past)) if past else (None, None))


def _store(spark, path, **kw):
    return KeyedStore(spark, str(path), "who string, kind string", "n bigint, low bigint, high bigint", {"n": "sum", "low": "min", "high": "max"}, buckets=4, **kw)


def test_store_merges_retries_compacts_and_looks_up(spark, tmp_path):
    store = _store(spark, tmp_path, every=2)
    batch = lambda *rows: spark.createDataFrame(rows, "who string, kind string, n bigint, low bigint, high bigint")
    assert store.read().count() == 0 and store.lookup("a").count() == 0 and store.vacuum() == []
    store.put(batch(("a", "x", 1, 5, 5), ("a", "x", 1, 4, 9), (None, "x", 1, 1, 1)), 0)
    store.put(batch(("a", "x", 100, 0, 100)), 1)
    store.put(batch(("a", "x", 3, 7, 7), ("b", "y", 1, 1, 1)), 1)  # the same batch again
    want = {("a", "x", 5, 4, 9), ("b", "y", 1, 1, 1), (None, "x", 1, 1, 1)}
    assert set(map(tuple, store.read().collect())) == want
    assert {tuple(r) for r in store.read(before=1).collect()} == {("a", "x", 2, 4, 9), (None, "x", 1, 1, 1)}
    assert not store.compact_if_due(1) and store.compact_if_due(2) and store.base() == 1
    assert set(map(tuple, store.read().collect())) == want
    store.put(batch(("b", "y", 1, 0, 3)), 2)
    store.compact(2, lambda rows: rows.where("who is not null"))
    assert set(map(tuple, store.read().collect())) == {("a", "x", 5, 4, 9), ("b", "y", 2, 0, 3)}
    assert store.vacuum() == ["batch=0", "batch=1"] and store.read().count() == 2  # the base before stays for its readers
    found = store.lookup("b")
    assert [tuple(r) for r in found.collect()] == [("b", "y", 2, 0, 3)]
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit("b")), F.lit(4)).alias("b")).first().b
    filters = [line for line in found._jdf.queryExecution().toString().splitlines() if "PartitionFilters" in line]
    assert filters and all("bucket" in f and f"= {bucket})" in f for f in filters)


def test_a_compaction_that_died_leaves_the_old_base(spark, tmp_path):
    store = _store(spark, tmp_path)
    store.put(spark.createDataFrame([("a", "x", 1, 1, 1)], "who string, kind string, n bigint, low bigint, high bigint"), 0)
    store._write(spark.createDataFrame([("a", "x", 9, 9, 9)], "who string, kind string, n bigint, low bigint, high bigint"), f"{tmp_path}/base/upto=0")
    assert store.base() == -1 and [r.n for r in store.read().collect()] == [1]


def _batches(path, params, *frames, again=()):
    work = microbatch.score_batches(str(path), params)
    for k, df in enumerate(frames):
        rows = df.select(*live.LIVE_COLUMNS).withColumn("row_kind", F.lit(LOGIN)) if "row_kind" not in df.columns else df
        for _ in range(2 if k in again else 1):
            work(rows, k)
    return {r.row_id: r for r in microbatch.scores(frames[0].sparkSession, str(path)).collect()}


def test_late_untimed_and_nameless_logins(spark, events, tmp_path):
    fail = dict(login_success=False)
    first = events([(1, 1, "2024-01-01 10:00:00"), (2, 1, "2024-01-01 12:00:00", fail), (9, None, "2024-01-01 10:00:00")])
    second = events([
        (3, 1, "2024-01-01 11:00:00", dict(country="SE")), (4, 1, "2024-01-01 12:00:00"), (5, 1, "2024-01-01 12:00:30"),
        (10, None, "2024-01-01 11:00:00", dict(country="SE"))])
    untimed = events([(6, 1, "2024-01-01 13:00:00", dict(country="SE"))]).withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    third = events([(7, 1, "2024-01-01 13:00:00", dict(country="SE"))])
    got = _batches(tmp_path, BatchParams(), first, second.unionByName(untimed), third, again=(1,))
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 9, 10}
    assert not got[3].learned and got[3].country_change and got[3].login_frequency_today == 2
    # at the time of the newest row of an earlier batch a row is not late, and the two do not see each other
    assert got[4].learned and got[4].login_frequency_today == 1 and not got[4].failed_recently and got[4].rapid_login_rate == 0
    assert got[5].failed_recently and got[5].rapid_login_rate == 2 and got[5].login_frequency_today == 3
    assert got[6].score == 0 and not got[6].has_history and not got[6].learned
    assert got[7].country_change  # neither the late nor the untimed login taught anything
    assert not got[9].has_history and got[10].has_history and got[10].country_change
    empty = _batches(tmp_path / "none", BatchParams(), first.where("false"), first)
    assert set(empty) == {1, 2, 9}


def _random(events, n, seed=5):
    rng, rows, now = random.Random(seed), [], START
    for k in range(n):
        now += dt.timedelta(seconds=rng.choice([0, 0, 1, 20, 45, 200, 4000]))
        user = 1 if rng.random() < 0.5 else rng.choice([2, 3, None])
        rows.append((k, user, now, dict(
            country=rng.choice(["NO", "NO", "NO", "SE", None]), ip=f"1.1.1.{rng.randrange(5)}", asn=rng.choice([1, 2, None]),
            device_type=rng.choice(["desktop", "mobile"]), login_success=rng.random() < 0.7)))
    return events(rows)


@pytest.mark.parametrize("policy", [live.LearnPolicy(), live.LearnPolicy(everything=False)])
def test_any_cut_into_batches_gives_one_answer(spark, events, tmp_path, policy):
    rows = _random(events, 120)
    cuts = rows.approxQuantile("row_id", [0.4], 0.0)[0]
    # a cut between equal times would make the second of them see another first
    edge = rows.where(f"row_id >= {cuts}").agg(F.min("ts")).first()[0]
    params = BatchParams(live=live.LiveParams(policy=policy), slot_rows=25, compact_every=1, buckets=3)
    # whole and without slots; in two batches, one of them retried, with slots
    one = _batches(tmp_path / "one", BatchParams(live=params.live), rows)
    two = _batches(tmp_path / "two", params, rows.where(F.col("ts") < F.lit(edge)), rows.where(F.col("ts") >= F.lit(edge)), again=(1,))
    assert one.keys() == two.keys() and len(one) == 120
    for k, r in one.items():
        assert r == two[k], k
        assert not r.learned or policy.everything or r.decision == "allow"
    if policy.everything:
        want = {r.row_id: r for r in behaviour_features(rows.where("user_id is not null")).collect()}
        assert all(one[k][f] == w[f] for k, w in want.items() for f in FEATURES)


def test_profiles_expire_and_leave_the_table(spark, events, tmp_path):
    hour = 3600 * 1_000_000
    params = BatchParams(expire_us=hour, delay_us=0, compact_every=1, buckets=2)
    path = str(tmp_path)
    got = _batches(
        tmp_path, params,
        events([(1, 1, "2024-01-01 10:00:00"), (2, 2, "2024-01-01 10:30:00"), (3, 1, "2024-01-01 12:00:00")]),
        events([(4, 1, "2024-01-01 12:59:59"), (5, 2, "2024-01-01 12:30:00"), (6, 3, "2024-01-01 16:00:00")]),
        events([(7, 1, "2024-01-01 16:00:00")]))
    assert [got[k].has_history for k in range(1, 8)] == [False, False, False, True, False, False, False]
    store = microbatch.profile_store(spark, path, params)
    # the compaction before the third batch: what was silent for an hour at 16:00 is gone
    assert store.base() == 1 and {r.who for r in store.rows(before=2).select("who").distinct().collect()} == {"=3", "*"}
    seen = microbatch.profile_of(spark, path, 1, params).collect()
    assert len(seen) == 1 and seen[0].events == 1 and seen[0].user_id == 1 and seen[0].countries == ["NO"]
    assert microbatch.profile_of(spark, path, 99, params).count() == 0


def test_confirmed_values_are_known_from_then_on(spark, events, tmp_path):
    away = dict(country="RU", ip="9", asn=9)
    rows = events([(1, 1, "2024-01-01 10:00:00"), (2, 1, "2024-01-01 11:00:00", away), (3, 1, "2024-01-01 12:00:00", away)])
    told = live.confirmations(events([(8, 1, "2024-01-01 12:30:00", away)]))
    later = events([(4, 1, "2024-01-01 12:10:00", away), (5, 1, "2024-01-01 13:00:00", away)])
    mark = lambda df: df.withColumn("row_kind", F.lit(LOGIN))
    params = BatchParams(live=live.LiveParams(policy=live.LearnPolicy(everything=False)), risk_lookup=True)
    got = _batches(tmp_path, params, mark(rows), mark(later).unionByName(told))
    assert [got[k].country_change for k in (1, 2, 3, 4, 5)] == [False, True, True, True, False]
    assert [got[k].learned for k in (1, 2, 3, 4, 5)] == [True, False, False, False, True]
    risk = microbatch.risk_of(spark, str(tmp_path), 2, params).collect()
    assert len(risk) == 1 and risk[0].decision == "challenge" and "country" in risk[0].reasons and risk[0].score == got[2].score


def test_rules_and_model_decide_together_and_what_they_refuse_is_not_learned(spark, events, tmp_path):
    rows = _random(events, 60, seed=9)
    flat = models.Logistic(tuple(6.0 if f == "ip_seen_before" else 0.0 for f in FEATURES), -4.0)
    params = BatchParams(live=live.LiveParams(policy=live.LearnPolicy(everything=False)), model=flat, slot_rows=20)
    got = _batches(tmp_path, params, rows)
    swayed = 0
    for r in got.values():
        assert r.combined_score == r.score + int(r.model_score * 60)
        assert r.learned == (r.decision == "allow") and (r.decision == "allow") == (r.combined_score < 30)
        assert (scoring.MODEL_REASON in r.reasons) == (r.model_score >= 0.5)
        swayed += r.score < 30 <= r.combined_score
    assert swayed


def test_any_fitted_model_scores_features(spark, events):
    features = scoring.with_gold(behaviour_features(_random(events, 120).withColumn("is_attack_ip", F.col("country") == "SE")))
    for model in (models.fit_boosting(features, trees=2, depth=2), models.fit_log_odds(features), models.fit_logistic(features, max_iter=5)):
        out = models.with_model_score(model, features)
        assert out.columns == [*features.columns, "model_score"]
        assert out.where("model_score < 0 or model_score > 1 or model_score is null").count() == 0
        assert out.drop("model_score").exceptAll(features).count() == 0


def test_a_stream_restarted_from_its_checkpoint_repeats_nothing(spark, events, tmp_path):
    import time

    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(2):
        events([(2 * k, 1, START + dt.timedelta(minutes=k)), (2 * k + 1, 2, START + dt.timedelta(minutes=k))]).coalesce(1).write.mode("append").parquet(folder)
        stream = live.replay_source(spark, folder, events([(0, 1, START)]).schema)
        table = microbatch.run_live(stream, out)
        time.sleep(1.1)
    got = {r.row_id: r.login_frequency_today for r in table.collect()}
    assert table.count() == 4 and got == {0: 0, 1: 0, 2: 1, 3: 1}


def test_a_chain_of_logins_is_learned_without_judging_all_rows_in_each_round(spark, events, tmp_path, monkeypatch):
    # a new address passes only from a known system, a new system only from a known address
    rows, step = [(0, 1, START, dict(ip="0", os_family="0"))], 0
    for k in range(1, 5):
        for ip, system in ((k, k - 1), (k, k)):
            step += 1
            rows.append((step, 1, START + dt.timedelta(days=step), dict(ip=str(ip), os_family=str(system))))
    rows.append((50, 1, START + dt.timedelta(days=50), dict(ip="x", os_family="x")))
    judged = []
    scored = microbatch._Batch.scored
    monkeypatch.setattr(microbatch._Batch, "scored", lambda self, facts: judged.append(1) or scored(self, facts))
    got = _batches(tmp_path, BatchParams(live=live.LiveParams(policy=live.LearnPolicy(everything=False))), events(rows))
    assert all(got[k].learned and got[k].decision == "allow" for k in range(step + 1))
    assert not got[50].learned and got[50].score == 32
    assert len(judged) <= 3


def test_slices_of_many_files_are_still_one_batch_each(spark, events):
    start = dt.datetime(2024, 1, 1)
    rows = events([(i, i % 7, start + dt.timedelta(minutes=i)) for i in range(1000)])
    rows = rows.select(*[c if c in rows.columns else F.lit(None).cast("string").alias(c) for c in live.LIVE_COLUMNS])
    seen = []

    def look(batch, batch_id):
        seen.append((batch.agg(F.min("row_id"), F.max("row_id"), F.count("row_id")).first(), batch.select(F.input_file_name()).distinct().count()))

    stream = queries._slices(spark, rows, file_rows=120)
    stream.writeStream.foreachBatch(look).option("checkpointLocation", scratch_dir(spark, "slices-test")).trigger(availableNow=True).start().awaitTermination()
    # 499 or 500 rows a slice, four files of about 125 each
    (first, files), (second, more) = seen
    assert files == more == 4
    assert first[0] == 0 and second[1] == 999 and first[1] + 1 == second[0] and first[2] + second[2] == 1000


def test_slot_number_is_the_number_of_cuts_reached(spark):
    """Cuts of any number, rows at, before and behind them, without a time and of keys without cuts."""
    lengths = (1, 2, 3, 255, 256, 257, 510, 511, 512)
    cuts = spark.createDataFrame([(f"={n}", [3 * i for i in range(n)]) for n in lengths], "who string, cuts array<bigint>")
    keys = spark.createDataFrame([(f"={n}",) for n in (*lengths, 0)], "who string")
    rows = keys.crossJoin(spark.range(-2, 1540).select(F.col("id").alias("at")).union(spark.sql("select cast(null as bigint)")))
    for who, at, slot in slotted(rows, cuts, "who", "at").select("who", "at", "_slot").toPandas().astype(object).itertuples(index=False):
        n = int(who[1:])
        want = None if n == 0 else 0 if at != at else min(n, max(0, at // 3 + 1))
        assert (slot != slot) if want is None else slot == want, (who, at, slot)
