"""The processor of the path by user against a walk over the rows one by one."""

import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gatewise.functions.risk import FEATURES, KINDS, RULES, RiskParams
from gatewise.operators.features import FeatureParams, behaviour_features
from gatewise.streaming import history, live, packed
from gatewise.streaming.history import CONFIRM, FACTS, LOGIN, LearnPolicy, LoginHistory
from tests.test_features import random_logins

HOUR, DAY = 3_600_000_000, 86_400_000_000
COLUMNS = (*live.LIVE_COLUMNS, "row_kind", "at_us")
SCHEMA = pa.schema([
    ("row_id", pa.int64()), ("user_id", pa.int64()), ("ts", pa.timestamp("us")), ("login_success", pa.bool_()),
    ("is_attack_ip", pa.bool_()), ("is_ato", pa.bool_()), *[(c, pa.int64() if c == "asn" else pa.string()) for c in KINDS.values()],
    ("row_kind", pa.string()), ("at_us", pa.int64())])


class MapState:
    def __init__(self):
        self.kept, self.reads, self.writes = {}, 0, 0

    def getValue(self, key):
        self.reads += 1
        return self.kept.get(key)

    def updateValue(self, key, value):
        self.writes += 1
        self.kept[key] = value


class Handle:
    def getMapState(self, *_):
        return MapState()


def processor(policy, params=RiskParams()):
    made = LoginHistory(params, policy, COLUMNS)
    made.init(Handle())
    return made


def call(made, rows):
    table = pa.Table.from_pylist(rows, SCHEMA)
    parts = [pd.DataFrame({"packed": list(packed.blobs(table.slice(i, 7)))}) for i in range(0, len(rows), 7)]
    out = [blob for part in made.handleInputRows((1,), iter(parts), None) for blob in part["packed"]]
    return packed.table_of(out).to_pylist()


class Walk:
    """One user, row by row. A late row is held against the state as it is."""

    def __init__(self, params, policy):
        self.p, self.policy = params, policy
        self.known = self.known_at = self.at_last = self.today = 0
        self.known_at_us = self.last_us = self.day = self.fail = self.fail_before = None
        self.recent, self.hours, self.first = [], {}, {}

    def call(self, rows):
        timed = sorted((r for r in rows if r["at_us"] is not None), key=lambda r: (r["at_us"], r["row_id"]))
        return [(r["row_id"], *self.one(r)) for r in timed] + [
            (r["row_id"], 0, *[False] * len(KINDS), None, 0, 0, 0, False) for r in rows if r["at_us"] is None]

    def one(self, r):
        us, values = r["at_us"], {k: (k, r[c]) for k, c in KINDS.items()}
        if r["row_kind"] == CONFIRM:
            for v in values.values():
                self.first.setdefault(v, us)
            return (None, *[None] * len(KINDS), None, None, None, None, True)
        hour, day = (us // HOUR) % 24, us // DAY
        same = self.known_at if us == self.known_at_us else 0
        prior, same_hour = self.known - same, self.hours.get(hour, 0) - same
        seen = {k: self.first.get(v, us) < us for k, v in values.items()}
        failure = self.fail_before if self.fail == us else self.fail
        failure = None if failure is None or failure >= us else failure
        burst = sum(us - self.p.burst_us <= t < us for t in self.recent)
        today = self.today - (self.at_last if us == self.last_us else 0) if self.day == day else 0
        hits = {f"new_{k}": prior > 0 and not s for k, s in seen.items()} | {
            "recent_failure": failure is not None and failure >= us - self.p.lookback_us,
            "rapid": prior > 0 and burst >= self.p.rapid_min, "night": self.p.night_hours[0] <= hour <= self.p.night_hours[1],
            "frequency": prior > 0 and today >= self.p.frequency_min}
        score = sum(n for rule, n, _ in RULES if hits[rule])
        decision = dict(self.p.decisions)[next(name for name, lowest in self.p.levels if score >= lowest)]
        late = self.last_us is not None and us < self.last_us
        learned = not late and (self.policy.everything or decision in self.policy.accepted)
        if not late:
            self.at_last = self.at_last + 1 if us == self.last_us else 1
            self.today = self.today + 1 if self.day == day else 1
            self.last_us, self.day = us, day
            self.recent = [t for t in (*self.recent, us) if t >= us - self.p.burst_us]
            if r["login_success"] is False and self.fail != us:
                self.fail_before, self.fail = self.fail, us
        if learned:
            self.known_at = self.known_at + 1 if us == self.known_at_us else 1
            self.known_at_us, self.known, self.hours[hour] = us, self.known + 1, self.hours.get(hour, 0) + 1
            for v in values.values():
                self.first.setdefault(v, us)
        return (prior, *seen.values(), failure, burst, today, same_hour, learned)


def rows_of(seed, n, newest):
    """Users of few and many rows, NULL users and values, ties, bursts, late and untimed rows, confirmations."""
    dice = random.Random(seed)
    out = []
    for i in range(n):
        at = dice.choice([newest + dice.randrange(40) * HOUR // 4, newest + dice.randrange(200) * 1_000_000, newest - dice.randrange(DAY)])
        rare = lambda common, most: dice.choice([common, common, common, dice.randrange(most), None])
        text = lambda v: None if v is None else f"v{v}"
        out.append(dict(
            row_id=seed * 1000 + i, user_id=dice.choice([0, 0, 0, 1, 2, None]), ts=None, login_success=dice.choice([True, True, False, None]),
            is_attack_ip=False, is_ato=None, row_kind=dice.choice([LOGIN] * 9 + [CONFIRM]), at_us=None if dice.random() < 0.05 else at,
            asn=rare(1, 3), ip=text(rare(7, 30)), country=text(rare(1, 3)), device_type=text(rare(2, 3)), os_family=text(rare(1, 4)),
            browser_family=text(rare(1, 4))))
    return out


@pytest.mark.parametrize("policy", [LearnPolicy(), LearnPolicy(everything=False), LearnPolicy(everything=False, accepted=("allow", "challenge"))])
def test_calls_equal_a_walk_over_the_rows(monkeypatch, policy):
    monkeypatch.setattr(history, "_BLOCK", 16)
    monkeypatch.setattr(history, "_PROFILE_VALUES", 9)  # further values are looked up one by one
    params = RiskParams(frequency_min=4)
    made, walks = processor(policy, params), {}
    for seed in range(12):
        rows = rows_of(seed, 60, 20_000 * DAY + seed * DAY // 3)
        want = []
        for user in {r["user_id"] for r in rows}:
            walk = walks.setdefault(user, Walk(params, policy))
            want += walk.call([r for r in rows if r["user_id"] == user])
        got = call(made, rows)
        assert [{c: r[c] for c in COLUMNS} for r in got] == rows  # every column as it was, in the order of the rows
        facts = {r["row_id"]: (r["row_id"], *[r[f.name] for f in FACTS]) for r in got}
        assert len(facts) == len(want)
        for line in want:
            assert facts[line[0]] == line
    assert made.more.kept


def test_state_is_read_and_written_once_per_user_and_call():
    made = processor(LearnPolicy(everything=False))
    rows = [r | {"user_id": i % 40, "ip": f"ip{i}"} for i, r in enumerate(rows_of(1, 400, 20_000 * DAY))]
    call(made, rows)
    assert (made.users.reads, made.users.writes, made.more.reads, made.more.writes) == (40, 40, 0, 0)


def test_packed_rows_come_back_as_they_were(monkeypatch):
    monkeypatch.setattr(packed, "BLOB_ROWS", 10)
    monkeypatch.setattr(packed, "GATHER_ROWS", 64)
    table = pa.Table.from_pylist([r | {"bucket": i % 3} for i, r in enumerate(rows_of(2, 200, 20_000 * DAY))],
                                 SCHEMA.append(pa.field("bucket", pa.int32())))
    dealt = list(packed.pack(iter(table.to_batches(max_chunksize=30))))
    assert len(dealt) == 3
    for bucket in range(3):
        mine = [b for d in dealt for b, k in zip(d["packed"].to_pylist(), d["bucket"].to_pylist()) if k == bucket]
        assert all(packed.table_of([b]).num_rows <= 10 for b in mine)
        want = [r["row_id"] for r in table.to_pylist() if r["bucket"] == bucket]
        assert [r["row_id"] for r in packed.table_of(mine).to_pylist()] == want
    back = pa.Table.from_batches(packed.unpack(iter(dealt)))
    order = lambda t: t.sort_by("row_id").to_pylist()
    assert order(back) == order(table.drop_columns(["bucket"]))


def test_a_trigger_takes_all_files_of_a_slice(spark, events, tmp_path):
    base = random_logins(events, 600)
    who = F.when(F.col("row_id") % 2 == 0, 0).when(F.col("row_id") % 7 > 0, F.col("user_id") + 1).cast("bigint")
    df, folder = base.withColumn("user_id", who), str(tmp_path / "in")
    slices, files = live.spread_slices(df, folder, F.col("user_id"), live.micros(F.col("ts")), slice_rows=80, file_rows=20)
    assert slices > 2 and files > 1
    assert spark.read.parquet(folder).select(F.input_file_name()).distinct().count() == slices * files
    stream = live.replay_source(spark, folder, df.schema, files_per_trigger=files)
    got = live.run_to_table(live.live_scores(stream), str(tmp_path / "out")).collect()
    want = {r.row_id: r for r in behaviour_features(df, FeatureParams(slot_rows=20)).collect()}
    assert sorted(r.row_id for r in got) == sorted(want)
    for r in got:
        assert [r[f] for f in FEATURES] == [want[r.row_id][f] for f in FEATURES], r.row_id
