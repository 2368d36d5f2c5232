"""Live scoring by micro-batches: rules and a model over profiles kept in a keyed table.

The keyed path (:mod:`gatewise.streaming.live`) keeps a user's profile in one state partition and answers at once;
a user holding half of the stream is one task there. Here a micro-batch is a table: timelines of busy users are
cut into even slots, facts are computed inside (user, slot) and merged from slot totals, and profiles are rows of a
:class:`~gatewise.streaming.store.KeyedStore`, a row per user, kind and value. No task holds more than a slot.

Learning only from accepted logins makes a decision depend on the decisions before it. It is solved by rounds over
the whole batch: what the stored profile alone accepts is learned first, then what that lets be accepted, until
nothing changes. A fact looks at strictly earlier rows only, so the rounds end at the one answer that reading the
rows in order would give. Where rules alone decide and fewer points are never worse, what is learned only lets more in,
so a round looks at patterns (equal values and equal points of the other rules) whose values have become known since
the last one; the rows are judged once, at the end.

Time. A row older than the newest of its user in an earlier batch is late: scored against the profile as it stands,
and never learned. With ``expire_us`` a profile lives until its user has been silent for longer than that; the next login
starts a new one. Profiles silent since before the watermark (the newest time seen less ``delay_us``) by that much
leave the table when it is compacted.

Defined results: a login without a time has no history and teaches nothing; a missing user is a user; rows repeated in
one batch are rows of their own; equal times do not see each other; a batch that is retried replaces what it wrote.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gatewise.functions import risk
from gatewise.functions.risk import KINDS, RULES
from gatewise.functions.text import micros
from gatewise.operators import models, scoring
from gatewise.operators.slots import even_cuts, running_before, slotted
from gatewise.session import written
from gatewise.streaming.history import CONFIRM, LOGIN
from gatewise.streaming.live import LIVE_COLUMNS, LiveParams, features_from_facts
from gatewise.streaming.store import KeyedStore

_DAY_US, _HOUR_US = 86_400 * 1_000_000, 3_600 * 1_000_000
#: Before every time that can occur.
_EVER = -(1 << 62)
_CLOCK = "*"


@dataclass(frozen=True)
class BatchParams:
    """``slot_rows``: rows of one user that one task may hold. ``model``: a fitted model of :mod:`gatewise.operators.models`,
    whose probability adds up to ``model_points`` to the rules' score; the sum decides, and decides what is learned.
    ``risk_lookup``: also keep every decision in a table by event id."""

    live: LiveParams = field(default_factory=LiveParams)
    slot_rows: int = 200_000
    max_heavy_share: float = 1 / 50_000
    expire_us: int | None = None
    delay_us: int = 600 * 1_000_000
    model: object = None
    model_points: int = 60
    risk_lookup: bool = False
    buckets: int = 32
    compact_every: int = 20


def profile_store(spark: SparkSession, path: str, params: BatchParams = BatchParams()) -> KeyedStore:
    """Profiles under ``path``: per user, life, kind and value what was counted and when it was seen first and last."""
    return KeyedStore(
        spark, f"{path}/profiles", "who string, life bigint, kind string, value string",
        "n bigint, known bigint, failed bigint, first_us bigint, last_us bigint",
        {"n": "sum", "known": "sum", "failed": "sum", "first_us": "min", "last_us": "max"}, params.buckets, params.compact_every)


def _mark(value: Column) -> Column:
    """Text that keeps NULL apart from any value."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))


def _with(rows: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` left-joined to ``side``, unique by ``keys``, in joins whose keys hold no more rows than a slot."""
    met = rows.select(*keys, "slot").distinct().join(side, keys)
    return rows.join(met, [*keys, "slot"], "left")


def _values(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per row and kind of value."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), _mark(F.col(c)).alias("value")) for k, c in KINDS.items()])
    return rows.select(*columns, F.explode(pairs).alias("p")).select(*columns, "p.kind", "p.value")


class _Batch:
    """One micro-batch against the profiles as they were before it."""

    def __init__(self, batch: DataFrame, batch_id: int, store: KeyedStore, params: BatchParams):
        self.params, self.store, self.batch_id = params, store, batch_id
        self.risk, c = params.live.risk, F.col
        self.span = max(self.risk.lookback_us, self.risk.burst_us)
        rows = batch.select(*LIVE_COLUMNS, "row_kind").withColumns({
            "at_us": micros(c("ts")), "who": _mark(c("user_id")), "rid": F.monotonically_increasing_id()})
        rows = written(rows, "live-rows")
        # a batch that a task may hold needs no cuts; a row weighs where it happens and where it leaves the burst window
        self.cuts = None
        weights = rows.select("who", c("at_us").alias("at")).union(rows.select("who", c("at_us") + self.risk.burst_us))
        if rows.count() > params.slot_rows:
            self.cuts = written(even_cuts(weights, "who", "at", params.slot_rows, params.max_heavy_share), "live-cuts")
        rows = slotted(rows, self.cuts, "who", "at_us", "slot").withColumn("slot", F.coalesce("slot", F.lit(-1)))
        past = store.read(before=batch_id).join(rows.select("who").distinct(), "who", "left_semi")
        newest = past.groupBy("who").agg(F.max("life").alias("_life"))
        past = past.join(newest.withColumnRenamed("who", "_who"), (c("who") == c("_who")) & (c("life") == c("_life")), "left_semi")
        self.past = written(past, "live-past")
        totals = self.past.where("kind = 'total'").select("who", c("life").alias("old_life"), c("last_us").alias("old_us"))
        rows = _with(rows, totals, ["who"])
        timed, told = c("at_us").isNotNull(), c("row_kind") == CONFIRM
        state = F.when(~timed, "untimed").when(told, "told").when(c("at_us") < c("old_us"), "late").otherwise("new")
        self.rows = written(self._lives(rows.withColumn("state", state)), "live-placed")
        self.new = self.rows.where("state = 'new'")
        self.attempts = written(self._attempts(), "live-attempts")

    def _slotted(self, items: DataFrame) -> DataFrame:
        return slotted(items, self.cuts, "who", "at")

    def _before(self, rows: DataFrame, keys: list[str], at: str, sums=None, maxima=None) -> DataFrame:
        return running_before(rows, keys, at, sums, maxima, cut=self.cuts is not None)

    def _lives(self, rows: DataFrame) -> DataFrame:
        """Adds ``life``, the time at which the profile that a row meets began; 0 if profiles never end."""
        if self.params.expire_us is None:
            return rows.withColumn("life", F.lit(0).cast("bigint"))
        c = F.col
        timed = rows.where("state in ('new', 'told')")
        items = timed.select("rid", "who", c("at_us").alias("at"), F.when(c("state") == "new", c("at_us")).alias("login_us"), "old_life", "old_us")
        before = self._before(self._slotted(items), ["who"], "at", maxima={"prior_us": c("login_us")})
        prior = F.greatest("prior_us", "old_us")
        opens = F.when(c("login_us").isNotNull() & (prior.isNull() | (c("at") - prior > self.params.expire_us)), c("at"))
        opened = self._before(before.withColumn("opens", opens), ["who"], "at", maxima={"opened": c("opens")})
        lives = opened.select(c("rid").alias("_rid"), F.greatest("opens", "opened", "old_life").alias("life"))
        joined = rows.join(lives, c("rid") == c("_rid"), "left").drop("_rid")
        return joined.withColumn("life", F.coalesce("life", "old_life"))

    def _recent(self) -> DataFrame:
        return self.past.where("kind = 'at'").select("who", "life", F.col("value").cast("bigint").alias("at"), "n", "known", "failed")

    def _attempts(self) -> DataFrame:
        """Per new row what does not depend on learning: last failure, burst and today's count before it."""
        c, zero = F.col, F.lit(0).cast("bigint")
        day = lambda at: F.floor(at / _DAY_US)
        own = self.new.select(
            "rid", "who", "life", c("at_us").alias("at"), F.lit(1).cast("bigint").alias("n"),
            F.when(~c("login_success"), c("at_us")).alias("failed_us"))
        kept = self._recent().select(
            F.lit(None).cast("bigint").alias("rid"), "who", "life", "at", "n", F.when(c("failed") > 0, c("at")).alias("failed_us"))
        arrivals = own.unionByName(kept).withColumns({"alive": c("n"), "day": day(c("at"))})
        nothing = {"rid": F.lit(None).cast("bigint"), "failed_us": F.lit(None).cast("bigint")}
        leaving = arrivals.withColumns(nothing | {"at": c("at") + self.risk.burst_us, "alive": -c("n"), "n": zero, "day": F.lit(None).cast("bigint")})
        days = self.past.where("kind = 'day'").select("who", "life", "n", c("value").cast("bigint").alias("day"))
        # rows of the last minutes are there themselves, so they leave the day's stored count
        days = days.unionByName(self._recent().select("who", "life", (-c("n")).alias("n"), day(c("at")).alias("day")))
        days = days.withColumns(nothing | {"at": F.lit(_EVER), "alive": zero})
        items = self._slotted(arrivals.unionByName(leaving).unionByName(days))
        told = self._before(items, ["who", "life"], "at", {"_in_burst": c("alive")}, {"_last_failure": c("failed_us")})
        # rows that leave the window belong to no day
        told = self._before(told.where("day is not null"), ["who", "life", "day"], "at", {"_today_before": c("n")})
        return told.where("rid is not null").select(
            "rid", "_last_failure", F.coalesce("_in_burst", zero).alias("_in_burst"), F.coalesce("_today_before", zero).alias("_today_before"))

    def _counts(self, learned: DataFrame) -> DataFrame:
        """Per new row the known logins before it, of all hours and of its own; ``learned``: rid of learned rows."""
        c, zero, none = F.col, F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
        hour = lambda at: F.pmod(F.floor(at / _HOUR_US), F.lit(24))
        flagged = self.new.join(learned.select("rid", F.lit(1).cast("bigint").alias("taught")), "rid", "left")
        own = flagged.select(
            "rid", "who", "life", c("at_us").alias("at"), F.coalesce("taught", zero).alias("known"), F.coalesce("taught", zero).alias("in_hour"),
            hour(c("at_us")).alias("hour"))
        recent = self._recent().select(none.alias("rid"), "who", "life", "at", "known", c("known").alias("in_hour"), hour(c("at")).alias("hour"))
        # the stored counts lie before all times, less the rows that are there themselves
        less = recent.withColumns({"at": F.lit(_EVER), "known": -c("known"), "in_hour": -c("in_hour")})
        total = self.past.where("kind = 'total'").select(
            none.alias("rid"), "who", "life", F.lit(_EVER).alias("at"), "known", zero.alias("in_hour"), none.alias("hour"))
        hours = self.past.where("kind = 'hour'").select(
            none.alias("rid"), "who", "life", F.lit(_EVER).alias("at"), zero.alias("known"), c("known").alias("in_hour"), c("value").cast("bigint").alias("hour"))
        items = self._slotted(reduce(DataFrame.unionByName, [own, recent, less, total, hours]))
        told = self._before(items, ["who", "life"], "at", {"_prior": c("known")})
        told = self._before(told, ["who", "life", "hour"], "at", {"_hour_before": c("in_hour")})
        return told.where("rid is not null").select(
            "rid", F.coalesce("_prior", zero).alias("_prior"), F.coalesce("_hour_before", zero).alias("_hour_before"))

    def _firsts(self, learned: DataFrame | None) -> DataFrame:
        """When each user first used each value, as far as it is known."""
        c, keys = F.col, ["who", "life", "kind", "value"]
        known = self.past.where(c("kind").isin(*KINDS)).select(*keys, "first_us")
        if learned is not None:
            confirmed = self.rows.where("state = 'told' and life is not null")
            taught = self.new.join(learned.select("rid"), "rid", "left_semi").unionByName(confirmed)
            known = known.unionByName(_values(taught, "who", "life", "at_us").select(*keys, c("at_us").alias("first_us")))
        return known.groupBy(*keys).agg(F.min("first_us").alias("first_us"))

    def _seen(self, rows: DataFrame, firsts: DataFrame) -> DataFrame:
        long = _with(_values(rows, "rid", "who", "life", "slot", "at_us"), firsts, ["who", "life", "kind", "value"])
        before = F.coalesce(F.col("first_us") < F.col("at_us"), F.lit(False))
        return long.groupBy("rid").agg(*[F.max(F.when(F.col("kind") == k, before)).alias(f"_seen_{k}") for k in KINDS])

    def facts(self, learned: DataFrame) -> DataFrame:
        """New rows with all facts, given which of them were learned."""
        told = self.new.join(self.attempts, "rid").join(self._counts(learned), "rid").join(self._seen(self.new, self._firsts(learned)), "rid")
        return told.join(learned.select("rid", F.lit(True).alias("_learned")), "rid", "left").fillna(False, ["_learned"])

    def aside(self) -> DataFrame:
        """Rows that are scored without being learned: late ones, against the stored profile, and those without a time."""
        c, zero = F.col, F.lit(0).cast("bigint")
        late = self.rows.where("state = 'late'").withColumn("life", c("old_life"))
        sums = self.past.groupBy("who").agg(
            F.max(F.when(c("kind") == "total", c("known"))).alias("_prior"),
            F.max(F.when((c("kind") == "at") & (c("failed") > 0), c("value").cast("bigint"))).alias("fail_us"),
            F.map_from_entries(F.collect_list(F.when(c("kind") == "hour", F.struct(c("value").cast("int"), "known")))).alias("hours"),
            F.map_from_entries(F.collect_list(F.when(c("kind") == "day", F.struct(c("value").cast("bigint"), "n")))).alias("days"))
        told = _with(late, sums, ["who"]).join(self._seen(late, self._firsts(None)), "rid")
        told = told.withColumns({
            "_last_failure": F.when(c("fail_us") < c("at_us"), c("fail_us")), "_in_burst": zero,
            "_today_before": F.coalesce(F.element_at("days", F.floor(c("at_us") / _DAY_US)), zero),
            "_hour_before": F.coalesce(F.element_at("hours", F.pmod(F.floor(c("at_us") / _HOUR_US), F.lit(24)).cast("int")), zero),
        }).drop("fail_us", "hours", "days")
        untimed = self.rows.where(f"state = 'untimed' and row_kind = '{LOGIN}'").withColumns(
            {f"_seen_{k}": F.lit(False) for k in KINDS}
            | {"_prior": zero, "_last_failure": F.lit(None).cast("bigint"), "_in_burst": zero, "_today_before": zero, "_hour_before": zero})
        return told.unionByName(untimed).withColumn("_learned", F.lit(False))

    def scored(self, facts: DataFrame) -> DataFrame:
        keyed = facts.withColumnsRenamed({"rid": "row_key"})
        features = features_from_facts(keyed, self.risk, "row_key")
        scores = scoring.score_events(features, self.risk)
        if self.params.model is None:
            return scores
        # the rules' expressions would be repeated inside the model's and grow beyond what a method holds
        with_model = models.with_model_score(self.params.model, written(scores, "live-rules"))
        return scoring.combine(with_model, self.params.model_points, params=self.risk)

    def _accepted(self, scores: DataFrame) -> DataFrame:
        return scores.where(F.col("decision").isin(*self.params.live.policy.accepted)).select(F.col("row_key").alias("rid"))

    def learned(self) -> DataFrame:
        """rid of the new rows that enter the profile."""
        everyone = self.new.select("rid")
        if self.params.live.policy.everything:
            return everyone
        return self._by_patterns() if self._fewer_points_pass() else self._by_rounds(everyone)

    def _fewer_points_pass(self) -> bool:
        """Whether rules alone decide and every score below an accepted one is accepted."""
        actions, accepted = dict(self.risk.decisions), self.params.live.policy.accepted
        passes = [actions.get(name) in accepted for name, _ in sorted(self.risk.levels, key=lambda level: level[1])]
        return self.params.model is None and passes == sorted(passes, reverse=True)

    def _points(self, seen: bool, prior: int) -> DataFrame:
        """Score of each new row if all its values were known (``seen``) and its user had ``prior`` logins."""
        told = {f"_seen_{k}": F.lit(seen) for k in KINDS} | {
            "_prior": F.lit(prior).cast("bigint"), "_hour_before": F.lit(0).cast("bigint"), "_learned": F.lit(False)}
        return self.scored(self.new.join(self.attempts, "rid").withColumns(told)).select(F.col("row_key").alias("rid"), "score")

    def _by_patterns(self) -> DataFrame:
        c, life = F.col, ["who", "life"]
        values = [f"v_{k}" for k in KINDS]
        points = {rule: n for rule, n, _ in RULES}
        passes = lambda score: F.coalesce(risk.decision(risk.level(score, self.risk), self.risk).isin(*self.params.live.policy.accepted), F.lit(False))
        first, later = self._points(False, 0), self._points(True, 1)
        rows = self.new.select("rid", *life, "slot", "at_us", *[_mark(c(col)).alias(f"v_{k}") for k, col in KINDS.items()])
        rows = rows.join(first.select("rid", passes(c("score")).alias("opens")), "rid").join(later.select("rid", c("score").alias("base")), "rid")
        rows = written(rows, "live-judged")
        # from when on a profile has learned something: before the batch, or by its first row that passes without history
        known = self.past.where("kind = 'total' and known > 0").select(*life, F.lit(_EVER).alias("began"))
        began = known.unionByName(rows.where("opens").groupBy(*life).agg(F.min("at_us").alias("began")))
        began = written(began.groupBy(*life).agg(F.min("began").alias("began")), "live-began")
        # what no known value can let in is in no pattern
        may = rows.where(passes(c("base")))
        pattern = [*life, *values, "base"]
        # per pattern and slot its times end where, so that one slot of a pattern is looked into
        ends = written(may.groupBy(*pattern, "slot").agg(F.max("at_us").alias("ends")), "live-ends")
        patterns = ends.groupBy(*pattern).agg(F.max("ends").alias("ends")).join(began, life)
        # a number for each pattern's columns, unlike a hash never the same for two
        patterns = written(patterns.withColumn("pattern", F.monotonically_increasing_id()), "live-patterns")
        numbered = patterns.select(*pattern, "pattern")
        times = written(_with(may, numbered, pattern).select("rid", "pattern", "slot", "at_us"), "live-times")
        ends = written(ends.join(numbered, pattern).select("pattern", "slot", "ends"), "live-ends")
        places = patterns.select(*life, "pattern", F.explode(F.array(*[
            F.struct(F.lit(k).alias("kind"), c(f"v_{k}").alias("value")) for k in KINDS])).alias("p"))
        places = written(places.select(*life, "pattern", "p.kind", "p.value"), "live-places")
        key = [*life, "kind", "value"]
        own = patterns.select("pattern", *life, "began", "base", "ends")

        def since(firsts: DataFrame) -> DataFrame:
            """Per pattern the time after which it passes, given when its values were first known."""
            met = places.join(firsts, key, "left").groupBy("pattern").agg(
                *[F.max(F.when(c("kind") == k, c("first_us"))).alias(f"f_{k}") for k in KINDS])
            wanting = lambda at: reduce(lambda a, b: a + b, [
                F.when(c(f"f_{k}").isNull() | (c(f"f_{k}") > at), points[f"new_{k}"]).otherwise(0) for k in KINDS], c("base"))
            steps = F.array_compact(F.array(c("began"), *[F.when(c(f"f_{k}").isNotNull(), F.greatest(c("began"), c(f"f_{k}"))) for k in KINDS]))
            passing = F.array_min(F.filter(steps, lambda at: passes(wanting(at))))
            return own.join(met, "pattern").select("pattern", *life, "ends", passing.alias("since"))

        learned = _values(self.new.join(rows.where("opens").join(began, life).where(c("at_us") == c("began")).select("rid"), "rid", "left_semi")
                          .unionByName(self.rows.where("state = 'told' and life is not null")), *life, "at_us")
        firsts = self._firsts(None).unionByName(learned.select(*key, c("at_us").alias("first_us")))
        firsts = written(firsts.groupBy(*key).agg(F.min("first_us").alias("first_us")), "live-firsts")
        done = None
        while True:
            now = since(firsts).where("since < ends")
            if done is not None:  # only what passes from an earlier time on than before
                before = done.select("pattern", c("since").alias("was"))
                now = now.join(before, "pattern", "left").where("was is null or since < was").drop("was")
            now = written(now, "live-since")
            if now.isEmpty():
                break
            # the first row behind that time, from the first slot that ends behind it
            slot = ends.join(now.select("pattern", "since"), "pattern").where("ends > since").groupBy("pattern", "since").agg(F.min("slot").alias("slot"))
            taught = times.join(slot, ["pattern", "slot"]).where("at_us > since").groupBy("pattern").agg(F.min("at_us").alias("first_us"))
            fresh = places.join(taught, "pattern").select(*key, "first_us")
            firsts = written(firsts.unionByName(fresh).groupBy(*key).agg(F.min("first_us").alias("first_us")), "live-firsts")
            done = now if done is None else done.unionByName(now)
            done = written(done.groupBy("pattern", *life, "ends").agg(F.min("since").alias("since")), "live-done")
        opening = rows.where("opens").join(began, life).where(c("at_us") == c("began")).select("rid")
        if done is None:
            return opening
        passed = _with(times, done.select("pattern", "since"), ["pattern"]).where("at_us > since").select("rid")
        return opening.unionByName(passed)

    def _by_rounds(self, everyone: DataFrame) -> DataFrame:
        """Every row anew in every round; for models and policies under which a known value can also shut rows out."""
        # Where nothing is known yet, only the first that its time and failures alone let in is sure to be learned.
        alone = written(self.scored(self.facts(everyone.where("false"))), "live-alone")
        sure = self.new.join(self._accepted(alone), "rid").join(alone.select(F.col("row_key").alias("rid"), "has_history"), "rid")
        items = slotted(sure.withColumn("at", F.col("at_us")), self.cuts, "who", "at")
        first = self._before(items, ["who", "life"], "at", maxima={"earlier": F.when(~F.col("has_history"), 1)})
        learned = written(first.where("has_history or earlier is null").select("rid"), "live-learned")
        while True:
            now = written(self._accepted(self.scored(self.facts(learned))), "live-learned")
            if now.exceptAll(learned).isEmpty() and learned.exceptAll(now).isEmpty():
                return now
            learned = now

    def changes(self, learned: DataFrame) -> DataFrame:
        """What the batch adds to the profiles."""
        c, zero, none = F.col, F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
        rows = self.new.join(learned.select("rid", F.lit(1).cast("bigint").alias("taught")), "rid", "left").fillna(0, ["taught"])
        failed = F.when(~c("login_success"), 1).otherwise(0).cast("bigint")
        columns = lambda **made: [made.get(n, d).alias(n) for n, d in (("n", zero), ("known", zero), ("failed", zero), ("first_us", none), ("last_us", none))]
        key = lambda kind, value: ["who", "life", F.lit(kind).alias("kind"), value.cast("string").alias("value")]
        one = F.lit(1).cast("bigint")
        newest = rows.groupBy("who", "life").agg(F.max("at_us").alias("newest"))
        recent = _with(rows, newest, ["who", "life"]).where(c("at_us") >= c("newest") - self.span)
        parts = [
            rows.select(*key("total", F.lit("")), *columns(n=one, known=c("taught"), failed=failed, first_us=c("at_us"), last_us=c("at_us"))),
            rows.select(*key("day", F.floor(c("at_us") / _DAY_US)), *columns(n=one)),
            rows.select(*key("hour", F.pmod(F.floor(c("at_us") / _HOUR_US), F.lit(24))), *columns(known=c("taught"))),
            recent.select(*key("at", c("at_us")), *columns(n=one, known=c("taught"), failed=failed)),
            rows.agg(F.max("at_us").alias("at_us")).where("at_us is not null").select(
                F.lit(_CLOCK).alias("who"), F.lit(0).cast("bigint").alias("life"), F.lit("clock").alias("kind"), F.lit("").alias("value"),
                *columns(last_us=c("at_us"))),
        ]
        confirmed = self.rows.where("state = 'told' and life is not null").withColumn("taught", F.lit(1).cast("bigint"))
        values = _values(rows.where("taught = 1").select("who", "life", "at_us", *KINDS.values()).unionByName(
            confirmed.select("who", "life", "at_us", *KINDS.values())), "who", "life", "at_us")
        parts.append(values.select("who", "life", "kind", "value", *columns(first_us=c("at_us"))))
        return reduce(DataFrame.unionByName, parts)


def _pruned(params: BatchParams):
    """A function that drops what no later row can use from merged profiles."""
    span = max(params.live.risk.lookback_us, params.live.risk.burst_us)

    def prune(rows: DataFrame) -> DataFrame:
        c = F.col
        clock = rows.where("kind = 'clock'").agg(F.max("last_us").alias("t")).scalar()
        # hash parts of a profile stand for slots, so that a profile of many values is not one task
        parted = rows.withColumn("slot", F.pmod(F.xxhash64("value"), F.lit(16)))
        newest = rows.where("kind = 'total'").groupBy("who").agg(F.max(F.struct("life", "last_us")).alias("now"))
        held = _with(parted, newest, ["who"])
        alive = c("now").isNull() | (c("life") == c("now.life"))
        if params.expire_us is not None:
            alive &= c("now").isNull() | (c("now.last_us") >= clock - params.delay_us - params.expire_us)
        used = F.when(c("kind") == "at", c("value").cast("bigint") >= c("now.last_us") - span).when(
            c("kind") == "day", c("value").cast("bigint") >= F.floor(c("now.last_us") / _DAY_US)).otherwise(True)
        return held.where(alive & used).select(*rows.columns)

    return prune


def score_batches(path: str, params: BatchParams = BatchParams()):
    """A ``foreachBatch`` function: scores to ``path/scores/batch=…``, then what was learned to the profiles."""
    def work(batch: DataFrame, batch_id: int) -> None:
        store = profile_store(batch.sparkSession, path, params)
        store.compact_if_due(batch_id, _pruned(params))
        this = _Batch(batch, batch_id, store, params)
        learned = written(this.learned(), "live-learned")
        columns = this.rows.columns
        both = this.facts(learned).select(*columns, *_FACT_NAMES).unionByName(this.aside().select(*columns, *_FACT_NAMES))
        folder = f"{path}/scores/batch={batch_id}"
        this.scored(both).drop("row_key").write.mode("overwrite").parquet(folder)
        if params.risk_lookup:
            told = batch.sparkSession.read.parquet(folder).where("row_id is not null")
            risks = risk_store(batch.sparkSession, path, params)
            risks.compact_if_due(batch_id)
            risks.put(told.withColumns({"reasons": F.array_join("reasons", "; "), "at": F.col("ts").cast("string"), "who": _mark(F.col("user_id"))}), batch_id)
        store.put(this.changes(learned), batch_id)

    return work


def risk_store(spark: SparkSession, path: str, params: BatchParams = BatchParams()) -> KeyedStore:
    """What was decided about each event, by its id."""
    values = ("who string", "at string", "score int", "level string", "decision string", "reasons string")
    return KeyedStore(
        spark, f"{path}/risks", "row_id bigint", ", ".join(values), {v.split()[0]: "max" for v in values}, params.buckets, params.compact_every)


def risk_of(spark: SparkSession, path: str, row_id: int, params: BatchParams = BatchParams()) -> DataFrame:
    """Score, level, decision and reasons of one event; reads one bucket."""
    return risk_store(spark, path, params).lookup(row_id)


def profiles(rows: DataFrame) -> DataFrame:
    """One row per user from profile rows: what was counted, known countries and devices, and the usual hour.

    Of several lives the newest counts. The usual hour is the one with the most learned logins, the earliest of equals.
    """
    c = F.col
    newest = rows.where("kind = 'total'").groupBy("who").agg(F.max("life").alias("_life"))
    parted = rows.withColumn("slot", F.pmod(F.xxhash64("value"), F.lit(16)))
    now = _with(parted, newest, ["who"]).where("life = _life")
    listed = lambda kind: F.array_sort(F.collect_list(F.when(c("kind") == kind, F.substring("value", 2, 1 << 30))))
    hour = F.struct("known", -c("value").try_cast("int"))
    total = lambda column: F.max(F.when(c("kind") == "total", c(column)))
    return now.where(c("kind").isin("total", "hour", "country", "device")).groupBy("who").agg(
        total("n").alias("events"), total("known").alias("learned"), total("failed").alias("failures"),
        F.timestamp_micros(total("first_us")).cast("timestamp_ntz").alias("first_seen"),
        F.timestamp_micros(total("last_us")).cast("timestamp_ntz").alias("last_seen"),
        listed("country").alias("countries"), listed("device").alias("devices"),
        F.max_by(F.when(c("kind") == "hour", c("value").try_cast("int")), F.when((c("kind") == "hour") & (c("known") > 0), hour)).alias("usual_hour"),
    ).withColumn("user_id", F.when(c("who") != "-", F.substring("who", 2, 1 << 30).cast("bigint"))).drop("who")


def profile_of(spark: SparkSession, path: str, user_id, params: BatchParams = BatchParams()) -> DataFrame:
    """The profile of one user; reads one bucket of the table."""
    who = "-" if user_id is None else f"={user_id}"
    return profiles(profile_store(spark, path, params).lookup(who))


_FACT_NAMES = ("_prior", *[f"_seen_{k}" for k in KINDS], "_last_failure", "_in_burst", "_today_before", "_hour_before", "_learned")


def run_live(logins: DataFrame, path: str, params: BatchParams = BatchParams(), feedback: DataFrame | None = None) -> DataFrame:
    """Drain a stream of clean logins (and of feedback rows) into scores under ``path`` and return them.

    Scores, profiles and checkpoint lie beside one another; a rerun continues where the last one ended.
    """
    rows = logins.select(*LIVE_COLUMNS).withColumn("row_kind", F.lit(LOGIN))
    if feedback is not None:
        rows = rows.unionByName(feedback.select(*LIVE_COLUMNS, "row_kind"))
    query = rows.writeStream.foreachBatch(score_batches(path, params)).option("checkpointLocation", f"{path}/checkpoint")
    query.trigger(availableNow=True).start().awaitTermination()
    return scores(logins.sparkSession, path)


def scores(spark: SparkSession, path: str) -> DataFrame:
    """All scores so far."""
    return spark.read.parquet(f"{path}/scores").drop("batch")
