"""Behavioural features from strictly earlier events of the same user.

Shape of the job
----------------
One user may own almost half of all events, so a window per user is not an
option. Users above a row limit are *heavy*: their timeline is cut into slots,
and what earlier slots contribute is handed to each slot as a few *carry rows*.
Windows then run per (user, slot):

1. ``heavy_users``   counts per user -> at most ``1 / max_heavy_share`` users,
                     each with a slot width chosen from its busiest hour;
2. ``_carry_rows``   per slot: counts so far, last failure, and the first time
                     of every value that occurs in the slot but was seen before;
3. one exchange of the event table on (user, slot), then local sorts only, with as
   many tasks as keep ``task_rows`` events each: the sorts add up in a task's memory.

Every count is a running sum. The number of events in the last minute is the
running sum of +1 at an event and -1 a minute later; a sliding frame would
re-add the whole minute for each row of a busy account.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gatewise.functions.risk import FEATURES, KINDS, RiskParams, calendar, history_features
from gatewise.functions.text import micros
from gatewise.session import cut_lineage

_HOUR_US = 3600 * 1_000_000
# Slot widths in seconds. All divide an hour, so a slot lies in one hour and one day.
_SLOT_SECONDS = (3600, 1800, 900, 600, 300, 120, 60, 30, 10, 5, 1)
# Row codes; a carried value has the code of its kind.
_EVENT, _EXPIRY, _STATE = 0, 1, 2
_CARRIED = {kind: 3 + i for i, kind in enumerate(KINDS)}


@dataclass(frozen=True)
class FeatureParams:
    """``slot_rows``: rows of one user that one task may hold.
    ``max_heavy_share``: bounds the broadcast list of heavy users to its inverse.
    ``task_rows``: events that a task of the windows gets on average.
    """

    risk: RiskParams = field(default_factory=RiskParams)
    slot_rows: int = 1_000_000
    max_heavy_share: float = 1 / 50_000
    task_rows: int = 100_000


def heavy_users(events: DataFrame, params: FeatureParams = FeatureParams()) -> DataFrame:
    """Users whose rows exceed the limit: (heavy_user, user_rows, slot_us).

    The limit is at least ``max_heavy_share`` of all rows, so the result holds at
    most ``1 / max_heavy_share`` rows whatever the size of the data. It is written
    to the checkpoint folder because every branch of the feature job joins it.
    """
    total = events.agg(F.count(F.lit(1)).alias("n"))
    limit = F.greatest(F.lit(float(params.slot_rows)), total.scalar() * F.lit(params.max_heavy_share))
    big = (
        events.groupBy("user_id").agg(F.count(F.lit(1)).alias("user_rows"))
        .where(F.col("user_rows") > limit)
        .select(F.col("user_id").alias("heavy_user"), "user_rows")
    )
    hours = (
        events.select("user_id", F.date_trunc("hour", "ts").alias("h"))
        .join(F.broadcast(big), F.col("user_id").eqNullSafe(F.col("heavy_user")))
        .groupBy("heavy_user", "user_rows", "h").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("heavy_user", "user_rows").agg(F.max("n").alias("peak"))
    )
    width = F.lit(_SLOT_SECONDS[-1])
    for seconds in reversed(_SLOT_SECONDS[:-1]):
        width = F.when(F.col("peak") * seconds / 3600 <= limit, F.lit(seconds)).otherwise(width)
    heavy = hours.select("heavy_user", "user_rows", (width.cast("bigint") * 1_000_000).alias("slot_us"))
    return cut_lineage(heavy)


def _slot(us: Column) -> Column:
    """Start of the slot, NULL for users that need none.

    Heavy users' rows without a time have no history; they are spread by row id.
    """
    width = F.col("slot_us")
    untimed = -1 - F.pmod(F.xxhash64("row_id"), F.lit(4096))
    return F.when(width.isNotNull(), F.coalesce(us - F.pmod(us, width), untimed))


def _place(events: DataFrame, heavy: DataFrame) -> DataFrame:
    timed = events.withColumn("_us", micros(F.col("ts")))
    return (
        timed.join(F.broadcast(heavy), F.col("user_id").eqNullSafe(F.col("heavy_user")), "left")
        .drop("heavy_user")
        .withColumn("_slot", _slot(F.col("_us")))
        .withColumn("_failed_us", F.when(~F.col("login_success"), F.col("_us")))
    )


def _expiry_slot(burst_us: int) -> Column:
    later = F.col("_us") + burst_us
    return F.when(F.col("slot_us").isNotNull(), later - F.pmod(later, F.col("slot_us")))


def _carry_rows(placed: DataFrame, params: FeatureParams) -> DataFrame:
    """What earlier slots of heavy users contribute to each of their slots."""
    c = F.col
    hot = placed.where(c("slot_us").isNotNull() & c("_us").isNotNull())
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    arrivals = hot.select("user_id", "_slot", one.alias("n"), zero.alias("gone"), "_failed_us")
    expiries = hot.select(
        "user_id", _expiry_slot(params.risk.burst_us).alias("_slot"),
        zero.alias("n"), one.alias("gone"), F.lit(None).cast("bigint").alias("_failed_us"),
    )
    slots = arrivals.union(expiries).groupBy("user_id", "_slot").agg(
        F.sum("n").alias("n"), F.sum("gone").alias("gone"), F.max("_failed_us").alias("_failed_us")
    )
    at = F.timestamp_micros("_slot")
    slots = slots.withColumn("_date", F.to_date(at)).withColumn("_hour", F.hour(at))
    earlier = W.partitionBy("user_id").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)

    def so_far(expr: Column, *within: str) -> Column:
        win = W.partitionBy("user_id", *within).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum(expr).over(win), zero)

    state = slots.select(
        "user_id", "_slot", "_date", "_hour",
        F.lit(_STATE).alias("_row"),
        (c("_slot") - 1).alias("_us"),
        so_far(c("n")).alias("_n"),
        so_far(c("n") - c("gone")).alias("_alive"),
        F.max("_failed_us").over(earlier).alias("_failed_us"),
        # events before the slot's day began
        (so_far(c("n")) - so_far(c("n"), "_date")).alias("_before_day"),
        so_far(c("n"), "_hour").alias("_same_hour"),
    )

    types = {f.name: f.dataType for f in placed.schema.fields}
    pairs = F.array(*[
        F.struct(F.lit(_CARRIED[kind]).alias("kind"), c(col).cast("string").alias("value"))
        for kind, col in KINDS.items()
    ])
    firsts = (
        hot.select("user_id", "_slot", "_us", F.explode(pairs).alias("p"))
        .groupBy("user_id", "_slot", c("p.kind").alias("_row"), c("p.value").alias("_value"))
        .agg(F.min("_us").alias("here"))
    )
    # at most one row per slot in a group of this window
    ever = F.min("here").over(W.partitionBy("user_id", "_row", "_value"))
    known = (
        firsts.withColumn("_us", ever).where(c("_us") < c("here"))
        .select(
            "user_id", "_slot", "_row", "_us",
            *[F.when(c("_row") == _CARRIED[k], c("_value")).cast(types[col]).alias(col) for k, col in KINDS.items()],
        )
    )
    return state.unionByName(known, allowMissingColumns=True)


def _dealt(rows: DataFrame, events: DataFrame, params: FeatureParams) -> DataFrame:
    """``rows`` in tasks of at most about ``task_rows`` events.

    Left alone, tasks grow with the table: Spark keeps to the session's number of shuffle
    partitions and merges them up to a size in compressed bytes, many times as large in the
    sorts. A table of one such task is left alone; a larger one is dealt to all cores at least.
    """
    tasks = -(-events.count() // params.task_rows)
    if tasks <= 1:
        return rows
    tasks = max(tasks, events.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(tasks, "_group")


def behaviour_features(
    events: DataFrame, params: FeatureParams = FeatureParams(), keep_counts: bool = False
) -> DataFrame:
    """All columns of ``events`` plus the features and ``has_history``.

    ``events`` needs the clean columns of ``KINDS`` and row_id, user_id, ts,
    login_success. Select only the columns you want before the call: the whole
    row travels through the one exchange. ``keep_counts`` adds ``prior_events``
    and ``user_rows`` (total rows of the user).
    """
    c = F.col
    placed = _place(events, heavy_users(events, params))
    counts = F.when(c("_us").isNotNull(), 1).otherwise(0).cast("bigint")
    arrivals = placed.select(
        *events.columns, "_us", "_slot", "_failed_us", "user_rows",
        F.lit(_EVENT).alias("_row"),
        F.to_date("ts").alias("_date"), F.hour("ts").alias("_hour"),
        counts.alias("_n"), counts.alias("_alive"), counts.alias("_same_hour"),
    )
    later = c("_us") + params.risk.burst_us
    expiries = placed.where(c("_us").isNotNull()).select(
        "user_id", _expiry_slot(params.risk.burst_us).alias("_slot"), later.alias("_us"),
        F.lit(_EXPIRY).alias("_row"), F.to_date(F.timestamp_micros(later)).alias("_date"),
        F.lit(-1).cast("bigint").alias("_alive"),
    )
    rows = arrivals.unionByName(expiries, allowMissingColumns=True).unionByName(
        _carry_rows(placed, params), allowMissingColumns=True
    ).withColumn("_group", F.xxhash64("user_id", "_slot"))
    rows = _dealt(rows, events, params)

    # A hash leads every partition key: Spark's sorter compares the first eight bytes of
    # a row before anything else, and a dominant user's rows all agree on the user id.
    # The plain columns follow, so two groups with one hash stay apart.
    group = W.partitionBy("_group", "user_id", "_slot")
    before = group.orderBy("_us").rangeBetween(W.unboundedPreceding, -1)
    swept = rows.select(
        *rows.columns,
        F.sum("_n").over(before).alias("_prior"),
        F.sum("_alive").over(before).alias("_in_burst"),
        F.max("_failed_us").over(before).alias("_last_failure"),
        F.lag("_date").over(group.orderBy("_us")).alias("_last_date"),
    )
    # The day only moves forward in this order: today's count is the running count minus
    # its value at the day's first row, and needs no sort by day.
    opens = F.coalesce(c("_prior"), F.lit(0))
    day_start = F.when(c("_row") == _STATE, c("_before_day")).when(
        ~c("_date").eqNullSafe(c("_last_date")), opens
    )
    running = group.orderBy("_us").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = swept.withColumn("_opened", day_start).withColumn(
        "_today_before", opens - F.last("_opened", ignorenulls=True).over(running)
    ).where(c("_row") != _EXPIRY).drop("_last_date", "_opened", "_n", "_alive", "_failed_us", "_before_day", "_date")
    by_hour = W.partitionBy("_group", "user_id", "_slot", "_hour").orderBy("_us")
    swept = swept.withColumn(
        "_hour_before", F.sum("_same_hour").over(by_hour.rangeBetween(W.unboundedPreceding, -1))
    ).where(c("_row") != _STATE).drop("_same_hour", "_hour")
    for kind, col in KINDS.items():
        counted = F.when((c("_row") == _EVENT) | (c("_row") == _CARRIED[kind]), c("_us"))
        value = W.partitionBy("_key", "_group", "user_id", "_slot", col)
        swept = swept.withColumn("_key", F.xxhash64("_group", col)).withColumn(f"_first_{kind}", F.min(counted).over(value))
    if keep_counts:
        in_slot = F.count_if(c("_row") == _EVENT).over(group)
        swept = swept.withColumn("user_rows", F.coalesce(c("user_rows"), in_slot))

    made = {
        **calendar(c("ts"), params.risk),
        **history_features(
            now_us=c("_us"), prior=c("_prior"),
            seen={k: c("_us") > c(f"_first_{k}") for k in KINDS},
            last_failure_us=c("_last_failure"), in_burst=c("_in_burst"),
            today=c("_today_before"), same_hour=c("_hour_before"), params=params.risk,
        ),
    }
    extra = [F.coalesce(c("_prior"), F.lit(0)).alias("prior_events"), c("user_rows")] if keep_counts else []
    return swept.where(c("_row") == _EVENT).select(
        *events.columns,
        *[made[name].alias(name) for name in FEATURES],
        F.coalesce(c("_us").isNotNull() & (c("_prior") > 0), F.lit(False)).alias("has_history"),
        *extra,
    )


def seen_values(events: DataFrame, kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """Per user, kind and value: first time seen and number of events (long form)."""
    pairs = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(KINDS[k]).cast("string").alias("value")) for k in kinds
    ])
    return (
        events.select("user_id", "ts", F.explode(pairs).alias("p"))
        .groupBy("user_id", F.col("p.kind").alias("kind"), F.col("p.value").alias("value"))
        .agg(F.min("ts").alias("first_seen"), F.count(F.lit(1)).alias("events"))
    )


def user_baselines(events: DataFrame, with_maps: bool = False) -> DataFrame:
    """One row per user over all events.

    Two levels: the first collapses a heavy user's rows on the map side to its
    distinct (country, device) pairs. ``with_maps`` adds value -> first-seen maps,
    only for country and device, whose value sets are small by nature.
    """
    c = F.col
    pairs = events.groupBy("user_id", "country", "device_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~c("login_success")).alias("failed"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    base = pairs.groupBy("user_id").agg(
        F.count_distinct("country").alias("countries"),
        F.count_distinct("device_type").alias("devices"),
        F.sum("n").alias("events"),
        F.sum("failed").alias("failures"),
        F.min("first_ts").alias("first_seen"),
        F.max("last_ts").alias("last_seen"),
    )
    if not with_maps:
        return base
    for name, col in (("known_countries", "country"), ("known_devices", "device_type")):
        known = (
            pairs.where(c(col).isNotNull()).groupBy("user_id", col).agg(F.min("first_ts").alias("f"))
            .groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct(col, "f"))).alias(name))
        )
        base = base.join(known, "user_id", "left")
    return base
