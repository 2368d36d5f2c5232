"""Whole-user sampling, row caps and train/test splits, all reproducible by hash."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gatewise.functions.text import micros, seeded_hash
from gatewise.operators.features import FeatureParams, heavy_users
from gatewise.operators.scoring import gold_label
from gatewise.session import cut_lineage

_HASH_SPACE_BITS = 32


@dataclass(frozen=True)
class SampleSpec:
    """Caps are given values; quotas, seed and the robot share are ours."""

    seed: str = "gatewise"
    user_cap: int = 10_000
    robot_cap: int = 50_000
    robot_share: float = 0.2
    heavy_attacks: int = 10
    keep_percent: tuple[tuple[str, int], ...] = (
        ("robot", 100), ("ato", 100), ("heavy", 100), ("light", 50), ("normal", 20),
    )
    drop_genbots: bool = False
    drop_vlc: bool = False
    params: FeatureParams = field(default_factory=FeatureParams)


def user_tiers(events: DataFrame, spec: SampleSpec = SampleSpec()) -> DataFrame:
    """One row per user: counts and tier (robot, ato, heavy, light or normal)."""
    c = F.col
    total = events.agg(F.count(F.lit(1)).alias("n"))
    users = events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("user_rows"),
        F.count_if("is_attack_ip").alias("attacks"),
        F.count_if("is_ato").alias("atos"),
    )
    tier = (
        F.when(c("user_rows") > total.scalar() * F.lit(spec.robot_share), "robot")
        .when(c("atos") > 0, "ato")
        .when(c("attacks") >= spec.heavy_attacks, "heavy")
        .when(c("attacks") > 0, "light")
        .otherwise("normal")
    )
    return users.withColumn("tier", tier)


def sample_users(tiers: DataFrame, spec: SampleSpec = SampleSpec()) -> DataFrame:
    """The chosen users: a seeded hash of the user id under the tier's quota."""
    quota = None
    for tier, percent in spec.keep_percent:
        quota = F.when(F.col("tier") == tier, percent) if quota is None else quota.when(F.col("tier") == tier, percent)
    return tiers.where(seeded_hash(spec.seed, _user_key()) % 100 < quota)


def _user_key() -> Column:
    """The user id as text; rows without one are a user of their own."""
    return F.coalesce(F.col("user_id").cast("string"), F.lit("<null>"))


def take_smallest(df: DataFrame, key: str, quota: Column, order: Column, bucket: Column) -> DataFrame:
    """Exactly the ``quota`` rows with the smallest ``order`` of every key, without
    ranking a whole key.

    ``bucket`` must grow with ``order``. A histogram per (key, bucket) finds the one
    bucket in which the quota is reached; lower buckets are kept whole and only
    that bucket is ranked. Meant for few keys with many rows each: the table of
    cuts has one row per key and is broadcast, so the caller bounds the keys.
    """
    c = F.col
    marked = df.withColumn("_b", bucket).withColumn("_o", order).withColumn("_q", quota)
    hist = marked.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("n"), F.max("_q").alias("q"))
    earlier = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    cuts = (
        hist.withColumn("taken", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .where((c("taken") < c("q")) & (c("taken") + c("n") >= c("q")))
        .select(c(key).alias("_key"), c("_b").alias("_cut"), (c("q") - c("taken")).alias("_left"))
    )
    cuts = cut_lineage(cuts)
    joined = marked.join(F.broadcast(cuts), c(key).eqNullSafe(c("_key")), "left")
    whole = joined.where(c("_cut").isNull() | (c("_b") < c("_cut")))
    edge = (
        joined.where(c("_b") == c("_cut"))
        .withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy("_o", "row_id")))
        .where(c("_rank") <= c("_left"))
    )
    return whole.select(*df.columns).union(edge.select(*df.columns))


def sample_events(events: DataFrame, spec: SampleSpec = SampleSpec()) -> DataFrame:
    """Rows of the chosen users with their tier, capped per user.

    Account-takeover rows all stay and count towards the cap; the rest follows in hash
    order. Ordinary users are ranked by a window; heavy users go through the histogram
    cut, so no task ever ranks a dominant account. Rows without a user id are one user.
    """
    c = F.col
    if spec.drop_genbots:
        events = events.where(~F.coalesce(c("is_generator_bot"), F.lit(False)))
    if spec.drop_vlc:
        events = events.where(~F.coalesce(c("is_vlc"), F.lit(False)))
    heavy = heavy_users(events, spec.params).select("heavy_user")
    is_heavy = c("user_id").eqNullSafe(c("heavy_user"))
    chosen = sample_users(user_tiers(events, spec), spec).select(c("user_id").alias("_chosen"), "tier", "atos")
    is_chosen = c("user_id").eqNullSafe(c("_chosen"))
    quota = F.when(c("tier") == "robot", spec.robot_cap).otherwise(spec.user_cap)
    urgent = F.coalesce(c("is_ato"), F.lit(False))
    order = F.when(urgent, -1).otherwise(seeded_hash(spec.seed, c("row_id")))

    light = events.join(F.broadcast(heavy), is_heavy, "left_anti").join(chosen, is_chosen)
    rank = F.row_number().over(W.partitionBy("user_id").orderBy("_order", "row_id"))
    light = light.withColumn("_order", order).withColumn("_rank", rank).where((c("_rank") <= quota) | urgent)

    hot_users = chosen.join(F.broadcast(heavy), c("_chosen").eqNullSafe(c("heavy_user")), "left_semi")
    hot = events.join(F.broadcast(cut_lineage(hot_users)), is_chosen)
    # takeover rows need no rank; what they leave of the cap goes to the others.
    # 2**16 buckets: the edge bucket holds about 1/65536 of a heavy user
    rest = hot.where(~urgent & (quota > c("atos")))
    rest = take_smallest(rest, "user_id", quota - c("atos"), order, F.shiftright(order, _HASH_SPACE_BITS - 16))
    cols = [*events.columns, "tier"]
    return light.select(*cols).unionByName(hot.where(urgent).select(*cols)).unionByName(rest.select(*cols))


def sample_shares(sample: DataFrame) -> DataFrame:
    """Realised size of a sample."""
    return sample.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("user_id").alias("users"),
        F.count_if("is_attack_ip").alias("attack_rows"),
        F.count_if(gold_label()).alias("gold_rows"),
        F.count_if("is_ato").alias("ato_rows"),
        F.avg(F.when(F.col("is_attack_ip"), 1.0).otherwise(0.0)).alias("attack_share"),
    )


def split_by_user(events: DataFrame, train_percent: int = 80, seed: str = "split") -> DataFrame:
    """Adds ``fold``: all rows of a user are on the same side."""
    return events.withColumn(
        "fold", F.when(seeded_hash(seed, F.col("user_id")) % 100 < train_percent, "train").otherwise("test")
    )


def split_by_time(events: DataFrame, train_share: float = 0.8) -> DataFrame:
    """Adds ``fold`` with one cut in time for everybody.

    The cut is the first full hour before which at least ``train_share`` of the
    rows lie; it comes from a histogram of hours, not from sorting the events. Rows
    without a time are on neither side; their fold is ``untimed``.
    """
    c = F.col
    hours = events.where(c("ts").isNotNull()).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # one row per hour of the data set: a single ordered window over it is small
    upto = W.orderBy("h").rowsBetween(W.unboundedPreceding, 0)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cut = (
        hours.select("h", F.sum("n").over(upto).alias("upto"), F.sum("n").over(everything).alias("total"))
        .where(c("upto") >= c("total") * train_share)
        .agg(F.min("h").alias("h"))
    )
    last_hour = cut.select(c("h") + F.expr("interval 1 hour"))
    fold = F.when(c("ts").isNull(), "untimed").when(c("ts") < last_hour.scalar(), "train").otherwise("test")
    return events.withColumn("fold", fold)


def split_within_user(counted: DataFrame, train_share: float = 0.8) -> DataFrame:
    """Adds ``fold``: the earliest share of every user's own events is the train side.

    Takes feature rows made with ``keep_counts``: the rank of an event is its number
    of earlier events, which the feature job already has without ranking a user.
    """
    return counted.withColumn(
        "fold", F.when(F.col("prior_events") < F.col("user_rows") * train_share, "train").otherwise("test")
    )


def robot_arms(sample: DataFrame) -> DataFrame:
    """Every row under arm ``with_robot``, and again under ``without_robot`` unless it is one."""
    arms = F.array_compact(
        F.array(F.lit("with_robot"), F.when(F.col("tier") != "robot", F.lit("without_robot")))
    )
    return sample.withColumn("arm", F.explode(arms))


def users_on_both_sides(folds: DataFrame) -> DataFrame:
    """Users with events in train, in test and in both."""
    per_user = folds.groupBy("user_id").agg(
        F.bool_or(F.col("fold") == "train").alias("in_train"),
        F.bool_or(F.col("fold") == "test").alias("in_test"),
    )
    return per_user.agg(
        F.count_if("in_train").alias("train_users"),
        F.count_if("in_test").alias("test_users"),
        F.count_if(F.col("in_train") & F.col("in_test")).alias("shared_users"),
    )
