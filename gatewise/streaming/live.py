"""Live path: stored or arriving logins as a stream, scored, alerted and totalled."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gatewise.functions import risk
from gatewise.functions.risk import FEATURES, KINDS, RiskParams
from gatewise.functions.text import micros
from gatewise.operators.scoring import score_events
from gatewise.operators.slots import even_cuts, slotted
from gatewise.session import written
from gatewise.streaming.history import CONFIRM, FACTS, LOGIN, LearnPolicy, LoginHistory
from gatewise.streaming.packed import pack, unpack

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of one user that a replay hands to one micro-batch of the path by user.
SLICE_ROWS = 600_000
#: Rows of a slice that one file holds, so that the tasks which read and clean a slice follow its rows.
FILE_ROWS = 100_000
#: Buckets that users are hashed to; part of the stored state, so a checkpoint is only good for one number.
BUCKETS = 256
LIVE_COLUMNS = ("row_id", "user_id", "ts", "login_success", "is_attack_ip", "is_ato", *KINDS.values())


@dataclass(frozen=True)
class LiveParams:
    """Rules and learning. Late rows are scored but teach nothing."""

    risk: RiskParams = field(default_factory=RiskParams)
    policy: LearnPolicy = field(default_factory=LearnPolicy)


def replay_source(spark: SparkSession, directory: str, schema: T.StructType, pattern: str | None = None,
                  files_per_trigger: int = 1) -> DataFrame:
    """Stored Parquet events as a stream, a bounded number of files per micro-batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(directory)


def user_slices(rows: DataFrame, path: str, user: Column, at: Column, slice_rows: int = SLICE_ROWS) -> int:
    """Store ``rows`` under ``path`` as files for a replay that takes one a trigger; returns their number.

    The path by user holds the rows that a user has in a micro-batch, so a user of more than ``slice_rows`` rows is
    cut in the order of ``at`` (microseconds), a slot a file; rows of one user and one time stay together. State is
    read and written once per user and trigger, so all other users lie whole in one file, dealt by hash. Order between
    users means nothing there. Rows without a time have no history and are dealt to any file.
    """
    return spread_slices(rows, path, user, at, slice_rows, None)[0]


def spread_slices(rows: DataFrame, path: str, user: Column, at: Column, slice_rows: int = SLICE_ROWS,
                  file_rows: int | None = FILE_ROWS) -> tuple[int, int]:
    """:func:`user_slices` with a file per ``file_rows`` rows of a slice; returns the slices and the files of each.

    A trigger must take all files of one slice, so every slice has the same number of them.
    """
    who = F.coalesce(F.concat(F.lit("="), user.cast("string")), F.lit("-"))
    placed = rows.withColumns({"_who": who, "_at": at})
    keys = written(placed.select("_who", "_at"), "keys")
    cuts = written(even_cuts(keys, "_who", "_at", slice_rows), "cuts")
    most = cuts.agg(F.max(F.size("cuts"))).first()[0] or 0
    number = max(most + 1, -(-keys.count() // (4 * slice_rows)))
    any_file = lambda *columns: F.pmod(F.xxhash64(*columns), F.lit(number)).cast("int")
    timed = F.when(F.col("_at").isNotNull(), F.col("_slot"))
    own = F.when(F.col("_slot").isNull(), any_file("_who")).otherwise(F.coalesce(timed, any_file(*rows.columns)))
    dealt = slotted(placed, cuts, "_who", "_at").withColumn("_slice", own).select(*rows.columns, "_slice")
    dealt = dealt.repartition(8 * number, "_slice", F.pmod(F.xxhash64(*rows.columns), F.lit(8)))
    table = written(dealt, "slices", partition_by="_slice")
    files = 1
    if file_rows:  # no file is empty, since rows are dealt in turn
        held = {r["_slice"]: r["count"] for r in table.groupBy("_slice").count().collect()}
        files = max(1, min(held.get(k, 0) for k in range(number)) // file_rows)
    for k in range(number):  # the file source takes files in the order in which they were written
        part = table.where(F.col("_slice") == k).drop("_slice")
        (part.repartition(files) if files > 1 else part.coalesce(1)).write.mode("append").parquet(path)
    return number, files


def confirmations(rows: DataFrame) -> DataFrame:
    """Marks rows as "this was me" feedback instead of logins."""
    return rows.withColumn("row_kind", F.lit(CONFIRM))


def live_facts(logins: DataFrame, params: LiveParams = LiveParams(), feedback: DataFrame | None = None) -> DataFrame:
    """Clean logins (stream) plus what the user's profile held before each of them.

    State is keyed by bucket and user and kept in RocksDB; of a profile with many addresses only a part lies in the
    user's own row, so it is not read as a whole. A bucket is one call, so that users of few logins share its cost.
    Feedback rows travel in the same keyed stream. Every login is scored: one without a time has no history and
    teaches nothing, as in the batch job, and nothing a client sends leads past the state.
    """
    logins.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    rows = logins.select(*LIVE_COLUMNS).withColumn("row_kind", F.lit(LOGIN))
    if feedback is not None:
        rows = rows.unionByName(feedback.select(*LIVE_COLUMNS, "row_kind"))
    rows = rows.withColumn("at_us", micros(F.col("ts")))
    columns = (*LIVE_COLUMNS, "row_kind", "at_us")
    schema = T.StructType([rows.schema[c] for c in columns] + list(FACTS))
    bucket = F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
    packed = rows.select(bucket, *columns).mapInArrow(pack, "bucket int, packed binary")
    told = packed.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=LoginHistory(params.risk, params.policy, columns),
        outputStructType="packed binary", outputMode="Append", timeMode="None",
    )
    # a busy user's answers are one task's; what follows is shared by all cores
    return told.repartition(logins.sparkSession.sparkContext.defaultParallelism).mapInArrow(unpack, schema)


def features_from_facts(facts: DataFrame, params: RiskParams, *further: str) -> DataFrame:
    """The batch features, from facts instead of windows; ``further`` columns are handed on."""
    c = F.col
    made = {
        **risk.calendar(c("ts"), params),
        **risk.history_features(
            now_us=c("at_us"), prior=c("_prior"), seen={k: c(f"_seen_{k}") for k in KINDS},
            last_failure_us=c("_last_failure"), in_burst=c("_in_burst"), today=c("_today_before"),
            same_hour=c("_hour_before"), params=params,
        ),
    }
    return facts.where(c("row_kind") == LOGIN).select(
        *LIVE_COLUMNS, *[made[n].alias(n) for n in FEATURES],
        (c("_prior") > 0).alias("has_history"), c("_learned").alias("learned"), *further,
    )


def live_scores(logins: DataFrame, params: LiveParams = LiveParams(), feedback: DataFrame | None = None) -> DataFrame:
    """Scored stream: features, score, level, decision and reasons per login."""
    return score_events(features_from_facts(live_facts(logins, params, feedback), params.risk), params.risk)


def alerts(scored: DataFrame) -> DataFrame:
    """Events that are not simply allowed, with their reasons in words."""
    return scored.where(F.col("decision") != "allow").select(
        "row_id", "user_id", "ts", "score", "level", "colour", "decision",
        F.array_join("reasons", "; ").alias("reasons"),
    )


def decision_totals(scored: DataFrame, length: str = "1 hour", slide: str | None = None,
                    watermark: str = "10 minutes") -> DataFrame:
    """Allow, challenge and block counts per time window; ``slide`` makes it a sliding one."""
    at = F.col("ts").cast("timestamp")
    timed = scored.select("decision", at.alias("at")).withWatermark("at", watermark)
    window = F.window("at", length, slide) if slide else F.window("at", length)
    return timed.groupBy(window.alias("w"), "decision").agg(F.count(F.lit(1)).alias("events")).select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"), "decision", "events",
    )


def login_sessions(scored: DataFrame, gap: str = "30 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Decision counts per user session closed by ``gap`` of silence.

    For append mode: a session is given once, when the watermark has passed its end, and leaves the state then, so
    the state holds open sessions only. :func:`mark_end` closes the last ones of a replay.
    """
    timed = scored.select("user_id", "decision", F.col("ts").cast("timestamp").alias("at")).withWatermark("at", watermark)
    grouped = timed.groupBy(F.session_window("at", gap).alias("w"), "user_id")
    return grouped.agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("decision") != "allow").alias("not_allowed")
    ).select(
        "user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"),
        F.col("w.end").cast("timestamp_ntz").alias("session_end"), "events", "not_allowed",
    )


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Drain a stream into Parquet under ``path`` and return the table.

    The checkpoint lies beside the data: a rerun continues where the last one ended.
    """
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/data")
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")


def mark_end(spark: SparkSession, path: str, schema: T.StructType, after: str = "1 hour") -> None:
    """Append one row to a replay folder: NULL but for ``ts``, which lies ``after`` the newest time there.

    It moves the watermark behind the end of every session when ``after`` is longer than gap and watermark
    together. Its own session stays open and is never given. Rows that come afterwards are late unless they are newer.
    """
    newest = spark.read.schema(schema).parquet(path).agg((F.max("ts") + F.expr(f"interval {after}")).alias("ts")).where("ts is not null")
    row = [F.col("ts").cast(f.dataType).alias("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    newest.select(*row).coalesce(1).write.mode("append").parquet(path)


def run_counts(stream: DataFrame, path: str) -> DataFrame:
    """Drain an aggregating stream and return the table of its latest counts.

    Complete mode, so groups still open are included and the state keeps them all. Each trigger owns a folder; the last
    one holds the result.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")

    complete = stream.writeStream.outputMode("complete").foreachBatch(write)
    query = complete.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    table = stream.sparkSession.read.parquet(f"{path}/data")
    last = table.agg(F.max("batch").alias("b"))
    return table.where(F.col("batch") == last.scalar()).drop("batch")


def run_upserts(stream: DataFrame, path: str, *keys: str) -> DataFrame:
    """Drain an aggregating stream in update mode and return the latest row per key.

    A trigger writes only groups it changed, into a folder of its own, which a retry overwrites. Groups
    behind the watermark leave the state; what was written of them stays.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")

    changed = stream.writeStream.outputMode("update").foreachBatch(write)
    query = changed.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    table = stream.sparkSession.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/data")
    values = [c for c in stream.columns if c not in keys]
    latest = table.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return latest.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])


def write_profile_deltas(path: str):
    """A ``foreachBatch`` function appending per-user profile changes of one batch.

    Each batch owns a folder and overwrites it on a retry, so a batch counts once.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        delta = batch.groupBy("user_id", "country", "device_type", F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(
            F.count(F.lit(1)).alias("events"), F.count_if(~F.col("login_success")).alias("failures"),
            F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        )
        delta.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def run_profiles(logins: DataFrame, path: str) -> DataFrame:
    """Keep the profile log under ``path`` up to date and return the profiles."""
    query = (
        logins.select("user_id", "country", "device_type", "login_success", "ts").writeStream
        .foreachBatch(write_profile_deltas(f"{path}/deltas"))
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return profiles(logins.sparkSession, path)


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """Current profile per user, merged from the log; filter by ``user_id`` for a lookup.

    ``usual_hour`` is the hour with the most logins (the earliest of equals), ``most_a_day`` the busiest day's count.
    """
    log = spark.read.parquet(f"{path}/deltas")
    base = log.groupBy("user_id").agg(
        F.count_distinct("country").alias("countries"), F.count_distinct("device_type").alias("devices"),
        F.sum("events").alias("events"), F.sum("failures").alias("failures"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.count_distinct("day").alias("days"),
    )
    days = log.groupBy("user_id", "day").agg(F.sum("events").alias("n")).groupBy("user_id").agg(F.max("n").alias("most_a_day"))
    hours = log.groupBy("user_id", "hour").agg(F.sum("events").alias("n")).where("hour is not null")
    hours = hours.groupBy("user_id").agg(F.max_by("hour", F.struct("n", -F.col("hour"))).alias("usual_hour"))
    named = lambda df: df.withColumnRenamed("user_id", "_user")
    same = F.col("user_id").eqNullSafe(F.col("_user"))
    joined = base.join(named(days), same, "left").drop("_user").join(named(hours), same, "left").drop("_user")
    return joined
