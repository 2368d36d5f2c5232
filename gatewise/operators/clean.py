"""Cleaning: one map-only pass that adds normalised columns and flags, never drops a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from gatewise.functions import agents, text

_PRESERVED = {"ts": "raw_ts", "rtt": "raw_rtt", "region": "raw_region", "city": "raw_city"}


def clean(raw: DataFrame, profile: str = "documented", preserve_raw: bool = False) -> DataFrame:
    """Raw text rows to typed clean events.

    ``preserve_raw`` also keeps the original text of the columns that cleaning
    overwrites (time, round-trip time, region, city).
    """
    if profile not in agents.PROFILES:
        raise ValueError(f"unknown profile {profile!r}")
    c = F.col
    # Lower-cased texts and the stripped name are used by many expressions; a
    # select of their own keeps them from being evaluated once per use.
    prepared = raw.select(
        *raw.columns,
        F.lower("ua").alias("ua_lc"),
        F.lower("os").alias("os_lc"),
        text.strip_versions(c("browser")).alias("browser_family"),
        text.is_private_ip(c("ip")).alias("is_private_ip"),
        text.known(c("region")).alias("region_known"),
        text.known(c("city")).alias("city_known"),
    )
    classified = prepared.select(
        "*",
        agents.os_family(c("ua_lc"), c("os_lc"), profile).alias("os_family"),
        agents.device_type(c("ua_lc"), c("device"), profile).alias("device_type"),
    )
    geo = c("is_private_ip")
    if profile == "documented":
        geo = geo | c("region_known").isNull() | c("city_known").isNull()
    extra = [c(a).alias(b) for a, b in _PRESERVED.items()] if preserve_raw else []
    return classified.select(
        text.to_long(c("idx")).alias("row_id"),
        text.to_timestamp_ntz(c("ts")).alias("ts"),
        text.to_long(c("user_id")).alias("user_id"),
        text.rtt_value(c("rtt")).alias("rtt"),
        "ip",
        "country",
        c("region_known").alias("region"),
        c("city_known").alias("city"),
        text.to_long(c("asn")).alias("asn"),
        c("ua").alias("user_agent"),
        c("browser").alias("browser_raw"),
        c("os").alias("os_raw"),
        c("device").alias("device_raw"),
        text.to_flag(c("success")).alias("login_success"),
        text.to_flag(c("attack")).alias("is_attack_ip"),
        text.to_flag(c("ato")).alias("is_ato"),
        "os_family",
        "browser_family",
        "device_type",
        "is_private_ip",
        geo.alias("geo_unreliable"),
        c("rtt").isNull().alias("rtt_missing"),
        text.rtt_is_outlier(c("rtt")).alias("rtt_outlier"),
        agents.ua_os_conflict(c("ua_lc"), c("os_lc"), c("os_family"), profile).alias("ua_os_conflict"),
        (c("browser") != c("browser_family")).alias("version_stripped"),
        agents.generator_bot(c("ua_lc"), profile).alias("is_generator_bot"),
        agents.vlc(c("ua_lc")).alias("is_vlc"),
        *extra,
    )


def observed_clean(raw: DataFrame, profile: str = "documented") -> tuple[DataFrame, Observation, Observation]:
    """``clean`` with row counters on both sides, filled by the job that consumes it.

    The counters cost no extra pass: after the write, ``before.get["rows"]`` and
    ``after.get["rows"]`` must be equal.
    """
    before, after = Observation("rows_before"), Observation("rows_after")
    counted = raw.observe(before, F.count(F.lit(1)).alias("rows"))
    done = clean(counted, profile).observe(after, F.count(F.lit(1)).alias("rows"))
    return done, before, after
