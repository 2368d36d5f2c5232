"""Raw login rows derived from the ``events`` table.

``events`` holds no logins, so each event is mapped to one raw login row by
arithmetic on its ids. User 0 receives 45 % of the rows and plays the dominant
account. The agents below are fixed values: edge cases of the classifiers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# ---------------------------------------------------------------- fixed values
# (user agent, browser, os, device)
AGENTS = (
    ("Mozilla/5.0 (iPhone; CPU iPhone OS 13_4 like Mac OS X) Mobile", "Mobile Safari 13.1", "iOS 13.4", "mobile"),
    ("Mozilla/5.0 (Linux; Android 10; SM-G960F) Mobile", "Chrome Mobile 85.0.4183", "Android 10", "mobile"),
    ("Mozilla/5.0 (Windows NT 10.0; Win64; x64)", "Firefox 20.0.0.1618", "Windows 10", "desktop"),
    ("Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_6)", "Safari 13.1", "Mac OS X 10.15.6", "desktop"),
    ("Mozilla/5.0 (X11; Linux x86_64)", "Opera variation/277", "Linux", "desktop"),
    ("Mozilla/5.0 (X11; CrOS x86_64 13099)", "Chrome 84.0", "Chrome OS 13099", "desktop"),
    ("Mozilla/5.0 (Windows Phone 10.0; Android 6.0.1; Lumia 950) like iPhone OS 7 Mobile", "Edge Mobile 15", "Windows Phone 10.0", "mobile"),
    ("AwarioSmartBot/1.0", "AwarioSmartBot 1.0", "iOS 2.3", "bot"),
    ("Mozilla/5.0 (Mobile; Nokia 8110 4G) KAIOS/2.5", "Firefox 48.0", "KaiOS 2.5", "mobile"),
    ("Mozilla/5.0 (Linux; Andorid 9) Mobile", "Android 2.3.3.2672", "iOS 7.1", "mobile"),
    ("Mozilla/5.0 (Linux; Android 9; SM-T510)", "Chrome 85.0", "Android 9", "mobile"),
    ("Mozilla/5.0 (iPad; CPU OS 13_4 like Mac OS X) Mobile", "Mobile Safari 13.1", "iOS 13.4", "tablet"),
    ("VLC/3.0.0-git LibVLC/3.0.0-git", "VLC 3.0.0-git", "Other ", "desktop"),
    ("ZipppBot/0.11 (das-group)", "ZipppBot 0.11", "Other ", "bot"),
    ("Roku/DVP", "Roku 9.10", "Roku 9.10", None),
    ("Mozilla/5.0 (Linux; Android 9) CriOS/84 Mobile", "Unknown Mac OS X 11_6_3 Browser", "Android 9", "unknown"),
)
# ----------------------------------------------------------- end fixed values


def _agent_table():
    """The agents as one constant array, so picking one needs no join."""
    fields = ("ua", "browser", "os", "device")
    return F.array(
        *[
            F.struct(*[F.lit(v).cast("string").alias(f) for f, v in zip(fields, row)])
            for row in AGENTS
        ]
    )


def logins_from_events(events: DataFrame) -> DataFrame:
    """Map rows of the ``events`` table (batch or stream) to raw login rows."""
    c = F.col
    eid = c("event_id")
    keyed = events.select(
        "event_id", "ts", "event_type",
        F.when(eid % 20 < 9, F.lit(0).cast("bigint")).otherwise(c("user_id") + 1).alias("uid"),
    )
    keyed = keyed.select(
        "*",
        F.when(eid % 9 == 0, eid % 40).otherwise(1 + c("uid") % 7).alias("d"),
        ((c("uid") + F.when(eid % 13 == 0, eid).otherwise(0)) % 16).alias("k"),
    )
    keyed = keyed.select("*", F.element_at(_agent_table(), (c("k") + 1).cast("int")).alias("a"))
    block = c("uid") % 4
    prefix = (
        F.when(block == 0, "10.0.").when(block == 1, "84.210.").when(block == 2, "172.20.").otherwise("172.40.")
    )
    failed = c("event_type") == "error"
    return keyed.select(
        eid.cast("string").alias("idx"),
        c("ts").cast("string").alias("ts"),
        c("uid").cast("string").alias("user_id"),
        F.when(eid % 25 == 0, ((eid * 7919) % 90000).cast("string")).alias("rtt"),
        F.concat(prefix, (c("uid") % 50).cast("string"), F.lit("."), c("d").cast("string")).alias("ip"),
        F.when(eid % 23 == 0, "US").when(c("uid") % 5 == 4, "SE").otherwise("NO").alias("country"),
        F.when(eid % 4 == 0, "-").when(eid % 11 == 0, F.lit(None).cast("string")).otherwise("Oslo").alias("region"),
        F.when(eid % 8 == 0, "-").otherwise("Oslo").alias("city"),
        (29695 + c("uid") % 3 + F.when(eid % 23 == 0, 100).otherwise(0)).cast("string").alias("asn"),
        c("a.ua").alias("ua"),
        c("a.browser").alias("browser"),
        c("a.os").alias("os"),
        c("a.device").alias("device"),
        F.when(failed, "False").otherwise("True").alias("success"),
        F.when(c("d") % 10 == 8, "True").otherwise("False").alias("attack"),
        F.when(~failed & (eid % 499 == 8), "True").otherwise("False").alias("ato"),
    )


def read_logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw login rows over the whole ``events`` table."""
    return logins_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
