"""Schemas of raw, clean and normalised login events."""

from __future__ import annotations

from pyspark.sql import types as T

# Positional raw columns: everything arrives as text and is cast while cleaning.
RAW_COLUMNS = (
    "idx", "ts", "user_id", "rtt", "ip", "country", "region", "city",
    "asn", "ua", "browser", "os", "device", "success", "attack", "ato",
)
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])

CLEAN_SCHEMA = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("rtt", T.DoubleType()),
        T.StructField("ip", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("asn", T.LongType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("browser_raw", T.StringType()),
        T.StructField("os_raw", T.StringType()),
        T.StructField("device_raw", T.StringType()),
        T.StructField("login_success", T.BooleanType()),
        T.StructField("is_attack_ip", T.BooleanType()),
        T.StructField("is_ato", T.BooleanType()),
        T.StructField("os_family", T.StringType()),
        T.StructField("browser_family", T.StringType()),
        T.StructField("device_type", T.StringType()),
        T.StructField("is_private_ip", T.BooleanType()),
        T.StructField("geo_unreliable", T.BooleanType()),
        T.StructField("rtt_missing", T.BooleanType()),
        T.StructField("rtt_outlier", T.BooleanType()),
        T.StructField("ua_os_conflict", T.BooleanType()),
        T.StructField("version_stripped", T.BooleanType()),
        T.StructField("is_generator_bot", T.BooleanType()),
        T.StructField("is_vlc", T.BooleanType()),
    ]
)

# Keys carried along with the behavioural features.
FEATURE_KEYS = ("row_id", "user_id", "ts", "login_success", "is_attack_ip", "is_ato", "ip", "country", "asn",
                "device_type", "os_family", "browser_family")


def feature_schema(names: tuple[str, ...]) -> T.StructType:
    """The feature table: keys, the named features and whether the user had a history."""
    kinds = {"hour": T.IntegerType(), "rapid_login_rate": T.LongType(), "login_frequency_today": T.LongType()}
    made = [T.StructField(n, kinds.get(n, T.BooleanType())) for n in (*names, "has_history")]
    return T.StructType([CLEAN_SCHEMA[k] for k in FEATURE_KEYS] + made)


# One authentication event, whatever system logged it.
NORMALIZED_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("device", T.StringType()),
        T.StructField("browser", T.StringType()),
        T.StructField("os", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("auth_source", T.StringType()),
    ]
)


def same_columns(actual: T.StructType, expected: T.StructType) -> list[str]:
    """Differences in name, order or type; nullability is ignored."""
    have = [(f.name, f.dataType.simpleString()) for f in actual.fields]
    want = [(f.name, f.dataType.simpleString()) for f in expected.fields]
    missing = [f"missing {n}:{t}" for n, t in want if (n, t) not in have]
    extra = [f"unexpected {n}:{t}" for n, t in have if (n, t) not in want]
    order = ["column order"] if not missing and not extra and have != want else []
    return missing + extra + order
