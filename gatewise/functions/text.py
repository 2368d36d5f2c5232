"""Null-on-failure casts and text clean-up as column expressions.

Every cast of raw text uses ``try_cast``: ANSI mode would otherwise fail the job
on the first bad cell.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Outlier bound of the round-trip time in milliseconds (fixed value).
RTT_LIMIT_MS = 60000.0

_TS_SHAPE = r"^\s*\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?\s*\z"

# A blank-delimited token that is only a version, e.g. 85.0.4183, 11_6_3,
# 3.0.0-git or variation/277, with the blanks before it.
_VERSION_TOKEN = r"(?i)(?:^| +)(?:[0-9]++(?:[._-][0-9]++)*+(?:-git)?|variation/[0-9]++)(?![^ ])"


def to_long(text: Column) -> Column:
    """Text to bigint; fractions round half away from zero, exponents are accepted."""
    # a plain integer never reaches the decimal arithmetic
    wide = F.round(text.try_cast("decimal(38,18)")).try_cast("bigint")
    return F.coalesce(text.try_cast("bigint"), wide)


def to_timestamp_ntz(text: Column) -> Column:
    """``Y-M-D h:m:s`` with up to six fraction digits; anything else is NULL."""
    return F.when(text.rlike(_TS_SHAPE), text.try_cast("timestamp_ntz"))


def to_flag(text: Column) -> Column:
    """Case-sensitive ``True``; NULL stays NULL."""
    return text == F.lit("True")


def known(text: Column) -> Column:
    """Both conventions for a missing place name, empty and ``-``, become NULL."""
    return F.when(~text.isin("", "-"), text)


def to_double(text: Column) -> Column:
    """Text to double; a type suffix as in ``1d`` or ``1.5f``, which a cast would take, is no number."""
    return F.when(~text.rlike(r"(?i)[0-9.][df]\s*\z"), text.try_cast("double"))


def rtt_value(text: Column) -> Column:
    """Milliseconds; empty, unparsable and above the outlier bound are NULL."""
    ms = to_double(text)
    return F.when(ms <= RTT_LIMIT_MS, ms)


def rtt_is_outlier(text: Column) -> Column:
    """FALSE for missing text, NULL for text that is not a number."""
    return text.isNotNull() & (to_double(text) > RTT_LIMIT_MS)


def strip_versions(name: Column) -> Column:
    """Browser name without version tokens; a versions-only name becomes ``''``."""
    left = F.trim(F.regexp_replace(name, _VERSION_TOKEN, ""))
    return F.when(left.contains("  "), F.regexp_replace(left, " {2,}", " ")).otherwise(left)


def is_private_ip(ip: Column) -> Column:
    """RFC 1918, loopback and link-local by prefix; NULL in, NULL out."""
    plain = (
        ip.startswith("10.") | ip.startswith("127.")
        | ip.startswith("192.168.") | ip.startswith("169.254.")
    )
    return plain | (ip.startswith("172.") & ip.rlike(r"^172\.(1[6-9]|2[0-9]|3[01])\."))


def is_ipv4(ip: Column) -> Column:
    """Four decimal octets, each at most 255."""
    octet = r"(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return ip.rlike(rf"^{octet}(\.{octet}){{3}}\z")


def seeded_hash(seed: str, value: Column) -> Column:
    """First 32 bits of md5 as a bigint; the same in every engine that has md5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), value.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zone-less timestamp (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))
