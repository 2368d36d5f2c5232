"""Authentication logs of seven systems to one nine-column event.

Every reader takes a DataFrame with one text column ``value`` (one log record per
row, as ``spark.read.text`` gives it) and stays in built-in functions. Records that
are not logins give no row; :func:`rejects` tells which and why, so records in are logins plus rejects.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gatewise.functions import agents
from gatewise.schema import NORMALIZED_SCHEMA

_V = "value"


def _normalized(df: DataFrame, source: str, **given: Column) -> DataFrame:
    cols = []
    for field in NORMALIZED_SCHEMA.fields:
        expr = F.lit(source) if field.name == "auth_source" else given.get(field.name, F.lit(None))
        cols.append(expr.cast(field.dataType).alias(field.name))
    return df.select(*cols)


def _iso(text: Column) -> Column:
    """ISO 8601 in UTC to a zone-less timestamp."""
    return F.regexp_replace(F.regexp_replace(text, "T", " "), r"Z\z", "").try_cast("timestamp_ntz")


def _blank(text: Column) -> Column:
    return F.when(~text.isin("", "-"), text)


def web_logins(lines: DataFrame) -> DataFrame:
    """JSON of a web application's login endpoint."""
    shape = "user string, time string, ip string, country string, device string, browser string, os string, status string"
    j = lines.select(F.from_json(_V, shape).alias("j")).where("j.user is not null")
    return _normalized(
        j, "web", user_id=F.col("j.user"), ts=_iso(F.col("j.time")), source_ip=F.col("j.ip"),
        country=F.col("j.country"), device=F.col("j.device"), browser=F.col("j.browser"), os=F.col("j.os"),
        success=F.col("j.status") == "success",
    )


_SSH = (
    r"^([A-Z][a-z]{2}) +(\d{1,2}) (\d{2}:\d{2}:\d{2}) \S+ sshd(?:\[\d+\])?: "
    r"(Accepted|Failed) \S+ for (?:invalid user )?(\S+) from (\S+) port \d+"
)
_MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def ssh_logins(lines: DataFrame, year: int) -> DataFrame:
    """Syslog lines of the SSH daemon; syslog carries no year, so it is a parameter."""
    part = lambda i: F.regexp_extract(_V, _SSH, i)
    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), part(1))
    when = F.concat(F.lit(f"{year}-"), month.cast("string"), F.lit("-"), part(2), F.lit(" "), part(3))
    rows = lines.where(F.col(_V).rlike(_SSH))
    return _normalized(
        rows, "ssh", user_id=part(5), ts=when.try_cast("timestamp_ntz"), source_ip=part(6),
        success=part(4) == "Accepted",
    )


def directory_logins(lines: DataFrame) -> DataFrame:
    """Windows security events as JSON: 4624 is a logon, 4625 a failed one."""
    shape = ("EventID int, TimeCreated string, "
             "EventData struct<TargetUserName: string, IpAddress: string, WorkstationName: string>")
    j = lines.select(F.from_json(_V, shape).alias("j")).where("j.EventID in (4624, 4625)")
    return _normalized(
        j, "active_directory", user_id=F.col("j.EventData.TargetUserName"), ts=_iso(F.col("j.TimeCreated")),
        source_ip=_blank(F.col("j.EventData.IpAddress")), device=_blank(F.col("j.EventData.WorkstationName")),
        os=F.lit("Windows"), success=F.col("j.EventID") == 4624,
    )


def _pair(key: str) -> Column:
    """The value of a ``key=value`` line, quoted or not."""
    quoted = F.regexp_extract(_V, rf'(?:^| ){key}="([^"]*)"', 1)
    bare = F.regexp_extract(_V, rf'(?:^| ){key}=([^" ]+)', 1)
    return F.nullif(F.concat(quoted, bare), F.lit(""))


def vpn_logins(lines: DataFrame) -> DataFrame:
    """``key=value`` lines of a VPN gateway; values may be quoted."""
    field = _pair
    rows = lines.where(field("action").isin("tunnel-up", "ssl-login-fail"))
    return _normalized(
        rows, "vpn", user_id=field("user"), source_ip=field("remip"), country=field("srccountry"),
        ts=F.concat_ws(" ", field("date"), field("time")).try_cast("timestamp_ntz"),
        success=field("action") == "tunnel-up",
    )


def _agent_columns(ua: Column) -> dict[str, Column]:
    lowered = F.lower(ua)
    nothing = F.lit(None).cast("string")
    return {
        "os": agents.os_family(lowered, nothing, "documented"),
        "device": agents.device_type(lowered, nothing, "documented"),
    }


def cloud_console_logins(lines: DataFrame) -> DataFrame:
    """Cloud audit-trail JSON, console sign-ins only; OS and device from the agent."""
    shape = ("eventName string, eventTime string, sourceIPAddress string, userAgent string, "
             "userIdentity struct<userName: string, arn: string>, responseElements struct<ConsoleLogin: string>")
    j = lines.select(F.from_json(_V, shape).alias("j")).where("j.eventName = 'ConsoleLogin'")
    return _normalized(
        j, "cloud_console", user_id=F.coalesce("j.userIdentity.userName", "j.userIdentity.arn"),
        ts=_iso(F.col("j.eventTime")), source_ip=F.col("j.sourceIPAddress"),
        success=F.col("j.responseElements.ConsoleLogin") == "Success", **_agent_columns(F.col("j.userAgent")),
    )


def signin_logins(lines: DataFrame) -> DataFrame:
    """Cloud-directory sign-in JSON; error code 0 is success."""
    shape = ("createdDateTime string, userPrincipalName string, ipAddress string, "
             "location struct<countryOrRegion: string>, status struct<errorCode: int>, "
             "deviceDetail struct<displayName: string, operatingSystem: string, browser: string>")
    j = lines.select(F.from_json(_V, shape).alias("j")).where("j.userPrincipalName is not null")
    return _normalized(
        j, "sign_in", user_id=F.col("j.userPrincipalName"), ts=_iso(F.col("j.createdDateTime")),
        source_ip=F.col("j.ipAddress"), country=F.col("j.location.countryOrRegion"),
        device=_blank(F.col("j.deviceDetail.displayName")), browser=F.col("j.deviceDetail.browser"),
        os=F.col("j.deviceDetail.operatingSystem"), success=F.col("j.status.errorCode") == 0,
    )


def database_logins(lines: DataFrame) -> DataFrame:
    """Comma-separated database audit lines:
    time, server, user, client, connection, query, operation, database, object, return code."""
    f = F.split(_V, ",")
    rows = lines.where((F.size(f) >= 10) & f[6].isin("CONNECT", "FAILED_CONNECT"))
    stamp = F.regexp_replace(f[0], r"^(\d{4})(\d{2})(\d{2}) ", "$1-$2-$3 ")
    return _normalized(
        rows, "database", user_id=f[2], ts=stamp.try_cast("timestamp_ntz"), source_ip=f[3],
        success=(f[6] == "CONNECT") & (f[F.size(f) - 1] == "0"),
    )


def union_sources(*parts: DataFrame) -> DataFrame:
    """All sources as one table of normalised events."""
    return reduce(DataFrame.unionByName, parts)


def _json_reason(needed: str, missing: str, wanted: tuple[str, ...] | None = None) -> Column:
    """Why a JSON record is no login: not JSON, without the field that makes it one, or about something else."""
    value = F.get_json_object(_V, f"$.{needed}")
    broken = F.when(F.get_json_object(_V, "$").isNull(), "not JSON").when(value.isNull(), missing)
    return broken if wanted is None else broken.when(~value.isin(*wanted), "another event")


def _reason(source: str) -> Column:
    """NULL for a login record of ``source``."""
    fields = F.split(_V, ",")
    of = {
        "web": lambda: _json_reason("user", "no user"),
        "ssh": lambda: F.when(~F.col(_V).rlike(r" sshd(\[\d+\])?: "), "not of sshd").when(~F.col(_V).rlike(_SSH), "another message"),
        "active_directory": lambda: _json_reason("EventID", "no event", ("4624", "4625")),
        "vpn": lambda: F.when(_pair("action").isNull(), "no action").when(~_pair("action").isin("tunnel-up", "ssl-login-fail"), "another action"),
        "cloud_console": lambda: _json_reason("eventName", "no event", ("ConsoleLogin",)),
        "sign_in": lambda: _json_reason("userPrincipalName", "no user"),
        "database": lambda: F.when(F.size(fields) < 10, "too few fields").when(~F.get(fields, F.lit(6)).isin("CONNECT", "FAILED_CONNECT"), "another operation"),
    }[source]()
    return F.when(F.trim(F.coalesce(F.col(_V), F.lit(""))) == "", "blank").otherwise(of)


def rejects(lines: DataFrame, source: str) -> DataFrame:
    """Records of ``source`` (an ``auth_source``) that its reader gives no login for, with the reason."""
    told = lines.select(F.lit(source).alias("auth_source"), _V, _reason(source).alias("reason"))
    return told.where("reason is not null")


def reject_counts(lines: DataFrame, source: str) -> DataFrame:
    """Records per reason; logins under ``login``. The counts add up to the records read."""
    return lines.groupBy(F.coalesce(_reason(source), F.lit("login")).alias("reason")).agg(F.count(F.lit(1)).alias("records")).select(
        F.lit(source).alias("auth_source"), "reason", "records")
