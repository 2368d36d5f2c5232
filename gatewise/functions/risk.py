"""Calendar features, change flags, rule points, levels and decisions.

Pure column expressions over named inputs. The batch job and the stream build
their rows differently but share these expressions, so a live event and a
stored event get the same features, score and reasons.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# Value kinds with a seen-before feature, and the clean column that holds them.
KINDS = {
    "ip": "ip",
    "country": "country",
    "asn": "asn",
    "device": "device_type",
    "os": "os_family",
    "browser": "browser_family",
}
CHANGE_KINDS = ("country", "device", "browser")

FEATURES = (
    "hour", "is_night", "is_weekend",
    *(f"{kind}_seen_before" for kind in KINDS),
    *(f"{kind}_change" for kind in CHANGE_KINDS),
    "failed_recently", "rapid_login_rate", "login_frequency_today", "unusual_hour",
)

# ---------------------------------------------------------------- fixed values
# (rule, points, reason)
RULES = (
    ("new_country", 30, "first login from this country"),
    ("new_ip", 25, "first login from this IP address"),
    ("recent_failure", 20, "failed login in the last five minutes"),
    ("rapid", 15, "burst of logins within a minute"),
    ("night", 15, "login at night"),
    ("new_asn", 15, "first login from this network"),
    ("new_device", 10, "first login from this device type"),
    ("frequency", 10, "many logins today"),
    ("new_os", 7, "first login from this operating system"),
    ("new_browser", 7, "first login from this browser"),
)
# (level, lowest score), highest first
LEVELS = (("critical", 90), ("high", 65), ("medium", 30), ("low", 0))
COLOURS = {"low": "green", "medium": "yellow", "critical": "red"}
# ----------------------------------------------------------- end fixed values


@dataclass(frozen=True)
class RiskParams:
    """Thresholds. Where no public value exists the default is ours.

    night_hours, rapid_min, frequency_min, unusual_share and decisions are ours;
    lookback and burst lengths and the points are given.
    """

    lookback_us: int = 300 * 1_000_000
    burst_us: int = 60 * 1_000_000
    night_hours: tuple[int, int] = (0, 5)
    rapid_min: int = 1
    frequency_min: int = 10
    unusual_share: float = 0.05
    decisions: tuple[tuple[str, str], ...] = (
        ("low", "allow"), ("medium", "challenge"), ("high", "challenge"), ("critical", "block"),
    )
    levels: tuple[tuple[str, int], ...] = LEVELS


def calendar(ts: Column, params: RiskParams) -> dict[str, Column]:
    """Hour, night and weekend flags; Monday is weekday 0."""
    first, last = params.night_hours
    return {
        "hour": F.hour(ts),
        "is_night": F.hour(ts).between(first, last),
        "is_weekend": F.weekday(ts) >= 5,
    }


def history_features(
    now_us: Column, prior: Column, seen: dict[str, Column], last_failure_us: Column,
    in_burst: Column, today: Column, same_hour: Column, params: RiskParams,
) -> dict[str, Column]:
    """Features from what was known about the user strictly before the event.

    ``seen`` holds one nullable flag per kind. A user's first event has no
    history, so it changes nothing and sees nothing.
    """
    has_history = F.coalesce(now_us.isNotNull() & (prior > 0), F.lit(False))
    out = {f"{k}_seen_before": F.coalesce(has_history & s, F.lit(False)) for k, s in seen.items()}
    for kind in CHANGE_KINDS:
        out[f"{kind}_change"] = has_history & ~F.coalesce(seen[kind], F.lit(False))
    out["failed_recently"] = F.coalesce(last_failure_us >= now_us - params.lookback_us, F.lit(False))
    zero = F.lit(0).cast("bigint")
    for name, counted in (("rapid_login_rate", in_burst), ("login_frequency_today", today)):
        out[name] = F.when(has_history, F.coalesce(counted, zero)).otherwise(zero)
    share = F.coalesce(same_hour, zero).cast("double") / F.when(prior > 0, prior).cast("double")
    out["unusual_hour"] = has_history & F.coalesce(share < params.unusual_share, F.lit(False))
    return out


def rule_hits(params: RiskParams) -> dict[str, Column]:
    """Which rules fire, from feature columns. A first event fires no novelty rule."""
    c = F.col

    def new(kind: str) -> Column:
        return c("has_history") & ~c(f"{kind}_seen_before")

    return {
        "new_country": new("country"),
        "new_ip": new("ip"),
        "recent_failure": c("failed_recently"),
        "rapid": c("rapid_login_rate") >= params.rapid_min,
        "night": c("is_night"),
        "new_asn": new("asn"),
        "new_device": new("device"),
        "frequency": c("login_frequency_today") >= params.frequency_min,
        "new_os": new("os"),
        "new_browser": new("browser"),
    }


def total_score(params: RiskParams) -> Column:
    """Sum of the points of the rules that fire; the raw sum, at most 154."""
    hits = rule_hits(params)
    total = F.lit(0)
    for rule, points, _ in RULES:
        total = total + F.when(hits[rule], points).otherwise(0)
    return total


def reasons(params: RiskParams) -> Column:
    """One sentence per fired rule, in rule order."""
    hits = rule_hits(params)
    return F.array_compact(F.array(*[F.when(hits[r], F.lit(text)) for r, _, text in RULES]))


def level(score: Column, params: RiskParams) -> Column:
    out = None
    for name, lowest in params.levels:
        out = F.when(score >= lowest, name) if out is None else out.when(score >= lowest, name)
    return out


def decision(level_name: Column, params: RiskParams) -> Column:
    out = None
    for name, action in params.decisions:
        out = F.when(level_name == name, action) if out is None else out.when(level_name == name, action)
    return out


def colour(level_name: Column) -> Column:
    """Display colour; ``high`` has no published colour and stays NULL."""
    out = None
    for name, shade in COLOURS.items():
        out = F.when(level_name == name, shade) if out is None else out.when(level_name == name, shade)
    return out
