"""Quality counters over raw and clean events, each set computed in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gatewise.functions import agents, text
from gatewise.functions.agents import has_any


def _holds(name: str, *words: str) -> Column:
    """Case-sensitive keyword search in a raw column."""
    found = F.lit(False)
    for word in words:
        found = found | F.col(name).contains(word)
    return found


def raw_checks(profile: str = "shipped") -> dict[str, Column]:
    """Name to predicate; a NULL predicate does not count."""
    c = F.col
    private = text.is_private_ip(c("ip"))
    return {
        "total_rows": F.lit(True),
        "browser_android_os_ios": _holds("browser", "Android") & _holds("os", "iOS"),
        "browser_ios_os_android": _holds("browser", "iPhone", "iPad") & _holds("os", "Android"),
        "browser_win_os_mobile": _holds("browser", "Windows") & _holds("os", "Android", "iOS", "Mac"),
        "browser_mobile_os_win": _holds("browser", "Android", "iPhone", "iPad") & _holds("os", "Windows"),
        "mobile_desktop_marker": (c("device") == "mobile")
        & ~_holds("browser", "Mobile", "Android", "iPhone", "iPad"),
        "private_ips": private,
        "private_ip_foreign": c("ip").startswith("10.") & (c("country") != "NO"),
        "attack_on_private": private & (c("attack") == "True"),
        "rtt_missing": c("rtt").isNull(),
        "rtt_over_60s": text.rtt_is_outlier(c("rtt")),
        "genbot_rows": has_any(F.lower("ua"), agents.GENERATOR_BOTS[profile]),
        "vlc_rows": has_any(F.lower("ua"), agents.VLC),
        "region_dash": c("region") == "-",
        "city_dash": c("city") == "-",
    }


def clean_checks(profile: str = "shipped") -> dict[str, Column]:
    """Name to predicate over the clean columns; ``documented`` adds the legacy-OS guard."""
    c = F.col
    checks = {
        "total_rows": F.lit(True),
        "ua_os_conflict": c("ua_os_conflict"),
        "mobile_desktop_marker": (c("device_raw") == "mobile") & (c("device_type") != "mobile"),
        "private_ips": c("is_private_ip"),
        "private_ip_foreign": c("is_private_ip") & (c("country") != "NO"),
        "attack_on_private": c("is_private_ip") & c("is_attack_ip"),
        "rtt_missing": c("rtt_missing"),
        "rtt_over_60s": c("rtt_outlier"),
        "genbot_rows": c("is_generator_bot"),
        "vlc_rows": c("is_vlc"),
        "digit_family_rows": c("browser_family").rlike("[0-9]"),
        "geo_null_now": c("region").isNull() & c("city").isNull(),
    }
    if profile == "documented":
        checks["legacy_os_rows"] = c("os_family").isin(*agents.LEGACY_SYSTEMS)
    return checks


def count_each(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """One row, one bigint column per predicate, one scan."""
    return df.agg(*[F.count_if(p).alias(n) for n, p in predicates.items()])


def as_rows(one_row: DataFrame, name: str = "check_name", value: str = "n") -> DataFrame:
    """A one-row table of counters as (name, value) rows."""
    return one_row.unpivot([], one_row.columns, name, value)


def compare_checks(raw: DataFrame, cleaned: DataFrame, profile: str = "shipped",
                   raw_sample: int | None = None) -> DataFrame:
    """Every check with its count before and after; NULL where a side lacks it.

    ``raw_sample`` restricts the raw side only, as the verification run does.
    """
    from gatewise.sources.files import first_rows

    source = first_rows(raw, raw_sample) if raw_sample else raw
    before = as_rows(count_each(source, raw_checks(profile)), value="before_n")
    after = as_rows(count_each(cleaned, clean_checks(profile)), value="after_n")
    return before.join(after, "check_name", "full_outer")


def cleaning_summary(raw: DataFrame, cleaned: DataFrame, profile: str = "shipped") -> DataFrame:
    """Checks present on both sides, with the row-count verdict."""
    both = compare_checks(raw, cleaned, profile).where("before_n is not null and after_n is not null")
    return both.select(
        "check_name", "before_n", "after_n",
        F.when(F.col("check_name") == "total_rows", F.col("before_n") == F.col("after_n")).alias("rows_unchanged"),
    )


def write_summary(summary: DataFrame, path: str, sample_run: bool = False) -> bool:
    """Write the summary as JSON; a sample run writes nothing."""
    if sample_run:
        return False
    summary.coalesce(1).write.json(path)
    return True


def profile(cleaned: DataFrame, approximate: bool = False) -> DataFrame:
    """Whole-table profile: rows, users, label counts and the time range.

    The exact distinct count shuffles one row per user and task; ``approximate``
    replaces it by a sketch and needs no shuffle of users.
    """
    users = F.approx_count_distinct("user_id") if approximate else F.count_distinct("user_id")
    return cleaned.agg(
        F.count(F.lit(1)).alias("total_rows"),
        users.alias("unique_users"),
        F.sum(F.when(F.col("is_attack_ip"), 1).otherwise(0)).alias("attack_rows"),
        F.sum(F.when(F.col("is_ato"), 1).otherwise(0)).alias("ato_rows"),
        F.min("ts").alias("min_ts"),
        F.max("ts").alias("max_ts"),
    )
