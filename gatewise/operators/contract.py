"""Contract of the pipeline's tables: every line is a check, its value and PASS or FAIL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from gatewise.functions import agents
from gatewise.functions.agents import has_any
from gatewise.functions.risk import CHANGE_KINDS, FEATURES
from gatewise.operators.checks import as_rows, count_each
from gatewise.operators.sampling import SampleSpec, sample_users, user_tiers
from gatewise.schema import CLEAN_SCHEMA, same_columns

# Working columns and label-like columns that must not reach a feature table.
FORBIDDEN = ("prior_fail_ts", "rn", "is_robot_sampled")


def schema_violations(table: DataFrame, expected: T.StructType = CLEAN_SCHEMA, label: str = "") -> DataFrame:
    """Missing, further and misplaced columns, and forbidden ones; decided on the plan, no job."""
    diffs = same_columns(table.schema, expected)
    bad = [c for c in table.columns if c in FORBIDDEN or c.startswith("_")]
    return table.sparkSession.sql(
        "select * from values (:x, cast(:a as bigint)), (:y, cast(:b as bigint)) as t(check_name, n)",
        args={"x": f"{label}schema_differences", "y": f"{label}forbidden_columns", "a": len(diffs), "b": len(bad)},
    )


def clean_violations(clean: DataFrame) -> DataFrame:
    """Rows that break a rule of the documented cleaning profile."""
    c = F.col
    ua = F.lower("user_agent")
    geo = c("is_private_ip") | c("region").isNull() | c("city").isNull()
    ios_in_ua = has_any(ua, agents.IOS, whole_token=True)
    desktop_ua = has_any(ua, agents.DESKTOP_MARKERS)
    return as_rows(count_each(clean, {
        "geo_semantics_violations": ~c("geo_unreliable").eqNullSafe(geo),
        "ios_spoof_label": (c("os_family") == "iOS") & ~ios_in_ua
        & (c("is_generator_bot") | has_any(ua, ("Android", "Andorid"))),
        "null_device_desktop": (c("device_raw").isNull() | (c("device_raw") == "unknown"))
        & (c("device_type") == "desktop"),
        "desktop_reclass_mobile": (c("device_raw") == "desktop") & (c("device_type") == "mobile") & desktop_ua,
    }))


def legacy_guard(clean: DataFrame) -> DataFrame:
    """Rows whose OS column names a legacy system but whose family stayed unknown."""
    os_lc = F.lower("os_raw")
    lost = has_any(os_lc, agents.LEGACY_SYSTEMS) & (F.col("os_family") == "unknown")
    return as_rows(count_each(clean, {"legacy_os_lost": lost}))


def feature_violations(features: DataFrame) -> DataFrame:
    """NULL features, and first events that claim a change or a seen value."""
    c = F.col
    missing = F.lit(False)
    for name in FEATURES:
        missing = missing | c(name).isNull()
    changed = F.lit(False)
    for kind in CHANGE_KINDS:
        changed = changed | c(f"{kind}_change")
    for name in FEATURES:
        if name.endswith("_seen_before"):
            changed = changed | c(name)
    return as_rows(count_each(features, {
        "feature_nulls": missing, "first_event_changes": ~c("has_history") & changed,
    }))


def row_differences(tables: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Row-count difference of each named pair of tables."""
    out = None
    for name, (left, right) in tables.items():
        part = left.agg(F.count(F.lit(1)).alias("l")).select(
            F.lit(name).alias("check_name"),
            (F.col("l") - right.agg(F.count(F.lit(1)).alias("r")).scalar()).alias("n"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def expected_sample_rows(events: DataFrame, spec: SampleSpec) -> DataFrame:
    """Rows the sample must have, recomputed from the tiers alone."""
    c = F.col
    cap = F.when(c("tier") == "robot", spec.robot_cap).otherwise(spec.user_cap)
    chosen = sample_users(user_tiers(events, spec), spec)
    kept = F.greatest(F.least(c("user_rows"), cap), c("atos"))
    return chosen.agg(F.coalesce(F.sum(kept), F.lit(0)).alias("expected_rows"))


def sample_violations(events: DataFrame, sample: DataFrame, spec: SampleSpec) -> DataFrame:
    """Sample size against the tiers, and takeover rows that were lost."""
    got = sample.agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_ato").alias("atos"))
    all_atos = events.agg(F.count_if("is_ato").alias("n"))
    wide = got.select(
        (F.col("rows") - expected_sample_rows(events, spec).scalar()).alias("sample_rows_off"),
        (all_atos.scalar() - F.col("atos")).alias("ato_rows_lost"),
    )
    return as_rows(wide)


def fingerprint(table: DataFrame) -> DataFrame:
    """Order-free fingerprint: row count and the sum of row hashes.

    A sum, not an xor: equal rows would cancel out in pairs.
    """
    h = F.xxhash64(*sorted(table.columns)).cast("decimal(38,0)")
    return table.agg(F.count(F.lit(1)).alias("rows"), F.sum(h).cast("string").alias("hash_sum"))


def rebuild_differences(first: DataFrame, second: DataFrame) -> DataFrame:
    """0 when two builds of a table are identical as multisets, else 1."""
    a, b = fingerprint(first), fingerprint(second)
    same = (F.col("rows") == b.select("rows").scalar()) & F.col("hash_sum").eqNullSafe(b.select("hash_sum").scalar())
    return a.select(F.lit("rebuild_differs").alias("check_name"), F.when(same, 0).otherwise(1).cast("bigint").alias("n"))


def verdict(*parts: DataFrame) -> DataFrame:
    """All checks with PASS (value 0) or FAIL."""
    out = parts[0].select("check_name", "n")
    for part in parts[1:]:
        out = out.unionByName(part.select("check_name", "n"))
    return out.withColumn("verdict", F.when(F.col("n") == 0, "PASS").otherwise("FAIL"))
