"""Registered queries: name -> (Spark job over a scale directory, equivalent SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gatewise.functions.risk import FEATURES, KINDS, RULES, RiskParams
from gatewise.functions import text
from gatewise.operators import audit, checks, contract, daily, evaluate, features, models, sampling, scoring, slots
from gatewise.operators.clean import clean, observed_clean
from gatewise.operators.features import FeatureParams
from gatewise.operators.sampling import SampleSpec
from gatewise.plans import sql
from gatewise.schema import CLEAN_SCHEMA, feature_schema
from gatewise.session import cut_lineage, prepare, scratch_dir, written
from gatewise.sources import files, normalize
from gatewise.sources.projection import logins_from_events, read_logins
from gatewise.streaming import live, microbatch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

RISK = RiskParams()
# The tables are small, so the row limits are too: the dominant user is split.
PARAMS = FeatureParams(risk=RISK, slot_rows=1000)
SPEC = SampleSpec(user_cap=40, robot_cap=500, params=PARAMS)
FEATURE_INPUT = ("row_id", "user_id", "ts", "login_success", "is_attack_ip", "is_ato", *KINDS.values())


def query(name: str, statement: str | None = None):
    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[name] = run
        if statement is not None:
            SQL[name] = statement
        return run

    return register


# ------------------------------------------------------------------ shared inputs

def cleaned(spark: SparkSession, sf_dir: str, profile: str = "documented") -> DataFrame:
    return clean(read_logins(spark, sf_dir), profile)


def featured(spark: SparkSession, sf_dir: str, keep_counts: bool = False) -> DataFrame:
    events = cleaned(spark, sf_dir).select(*FEATURE_INPUT)
    return features.behaviour_features(events, PARAMS, keep_counts)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.with_gold(scoring.score_events(featured(spark, sf_dir), RISK))


def _counts(predicates: dict[str, str], source: str, label: str = "check_name", value: str = "n") -> str:
    """One row per counter, each counted by its own select."""
    return "\nunion all ".join(
        f"select '{n}' as {label}, (select count(*) from {source} where {p}) as {value}" for n, p in predicates.items()
    )


# ------------------------------------------------------------- scans and sinks

@query("scan_csv", sql.with_(sql.logins(), "select * from logins"))
def _(spark, sf):
    path = scratch_dir(spark, "csv")
    files.write_raw_csv(read_logins(spark, sf), path)
    return files.read_raw_csv(spark, path)


@query("scan_csv_inferred", sql.with_(sql.logins(), """
select count(*) as total_rows, count(distinct user_id) as unique_users,
  count(*) filter (where attack = 'True') as attack_rows, count(*) filter (where ato = 'True') as ato_rows,
  cast(min(try_cast(ts as timestamp)) as varchar) as min_ts, cast(max(try_cast(ts as timestamp)) as varchar) as max_ts
from logins"""))
def _(spark, sf):
    path = scratch_dir(spark, "csv")
    files.write_raw_csv(read_logins(spark, sf), path)
    rows = files.read_inferred_csv(spark, path)
    as_clean = rows.withColumnsRenamed({"attack": "is_attack_ip", "ato": "is_ato"})
    out = checks.profile(as_clean)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz").cast("string") for c in ("min_ts", "max_ts")})


@query("scan_parquet", sql.with_(sql.clean(), "select * from clean"))
def _(spark, sf):
    path = scratch_dir(spark, "clean") + ".parquet"
    files.write_events(cleaned(spark, sf), path)
    return files.read_logins_file(spark, path)


@query("scan_first_rows", sql.with_(sql.logins(), "select * from logins order by cast(idx as bigint) limit 500"))
def _(spark, sf):
    return files.first_rows(read_logins(spark, sf), 500)


@query("sink_parquet_by_day", sql.with_(sql.clean(), """
select cast(ts as date) as day, count(*) as events, count(distinct row_id) as row_ids,
  cast(sum(hash_of) as bigint) as row_sum from (select *, row_id % 1000003 as hash_of from clean) group by 1"""))
def _(spark, sf):
    path = scratch_dir(spark, "days") + ".parquet"
    files.write_events(cleaned(spark, sf), path, partition_by_day=True)
    days = files.read_logins_file(spark, path).groupBy("day")
    return days.agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("row_id").alias("row_ids"),
        F.sum(F.col("row_id") % 1000003).alias("row_sum"),
    )


@query("parse_integrity", sql.with_(sql.logins(), """
select count(*) + 2 as loose_rows, count(*) as strict_rows, 2 as malformed_rows from logins"""))
def _(spark, sf):
    path = scratch_dir(spark, "csv")
    files.write_raw_csv(read_logins(spark, sf), path)
    # two malformed lines beside the written rows: too few and too many fields
    bad = spark.sql("select explode(array('idx', '1,2,3', array_join(array_repeat('x', 17), ','))) as value")
    bad.coalesce(1).write.mode("append").text(path)
    return files.parse_integrity(spark, path)


@query("report_sink", sql.with_(sql.scores(), """
select level, decision, count(*) as events from scored group by all"""))
def _(spark, sf):
    path = scratch_dir(spark, "report")
    files.write_report(scoring.level_counts(scored(spark, sf)), path, "json")
    return spark.read.schema("level string, decision string, events bigint").json(path)


# ------------------------------------------------------------------- cleaning

@query("clean_shipped", sql.with_(sql.clean("shipped"), "select * from clean"))
def _(spark, sf):
    return cleaned(spark, sf, "shipped")


@query("clean_documented", sql.with_(sql.clean(), "select * from clean"))
def _(spark, sf):
    return cleaned(spark, sf)


@query("clean_raw_preserved", sql.with_(sql.clean(), """
select row_id, c.region, l.region as raw_region, l.city as raw_city, c.city, c.rtt, l.rtt as raw_rtt, l.ts as raw_ts
from clean c join logins l on c.row_id = cast(l.idx as bigint)"""))
def _(spark, sf):
    rows = clean(read_logins(spark, sf), preserve_raw=True)
    return rows.select("row_id", "region", "raw_region", "raw_city", "city", "rtt", "raw_rtt", "raw_ts")


@query("clean_row_invariance", sql.with_(sql.logins(), """
select count(*) as rows_before, count(*) as rows_after from logins"""))
def _(spark, sf):
    done, before, after = observed_clean(read_logins(spark, sf))
    files.write_events(done, scratch_dir(spark, "clean") + ".parquet")
    counts = F.lit(before.get["rows"]).alias("rows_before"), F.lit(after.get["rows"]).alias("rows_after")
    return spark.range(1).select(*counts)


# --------------------------------------------------------------------- checks

_RAW_PREDICATES = {
    "total_rows": "true",
    "browser_android_os_ios": "browser like '%Android%' and os like '%iOS%'",
    "browser_ios_os_android": "(browser like '%iPhone%' or browser like '%iPad%') and os like '%Android%'",
    "browser_win_os_mobile": "browser like '%Windows%' and (os like '%Android%' or os like '%iOS%' or os like '%Mac%')",
    "browser_mobile_os_win":
        "(browser like '%Android%' or browser like '%iPhone%' or browser like '%iPad%') and os like '%Windows%'",
    "mobile_desktop_marker": "device = 'mobile' and not (browser like '%Mobile%' or browser like '%Android%'"
                             " or browser like '%iPhone%' or browser like '%iPad%')",
    "private_ips": f"regexp_matches(ip, {sql.quoted(sql.PRIVATE)})",
    "private_ip_foreign": "ip like '10.%' and country <> 'NO'",
    "attack_on_private": f"regexp_matches(ip, {sql.quoted(sql.PRIVATE)}) and attack = 'True'",
    "rtt_missing": "rtt is null",
    "rtt_over_60s": "try_cast(rtt as double) > 60000",
    "genbot_rows": sql.word_match("ua", checks.agents.GENERATOR_BOTS["shipped"]),
    "vlc_rows": sql.word_match("ua", checks.agents.VLC),
    "region_dash": "region = '-'",
    "city_dash": "city = '-'",
}
_CLEAN_PREDICATES = {
    "total_rows": "true",
    "ua_os_conflict": "ua_os_conflict",
    "mobile_desktop_marker": "device_raw = 'mobile' and device_type <> 'mobile'",
    "private_ips": "is_private_ip",
    "private_ip_foreign": "is_private_ip and country <> 'NO'",
    "attack_on_private": "is_private_ip and is_attack_ip",
    "rtt_missing": "rtt_missing",
    "rtt_over_60s": "rtt_outlier",
    "genbot_rows": "is_generator_bot",
    "vlc_rows": "is_vlc",
    "digit_family_rows": "regexp_matches(browser_family, '[0-9]')",
    "geo_null_now": "region is null and city is null",
}
_LEGACY = {"legacy_os_rows": "os_family in ('BlackBerry', 'MeeGo', 'Roku', 'Symbian', 'WebTV', 'Firefox OS')"}


@query("checks_raw", sql.with_(sql.logins(), _counts(_RAW_PREDICATES, "logins")))
def _(spark, sf):
    return checks.as_rows(checks.count_each(read_logins(spark, sf), checks.raw_checks()))


@query("checks_clean", sql.with_(sql.clean("shipped"), _counts(_CLEAN_PREDICATES, "clean")))
def _(spark, sf):
    return checks.as_rows(checks.count_each(cleaned(spark, sf, "shipped"), checks.clean_checks()))


@query("checks_clean_documented", sql.with_(sql.clean(), _counts({**_CLEAN_PREDICATES, **_LEGACY}, "clean")))
def _(spark, sf):
    return checks.as_rows(checks.count_each(cleaned(spark, sf), checks.clean_checks("documented")))


@query("checks_compare", sql.with_(f"""{sql.clean("shipped")},
b as ({_counts(_RAW_PREDICATES, "logins")}), a as ({_counts(_CLEAN_PREDICATES, "clean")})""", """
select coalesce(b.check_name, a.check_name) as check_name, b.n as before_n, a.n as after_n
from b full join a on a.check_name = b.check_name"""))
def _(spark, sf):
    return checks.compare_checks(read_logins(spark, sf), cleaned(spark, sf, "shipped"))


@query("cleaning_summary", sql.with_(f"""{sql.clean("shipped")},
b as ({_counts(_RAW_PREDICATES, "logins")}), a as ({_counts(_CLEAN_PREDICATES, "clean")})""", """
select check_name, b.n as before_n, a.n as after_n, case when check_name = 'total_rows' then b.n = a.n end as rows_unchanged
from b join a using (check_name)"""))
def _(spark, sf):
    path = scratch_dir(spark, "summary")
    summary = checks.cleaning_summary(read_logins(spark, sf), cleaned(spark, sf, "shipped"))
    checks.write_summary(summary, path)
    return spark.read.schema(summary.schema).json(path)


@query("profile", sql.with_(sql.clean(), """
select count(*) as total_rows, count(distinct user_id) as unique_users,
  count(*) filter (where is_attack_ip) as attack_rows, count(*) filter (where is_ato) as ato_rows,
  min(ts) as min_ts, max(ts) as max_ts from clean"""))
def _(spark, sf):
    return checks.profile(cleaned(spark, sf))


@query("profile_daily", sql.with_(sql.clean(), """
select count(*) as total_rows, count(*) filter (where is_attack_ip) as attack_rows, count(*) filter (where is_ato) as ato_rows,
  min(ts) as min_ts, max(ts) as max_ts, true as users_close, true as ips_close, true as median_close from clean"""))
def _(spark, sf):
    """Merged from sketches of days added in two runs, the second of which repeats a day; estimates held against exact counts."""
    rows, path = written(cleaned(spark, sf).select("user_id", "ip", "ts", "rtt", "is_attack_ip", "is_ato"), "rows"), scratch_dir(spark, "daily")
    cut = rows.agg(F.percentile_approx("ts", 0.5).alias("ts")).first()["ts"]
    day = F.to_date("ts")
    daily.add_days(rows.where(day <= F.to_date(F.lit(cut))), path)
    daily.add_days(rows.where((day >= F.to_date(F.lit(cut))) | day.isNull()), path)
    exact = rows.agg(F.count_distinct("user_id").alias("users"), F.count_distinct("ip").alias("ips"))
    c = F.col
    merged = daily.merged_profile(spark, path)
    at = merged.select("median_rtt").scalar()
    ranks = rows.where("rtt is not null").agg(F.avg((c("rtt") < at).cast("int")).alias("below"), F.avg((c("rtt") <= at).cast("int")).alias("upto"))
    merged = merged.withColumns({n: t.select(n).scalar() for t, names in ((exact, ("users", "ips")), (ranks, ("below", "upto"))) for n in names})
    near = lambda estimate, true: F.abs(c(estimate) - c(true)) <= 0.03 * c(true) + 1
    return merged.select(
        "total_rows", "attack_rows", "ato_rows", "min_ts", "max_ts", near("unique_users", "users").alias("users_close"),
        near("unique_ips", "ips").alias("ips_close"), ((c("below") <= 0.53) & (c("upto") >= 0.47)).alias("median_close"))


# ---------------------------------------------------------------------- audits

def _grid_sql() -> str:
    parsers = {
        "idx": "try_cast(idx as bigint)", "user_id": "try_cast(user_id as bigint)", "asn": "try_cast(asn as bigint)",
        "rtt": "try_cast(rtt as double)", "ts": "try_cast(ts as timestamp)",
        **{f: f"case when {f} in ('True', 'False') then {f} end" for f in ("success", "attack", "ato")},
        "ip": "case when regexp_matches(ip, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$') and "
              "list_max(list_transform(string_split(ip, '.'), lambda o: try_cast(o as bigint))) <= 255 then ip end",
        "country": "case when length(country) = 2 and upper(country) = country then country end",
    }
    numeric = ("idx", "user_id", "asn", "rtt")
    return sql.with_(sql.logins(), "\nunion all ".join(
        f"""select '{n}' as column_name, count(*) as rows, count(*) - count({n}) as missing,
        count({n}) - count({p}) as unparsable,
        {f'cast(min({p}) as double)' if n in numeric else 'cast(null as double)'} as minimum,
        {f'cast(max({p}) as double)' if n in numeric else 'cast(null as double)'} as maximum from logins"""
        for n, p in parsers.items()
    ))


@query("audit_column_grid", _grid_sql())
def _(spark, sf):
    return audit.column_grid(read_logins(spark, sf))


@query("audit_row_ids", sql.with_(sql.clean(), """
select count(*) as rows, count(distinct row_id) as distinct_ids, min(row_id) as min_id, max(row_id) as max_id,
 count(*) - count(distinct row_id) as repeated_or_null,
 max(row_id) - min(row_id) + 1 - count(distinct row_id) as gaps from clean"""))
def _(spark, sf):
    return audit.row_id_sequence(cleaned(spark, sf))


@query("audit_ip_form", sql.with_(f"""{sql.clean()},
p as (select ip, string_split(ip, '.') as o from clean),
q as (select *, len(o) = 4 and len(list_filter(o, lambda x: regexp_full_match(x, '[0-9]{{1,3}}'))) = 4 as quad,
 len(list_filter(o, lambda x: try_cast(x as bigint) > 255)) > 0 as big from p)""", """
select count(*) as total_rows, count(*) filter (where not quad) as malformed,
 count(*) filter (where quad and big) as octet_over_255, count(*) filter (where quad and not big) as valid from q"""))
def _(spark, sf):
    return audit.ip_form(cleaned(spark, sf))


@query("audit_countries", sql.with_(sql.clean(), """
select country, count(*) as events, count(distinct user_id) as users, country in ('NO', 'SE', 'US') as is_known
from clean group by country"""))
def _(spark, sf):
    return audit.country_counts(cleaned(spark, sf), audit.iso_country_codes(spark))


@query("audit_unknown_countries", sql.with_(sql.clean(), """
select country, count(*) as events from clean where country not in ('NO', 'SE') group by country"""))
def _(spark, sf):
    # a shorter list, so that something is outside of it
    listed = audit.iso_country_codes(spark).where("code <> 'US'")
    return audit.country_membership(cleaned(spark, sf), listed)


@query("audit_duplicate_keys", sql.with_(sql.clean(), """
select user_id, ip, user_agent, cast(ts as date) as day, count(*) as copies from clean group by all having count(*) > 1"""))
def _(spark, sf):
    rows = cleaned(spark, sf).withColumn("day", F.to_date("ts"))
    return audit.duplicate_keys(rows, "user_id", "ip", "user_agent", "day")


@query("audit_duplicate_rows", sql.with_(f"""{sql.clean()},
slim as (select user_id, ip, country, os_family, device_type, hour(ts) as hr from clean),
g as (select count(*) as n from slim group by user_id, ip, country, os_family, device_type, hr having count(*) > 1)""", """
select count(*) as duplicate_groups, cast(coalesce(sum(n - 1), 0) as bigint) as surplus_rows from g"""))
def _(spark, sf):
    rows = cleaned(spark, sf).select("user_id", "ip", "country", "os_family", "device_type", F.hour("ts").alias("hr"))
    return audit.duplicate_rows(rows)


_SPACE = ("country", "browser", "os", "device", "success", "attack", "ato")


@query("audit_value_space", sql.with_(sql.logins(), "\nunion all ".join(
    f"select '{c}' as column_name, {c} as value, count(*) as events from logins group by {c}" for c in _SPACE)))
def _(spark, sf):
    return audit.value_space(read_logins(spark, sf), *_SPACE)


def _coverage(raw_col: str, derived: str) -> str:
    return sql.with_(sql.clean(), f"""
select {raw_col} as raw_value, {derived} as family, count(*) as events, coalesce({derived} = 'unknown', true) as is_unmapped
from clean group by 1, 2""")


@query("audit_os_mapping", _coverage("os_raw", "os_family"))
def _(spark, sf):
    return audit.mapping_coverage(cleaned(spark, sf), "os_raw", "os_family")


@query("audit_device_mapping", _coverage("device_raw", "device_type"))
def _(spark, sf):
    return audit.mapping_coverage(cleaned(spark, sf), "device_raw", "device_type")


@query("audit_browser_mapping", _coverage("browser_raw", "browser_family"))
def _(spark, sf):
    return audit.mapping_coverage(cleaned(spark, sf), "browser_raw", "browser_family")


@query("audit_os_by_device", sql.with_(sql.clean(), "select os_family, " + ", ".join(
    f"count(*) filter (where device_type = '{d}') as {d}" for d in audit.DEVICES) + " from clean group by os_family"))
def _(spark, sf):
    return audit.os_by_device(cleaned(spark, sf))


@query("audit_placeholders", sql.with_(sql.logins(), """
select case when coalesce(region, '') = '' then 'null' when region = '-' then 'dash' else 'set' end as region_state,
  case when coalesce(city, '') = '' then 'null' when city = '-' then 'dash' else 'set' end as city_state,
  count(*) as events from logins group by 1, 2"""))
def _(spark, sf):
    return audit.placeholder_matrix(read_logins(spark, sf))


@query("audit_hours", sql.with_(sql.clean(), """
select cast(hour(ts) as integer) as hour, count(*) as events,
 cast(count(*) as double) / (select count(*) from clean) as share from clean group by 1"""))
def _(spark, sf):
    return audit.hour_distribution(cleaned(spark, sf))


def _dependency(key: str, value: str) -> str:
    return sql.with_(f"""{sql.clean()},
g as (select {key}, count(*) as n, count(distinct coalesce(cast({value} as varchar), '<null>')) as vals
  from clean group by {key})""", """
select count(*) as keys_total, count(*) filter (where vals > 1) as keys_mixed,
 cast(coalesce(sum(n) filter (where vals > 1), 0) as bigint) as rows_mixed from g""")


@query("audit_ua_decides_os", _dependency("user_agent", "os_raw"))
def _(spark, sf):
    return audit.functional_dependency(cleaned(spark, sf), "user_agent", "os_raw")


@query("audit_ip_decides_country", _dependency("ip", "country"))
def _(spark, sf):
    return audit.functional_dependency(cleaned(spark, sf), "ip", "country")


@query("audit_label_by_ip", sql.with_(f"""{sql.clean()},
g as (select ip, count(*) as n, count(*) filter (where is_attack_ip) as a from clean group by ip)""", """
select count(*) as ips, count(*) filter (where a = n) as always_attack, count(*) filter (where a = 0) as never_attack,
 count(*) filter (where a > 0 and a < n) as mixed from g"""))
def _(spark, sf):
    return audit.label_by_ip(cleaned(spark, sf))


@query("audit_asn_countries", sql.with_(sql.clean(), """
select asn, count(distinct country) as countries, count(*) as events,
 cast(count(*) as double) / (select count(*) from clean) as share
from clean group by asn having count(distinct country) >= 2"""))
def _(spark, sf):
    return audit.multi_country_asns(cleaned(spark, sf))


@query("audit_ip_reuse", sql.with_(f"""{sql.clean()},
g as (select ip, count(distinct user_id) as users from clean group by ip),
b as (select *, case when users >= 1000 then '1000+' when users >= 100 then '100-999' when users >= 10 then '10-99'
  else '1-9' end as band, row_number() over (partition by case when users >= 1000 then 3 when users >= 100 then 2
  when users >= 10 then 1 else 0 end order by users desc, ip) as place from g)""", """
select band, count(*) as ips, max(users) as most_users, max(case when place = 1 then ip end) as busiest_ip
from b group by band"""))
def _(spark, sf):
    return audit.ip_reuse(cleaned(spark, sf))


@query("audit_events_per_user", sql.with_(f"""{sql.clean()},
g as (select count(*) as n from clean group by user_id)""", """
select count(*) as users, cast(sum(n) as double) / count(*) as mean_events, quantile_cont(n, 0.5) as median_events,
 quantile_cont(n, 0.9) as p90_events, quantile_cont(n, 0.95) as p95_events, quantile_cont(n, 0.99) as p99_events,
 max(n) as max_events from g"""))
def _(spark, sf):
    return audit.events_per_user(cleaned(spark, sf))


@query("audit_attack_concentration", sql.with_(f"""{sql.clean()},
g as (select user_id, count(*) as n, count(*) filter (where is_attack_ip) as a from clean group by user_id
  having count(*) filter (where is_attack_ip) > 0),
t as (select sum(a) as top from (select a from g order by a desc, user_id limit 5))""", """
select cast(sum(a) as bigint) as attack_events, count(*) as attack_users, count(*) filter (where a >= 10) as users_10_plus,
 cast(coalesce(sum(n) filter (where a >= 10), 0) as bigint) as events_of_10_plus,
 count(*) filter (where a <= 2) as users_1_or_2, cast(max(top) as bigint) as top_events,
 cast(max(top) as double) / cast(sum(a) as double) as top_share from g, t"""))
def _(spark, sf):
    return audit.attack_concentration(cleaned(spark, sf), top=5)


@query("audit_dominant_user", sql.with_(f"""{sql.clean()},
u as (select user_id as w from clean group by 1 order by count(*) desc, 1 limit 1),
m as (select * from clean where user_id = (select w from u))""", """
select max(user_id) as user_id, count(*) as events, count(distinct country) as countries,
 count(*) filter (where login_success) as successes, count(*) filter (where is_attack_ip) as attack_events,
 count(*) filter (where ua_os_conflict) as conflicts, cast(count(*) as double) / (select count(*) from clean) as event_share,
 cast(count(*) filter (where is_attack_ip) as double) / (select count(*) from clean where is_attack_ip) as attack_share,
 cast(count(*) filter (where ua_os_conflict) as double) / nullif((select count(*) from clean where ua_os_conflict), 0) as conflict_share,
 count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9) as events_per_hour from m"""))
def _(spark, sf):
    return audit.dominant_user(cleaned(spark, sf))


# Every release is a date of 2020-21; the tables hold 2024, so two rules that hit are added to all.
_RELEASES = (
    *audit.RELEASES,
    audit.ReleaseRule("chrome_85_dated_2024", "browser_raw", "^Chrome 85", "2024-01-15"),
    audit.ReleaseRule("android_10", "os_raw", "^Android 10", None),
)


@query("audit_impossible_versions", sql.with_(f"""{sql.clean()},
h as (select {', '.join(
    f"coalesce(regexp_matches({r.column}, {sql.quoted(r.pattern)})" + (f" and ts < timestamp '{r.since}'" if r.since else "") + f", false) as {r.name}"
    for r in _RELEASES)} from clean)""",
    _counts({**{r.name: r.name for r in _RELEASES}, "any_rule": " or ".join(r.name for r in _RELEASES)}, "h", "rule", "events")))
def _(spark, sf):
    return audit.impossible_versions(cleaned(spark, sf), _RELEASES)


_PLATFORM = sql.word_match("user_agent", audit._PLATFORM_WORDS)


@query("audit_agent_gaps", sql.with_(sql.clean(), _counts({
    "total_rows": "true",
    "ua_silent_on_platform": f"not {_PLATFORM}",
    "ua_short": "length(user_agent) < 15",
    "device_null": "device_raw is null",
    "tablet_without_marker": f"device_raw = 'tablet' and not {sql.word_match('user_agent', audit.agents.TABLET_MARKERS)}",
    "desktop_with_mobile_ua": f"device_raw = 'desktop' and {sql.word_match('user_agent', ['Mobile', 'iPhone', 'Android'])}",
    "mobile_with_silent_ua": f"device_raw = 'mobile' and not {_PLATFORM}",
    "os_column_other": "os_raw = 'Other '",
}, "clean")))
def _(spark, sf):
    return audit.agent_gaps(cleaned(spark, sf))


@query("audit_text_content", """
select 'text' as column_name, count(*) filter (where regexp_matches(text, '[\\x00-\\x1f]')) as control_rows,
 count(*) filter (where length(text) <> strlen(text)) as non_ascii_rows from documents
union all select 'source', count(*) filter (where regexp_matches(source, '[\\x00-\\x1f]')),
 count(*) filter (where length(source) <> strlen(source)) from documents""")
def _(spark, sf):
    return audit.text_content(spark.read.parquet(f"{sf}/documents.parquet"), "text", "source")


@query("audit_text_content_places", sql.with_(sql.clean(), """
select 'region' as column_name, count(*) filter (where regexp_matches(region, '[\\x00-\\x1f]')) as control_rows,
 count(*) filter (where length(region) <> strlen(region)) as non_ascii_rows from clean
union all select 'city', count(*) filter (where regexp_matches(city, '[\\x00-\\x1f]')),
 count(*) filter (where length(city) <> strlen(city)) from clean"""))
def _(spark, sf):
    return audit.text_content(cleaned(spark, sf), "region", "city")


@query("audit_label_overlap", sql.with_(sql.clean(), """
select is_attack_ip, login_success, is_ato, is_private_ip, count(*) as events,
 cast(grouping_id(is_attack_ip, login_success, is_ato, is_private_ip) as integer) as level
from clean group by cube (is_attack_ip, login_success, is_ato, is_private_ip)"""))
def _(spark, sf):
    return audit.label_overlap(cleaned(spark, sf))


@query("audit_family_collapse", sql.with_(sql.clean(), """
select count(distinct browser_raw) as raw_values, count(distinct browser_family) as families,
 count(distinct browser_family) filter (where regexp_matches(browser_family, '[0-9]')) as families_with_digit from clean"""))
def _(spark, sf):
    return audit.family_collapse(cleaned(spark, sf))


@query("audit_bots", sql.with_(sql.clean(), """
select case when user_agent like '%ZipppBot%' then 'ZipppBot' when user_agent like '%Awario%' then 'AwarioSmartBot' end as bot,
 count(*) as events, count(*) filter (where device_raw = 'bot') as device_bot,
 count(*) filter (where login_success) as successes, count(*) filter (where is_attack_ip) as attack_events
from clean where is_generator_bot group by 1"""))
def _(spark, sf):
    return audit.bot_breakdown(cleaned(spark, sf))


# -------------------------------------------------------------------- features

def _feature_query(name: str, *columns: str):
    cols = ("row_id", *columns)

    @query(name, sql.with_(sql.features(), f"select {', '.join(cols)} from features"))
    def _(spark, sf):
        return featured(spark, sf).select(*cols)


_feature_query("feat_all", "user_id", "ts", *FEATURES, "has_history")
_feature_query("feat_calendar", "hour", "is_night", "is_weekend")
for _kind in KINDS:
    _feature_query(f"feat_{_kind}_seen_before", f"{_kind}_seen_before")
_feature_query("feat_changes", "country_change", "device_change", "browser_change")
_feature_query("feat_failed_recently", "failed_recently")
_feature_query("feat_rapid_login_rate", "rapid_login_rate")
_feature_query("feat_login_frequency_today", "login_frequency_today")
_feature_query("feat_unusual_hour", "unusual_hour")


@query("feat_rtt", sql.with_(sql.clean(), "select row_id, rtt, rtt_missing, rtt_outlier from clean"))
def _(spark, sf):
    return cleaned(spark, sf).select("row_id", "rtt", "rtt_missing", "rtt_outlier")


@query("feat_heavy_users", sql.with_(f"""{sql.clean()},
h as (select user_id, date_trunc('hour', ts) as h, count(*) as n from clean group by all),
t as (select user_id, sum(n) as total, max(n) as peak from h group by user_id)""", f"""
select user_id as heavy_user, cast(total as bigint) as user_rows from t where total > {PARAMS.slot_rows}"""))
def _(spark, sf):
    return features.heavy_users(cleaned(spark, sf), PARAMS).select("heavy_user", "user_rows")


@query("user_baselines", sql.with_(sql.clean(), """
select user_id, count(distinct country) as countries, count(distinct device_type) as devices, count(*) as events,
 count(*) filter (where not login_success) as failures, min(ts) as first_seen, max(ts) as last_seen from clean group by user_id"""))
def _(spark, sf):
    return features.user_baselines(cleaned(spark, sf))


@query("user_known_values", sql.with_(sql.clean(), "\nunion all ".join(
    f"""select user_id, '{k}' as kind, cast({c} as varchar) as value, min(ts) as first_seen, count(*) as events
    from clean group by user_id, {c}""" for k, c in KINDS.items())))
def _(spark, sf):
    return features.seen_values(cleaned(spark, sf))


@query("user_profile_maps", sql.with_(f"""{sql.clean()},
p as (select user_id, country, min(ts) as f from clean group by user_id, country)""", """
select user_id, string_agg(country || '=' || cast(f as varchar), ',' order by country) as known from p group by user_id"""))
def _(spark, sf):
    base = features.user_baselines(cleaned(spark, sf), with_maps=True)
    entries = F.transform(F.array_sort(F.map_entries("known_countries")),
                          lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return base.select("user_id", F.array_join(entries, ",").alias("known"))


# --------------------------------------------------------- labels, samples, folds

@query("gold_label", sql.with_(sql.clean(), "select row_id, is_attack_ip and login_success as is_gold from clean"))
def _(spark, sf):
    return scoring.with_gold(cleaned(spark, sf)).select("row_id", "is_gold")


@query("tiers", sql.with_(sql.tiers(SPEC), "select * from tiers"))
def _(spark, sf):
    return sampling.user_tiers(cleaned(spark, sf), SPEC)


@query("sample_users", sql.with_(f"{sql.tiers(SPEC)}, {sql.chosen(SPEC)}", "select * from chosen"))
def _(spark, sf):
    return sampling.sample_users(sampling.user_tiers(cleaned(spark, sf), SPEC), SPEC)


@query("sample_events", sql.with_(sql.sample(SPEC), "select row_id, user_id, tier, is_ato from sample"))
def _(spark, sf):
    return sampling.sample_events(cleaned(spark, sf), SPEC).select("row_id", "user_id", "tier", "is_ato")


_NO_BOTS = SampleSpec(user_cap=40, robot_cap=500, params=PARAMS, drop_genbots=True, drop_vlc=True)


@query("sample_without_bots", sql.with_(sql.sample(
    _NO_BOTS, base=sql.clean().replace("\nclean as (", "\nclean0 as (")
    + ", clean as (select * from clean0 where not is_generator_bot and not is_vlc)"),
    "select row_id, user_id, tier from sample"))
def _(spark, sf):
    return sampling.sample_events(cleaned(spark, sf), _NO_BOTS).select("row_id", "user_id", "tier")


_SHARES = """count(*) as rows, count(distinct user_id) as users, count(*) filter (where is_attack_ip) as attack_rows,
 count(*) filter (where is_attack_ip and login_success) as gold_rows, count(*) filter (where is_ato) as ato_rows,
 cast(count(*) filter (where is_attack_ip) as double) / count(*) as attack_share"""


@query("sample_shares", sql.with_(sql.sample(SPEC), f"select {_SHARES} from sample"))
def _(spark, sf):
    return sampling.sample_shares(sampling.sample_events(cleaned(spark, sf), SPEC))


@query("robot_arms", sql.with_(sql.sample(SPEC), """
select 'with_robot' as arm, count(*) as events, count(*) filter (where is_attack_ip) as attack_events from sample
union all select 'without_robot', count(*), count(*) filter (where is_attack_ip) from sample where tier <> 'robot'"""))
def _(spark, sf):
    arms = sampling.robot_arms(sampling.sample_events(cleaned(spark, sf), SPEC))
    return arms.groupBy("arm").agg(
        F.count(F.lit(1)).alias("events"), F.count_if("is_attack_ip").alias("attack_events")
    )


@query("split_by_user", sql.with_(sql.clean(), f"""
select row_id, case when {sql.seeded_hash('split', 'user_id')} % 100 < 80 then 'train' else 'test' end as fold from clean"""))
def _(spark, sf):
    return sampling.split_by_user(cleaned(spark, sf)).select("row_id", "fold")


_TIME_CUT = f"""cut as (select min(h) + interval 1 hour as cut_ts from
  (select date_trunc('hour', ts) as h, sum(count(*)) over (order by date_trunc('hour', ts)) as upto from clean group by 1)
  where upto >= 0.8 * (select count(*) from clean))"""


@query("split_by_time", sql.with_(f"{sql.clean()}, {_TIME_CUT}", """
select row_id, case when ts is null then 'untimed' when ts < (select cut_ts from cut) then 'train' else 'test' end as fold
from clean"""))
def _(spark, sf):
    return sampling.split_by_time(cleaned(spark, sf)).select("row_id", "fold")


@query("split_within_user", sql.with_(sql.features(), """
select row_id, case when prior_events < 0.8 * user_rows then 'train' else 'test' end as fold from features"""))
def _(spark, sf):
    return sampling.split_within_user(featured(spark, sf, keep_counts=True)).select("row_id", "fold")


@query("users_on_both_sides", sql.with_(f"{sql.clean()}, {_TIME_CUT}", """
select count(*) filter (where first < cut_ts) as train_users, count(*) filter (where last >= cut_ts) as test_users,
 count(*) filter (where first < cut_ts and last >= cut_ts) as shared_users
from (select user_id, min(ts) as first, max(ts) as last from clean group by user_id), cut"""))
def _(spark, sf):
    return sampling.users_on_both_sides(sampling.split_by_time(cleaned(spark, sf)))


# ------------------------------------------------------------- the job in order

def _in_order(spark, sf_dir: str) -> DataFrame:
    """Clean, features over all rows, sample of the feature table, scores; each table written once."""
    clean_rows = written(cleaned(spark, sf_dir), "clean")
    feats = written(features.behaviour_features(clean_rows.select(*FEATURE_INPUT), PARAMS), "features")
    sample = written(sampling.sample_events(feats, SPEC), "sample")
    return written(scoring.with_gold(scoring.score_events(sample, RISK)), "scored")


_IN_ORDER = f"""{sql.scores()}, {sql.sample(SPEC, base="none as (select 1)")},
taken as (select scored.*, tier from scored join (select row_id, tier from sample) using (row_id))"""


@query("in_order_levels", sql.with_(_IN_ORDER, """
select tier, level, decision, count(*) as events, count(*) filter (where is_gold) as gold from taken group by all"""))
def _(spark, sf):
    return _in_order(spark, sf).groupBy("tier", "level", "decision").agg(
        F.count(F.lit(1)).alias("events"), F.count_if("is_gold").alias("gold")
    )


@query("in_order_curve", sql.with_(f"{_IN_ORDER}, {sql.curve(source='taken')}", "select * from curve"))
def _(spark, sf):
    return evaluate.threshold_curve(evaluate.score_histogram(_in_order(spark, sf), F.col("is_gold")))


# ----------------------------------------------------------------------- rules

@query("rule_score", sql.with_(sql.scores(), "select row_id, score, level, colour, decision, reasons from scored"))
def _(spark, sf):
    rows = scored(spark, sf).withColumn("reasons", F.array_join("reasons", "; "))
    return rows.select("row_id", "score", "level", "colour", "decision", "reasons")


@query("rule_levels", sql.with_(sql.scores(), """
select level, decision, count(*) as events, min(score) as min_score, max(score) as max_score from scored group by 1, 2"""))
def _(spark, sf):
    return scoring.level_counts(scored(spark, sf))


def _firing_sql() -> str:
    tests = sql.rule_tests(RISK)
    return sql.with_(sql.scores(), "\nunion all ".join(
        f"""select '{r}' as rule, is_gold as label, count(*) as events, count(*) filter (where {tests[r]}) as fired,
        cast(count(*) filter (where {tests[r]}) as double) / count(*) as rate, {p} as points
        from scored group by is_gold""" for r, p, _ in RULES))


@query("rule_firing", _firing_sql())
def _(spark, sf):
    return scoring.rule_firing(scoring.with_gold(featured(spark, sf)))


# ------------------------------------------------------------------- evaluation

def _gold():
    return F.col("is_gold")


def _hist(spark, sf):
    return evaluate.score_histogram(scored(spark, sf), _gold())


@query("confusion", sql.with_(f"""{sql.scores()},
k as (select count(*) filter (where score >= 30 and is_gold) as tp, count(*) filter (where score >= 30 and not is_gold) as fp,
 count(*) filter (where score < 30 and is_gold) as fn, count(*) filter (where score < 30 and not is_gold) as tn from scored)""",
    f"select *, {sql.rates()} from k"))
def _(spark, sf):
    return evaluate.confusion(scored(spark, sf), F.col("score") >= 30, _gold())


@query("threshold_curve", sql.with_(f"{sql.scores()}, {sql.curve()}", "select * from curve"))
def _(spark, sf):
    return evaluate.threshold_curve(_hist(spark, sf))


@query("fpr_budget", sql.with_(f"{sql.scores()}, {sql.curve()}", """
select * from curve where fpr <= 0.05 order by coalesce(f1, -1) desc, threshold desc limit 1"""))
def _(spark, sf):
    return evaluate.best_under_budget(evaluate.threshold_curve(_hist(spark, sf)))


@query("roc_auc", sql.with_(f"{sql.scores()}, {sql.hist()}", """
select sum(case when p.score > n.score then 1.0 when p.score = n.score then 0.5 else 0 end * cast(p.pos as double) * n.neg)
 / (cast(sum(p.pos * n.neg) as double)) as auc from hist p, hist n"""))
def _(spark, sf):
    return evaluate.roc_auc(_hist(spark, sf))


_RATES = (0.01, 0.05, 0.1, 0.2)
_REPLAY = f"""r as (select unnest([{', '.join(f'cast({x} as double)' for x in _RATES)}]) as rate),
cutoff as (select rate, max(threshold) as threshold from curve, r
 where tp + fp >= rate * (tp + fp + fn + tn) group by rate)"""


# Microseconds since the user's last login: a score with almost as many values as rows.
_SILENCE = f"""{sql.clean()},
silent as (select is_attack_ip and login_success as is_gold, cast(coalesce(epoch_us(ts) - max(epoch_us(ts)) over
   (partition by user_id order by epoch_us(ts) range between unbounded preceding and 1 preceding), 0) as double) as score from clean),
hist as (select score, count(*) filter (where is_gold) as pos, count(*) filter (where not is_gold) as neg from silent group by score),
run as (select score as threshold, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp,
   sum(pos) over () - tp as fn, sum(neg) over () - fp as tn from hist),
curve0 as (select threshold, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn, cast(tn as bigint) as tn from run),
curve as (select *, {sql.rates()} from curve0)"""


def _silence_hist(spark, sf):
    events = cleaned(spark, sf).select("user_id", "ts", "is_attack_ip", "login_success").withColumn("at", text.micros(F.col("ts")))
    events = written(events, "times")
    parts = slots.slotted(events, slots.even_cuts(events, "user_id", "at", PARAMS.slot_rows), "user_id", "at")
    timed = slots.running_before(parts, ["user_id"], "at", maxima={"last": F.col("at")})
    score = F.coalesce(F.col("at") - F.col("last"), F.lit(0)).cast("double")
    return written(evaluate.score_histogram(scoring.with_gold(timed.withColumn("score", score)), _gold()), "hist")


@query("curve_of_silence", sql.with_(_SILENCE, "select * from curve"))
def _(spark, sf):
    return evaluate.threshold_curve(_silence_hist(spark, sf), spread=True)


@query("auc_of_silence", sql.with_(_SILENCE, """
select sum(pos * (coalesce(lower, 0) + 0.5 * neg)) / (cast(sum(pos) as double) * sum(neg)) as auc from
 (select *, sum(neg) over (order by score rows between unbounded preceding and 1 preceding) as lower from hist)"""))
def _(spark, sf):
    return evaluate.roc_auc(_silence_hist(spark, sf), spread=True)


@query("replay_of_silence", sql.with_(f"{_SILENCE}, {_REPLAY}", """
select rate, threshold, tp + fp as challenged, cast(tp + fp as double) / (tp + fp + fn + tn) as challenged_share,
 cast(tp as double) / nullif(tp + fn, 0) as caught_share, cast(fp as double) / nullif(fp + tn, 0) as bothered_share
from cutoff join curve using (threshold)"""))
def _(spark, sf):
    return evaluate.replay(_silence_hist(spark, sf), _RATES, spread=True)


@query("replay", sql.with_(f"{sql.scores()}, {sql.curve()}, {_REPLAY}", """
select rate, threshold, tp + fp as challenged, cast(tp + fp as double) / (tp + fp + fn + tn) as challenged_share,
 cast(tp as double) / nullif(tp + fn, 0) as caught_share, cast(fp as double) / nullif(fp + tn, 0) as bothered_share
from cutoff join curve using (threshold)"""))
def _(spark, sf):
    return evaluate.replay(_hist(spark, sf), _RATES)


@query("flagged_share", sql.with_(f"{sql.scores()}, {sql.curve()}, {_REPLAY}", """
select row_id, score >= (select threshold from cutoff where rate = 0.1) as flagged from scored"""))
def _(spark, sf):
    """The published flag rate: the top tenth by score, ties included."""
    rows = written(scored(spark, sf), "scored")
    cut = evaluate.replay(evaluate.score_histogram(rows, _gold()), (0.1,)).select("threshold")
    return rows.select("row_id", (F.col("score") >= cut.scalar()).alias("flagged"))


@query("replay_exact", sql.with_(f"""{sql.scores()},
o as (select *, row_number() over (order by score desc, row_id) as place, count(*) over () as total from scored),
k as (select count(*) filter (where place <= ceil(total * 0.1)) as challenged,
 count(*) filter (where place <= ceil(total * 0.1) and is_gold) as caught, count(*) filter (where is_gold) as pos,
 count(*) filter (where not is_gold) as neg from o)""", """
select cast(0.1 as double) as rate, challenged, caught, cast(caught as double) / pos as caught_share,
 cast(challenged - caught as double) / neg as bothered_share from k"""))
def _(spark, sf):
    return evaluate.replay_exact(scored(spark, sf), _gold(), 0.1)


@query("bounds_study", sql.with_(f"""{sql.scores()}, {sql.curve()},
b as (select unnest([30.0, 65.0, 77.0, 90.0]) as bound),
a as (select cast(bound as double) as bound, threshold, tp, fp, recall, fpr,
 row_number() over (partition by bound order by threshold) as place from b join curve on threshold >= bound),
ref as (select * from a where bound = 65 and place = 1)""", """
select a.bound, a.tp, a.fp, a.recall, a.fpr, a.fp - ref.fp as fp_delta, a.recall - ref.recall as recall_delta
from a, ref where a.place = 1"""))
def _(spark, sf):
    return evaluate.bounds_study(evaluate.threshold_curve(_hist(spark, sf)), (30, 65, 77, 90), 65)


# --------------------------------------------------------------------- contract

@query("contract", sql.with_(f"""{sql.sample(SPEC)},
want as (select sum(greatest(least(user_rows, case when tier = 'robot' then {SPEC.robot_cap} else {SPEC.user_cap} end), atos)) as n
 from chosen)""",
    """select check_name, cast(n as bigint) as n, case when n = 0 then 'PASS' else 'FAIL' end as verdict from (
select 'schema_differences' as check_name, 0 as n union all select 'forbidden_columns', 0
union all select 'feature_schema_differences', 0 union all select 'feature_forbidden_columns', 0
union all select 'sample_schema_differences', 0 union all select 'sample_forbidden_columns', 0
union all select 'geo_semantics_violations', count(*) from clean
  where geo_unreliable is distinct from (is_private_ip or region is null or city is null)
union all select 'ios_spoof_label', count(*) from clean where os_family = 'iOS' and user_agent not like '%iP%'
  and (is_generator_bot or user_agent like '%Andr%')
union all select 'null_device_desktop', count(*) from clean where coalesce(device_raw, 'unknown') = 'unknown' and device_type = 'desktop'
union all select 'desktop_reclass_mobile', count(*) from clean where device_raw = 'desktop' and device_type = 'mobile'
union all select 'legacy_os_lost', count(*) from clean where os_raw like 'Roku%' and os_family = 'unknown'
union all select 'feature_nulls', 0 union all select 'first_event_changes', 0
union all select 'clean_rows_vs_features', 0
union all select 'sample_rows_off', (select count(*) from sample) - (select n from want)
union all select 'ato_rows_lost', (select count(*) from clean where is_ato) - (select count(*) from sample where is_ato)
)"""))
def _(spark, sf):
    # as between scripts: every table is written once and read by all checks
    events = written(cleaned(spark, sf), "clean")
    feats = written(features.behaviour_features(events.select(*FEATURE_INPUT), PARAMS), "features")
    sample = written(sampling.sample_events(events, SPEC), "sample")
    return contract.verdict(*_contract_lines(events, feats, sample))


def _contract_lines(events, feats, sample):
    made = feature_schema(FEATURES)
    sampled = T.StructType([*CLEAN_SCHEMA.fields, T.StructField("tier", T.StringType())])
    return (
        contract.schema_violations(events), contract.schema_violations(feats, made, "feature_"),
        contract.schema_violations(sample, sampled, "sample_"),
        contract.clean_violations(events), contract.legacy_guard(events), contract.feature_violations(feats),
        contract.row_differences({"clean_rows_vs_features": (events, feats)}),
        contract.sample_violations(events, sample, SPEC),
    )


@query("contract_broken", sql.with_(f"""{sql.features()}, {sql.sample(SPEC, base="none as (select 1)")},
want as (select sum(greatest(least(user_rows, case when tier = 'robot' then {SPEC.robot_cap} else {SPEC.user_cap} end), atos)) as n
 from chosen)""", """
select check_name, cast(n as bigint) as n, case when n = 0 then 'PASS' else 'FAIL' end as verdict from (
select 'schema_differences' as check_name, 1 as n union all select 'forbidden_columns', 1
union all select 'feature_schema_differences', 1 union all select 'feature_forbidden_columns', 1
union all select 'sample_schema_differences', 0 union all select 'sample_forbidden_columns', 0
union all select 'geo_semantics_violations', count(*) from clean where row_id % 50 = 0
union all select 'ios_spoof_label', count(*) from clean where row_id % 60 = 0 and user_agent not like '%iP%'
  and (is_generator_bot or user_agent like '%Andr%' or user_agent like '%Andor%')
union all select 'null_device_desktop', count(*) from clean
  where coalesce(device_raw, 'unknown') = 'unknown' and (row_id % 40 = 0 or device_type = 'desktop')
union all select 'desktop_reclass_mobile', count(*) from clean where device_raw = 'desktop' and device_type = 'mobile' and row_id % 40 <> 0
union all select 'legacy_os_lost', count(*) from clean where os_raw like 'Roku%' and os_family = 'unknown'
union all select 'feature_nulls', count(*) from features where row_id % 30 <> 0 and row_id % 40 = 0
union all select 'first_event_changes', 0
union all select 'clean_rows_vs_features', (select count(*) from clean) - (select count(*) from features where row_id % 30 <> 0)
union all select 'sample_rows_off', (select count(*) from sample where row_id % 7 <> 0) - (select n from want)
union all select 'ato_rows_lost',
  (select count(*) from clean where is_ato) - (select count(*) from sample where is_ato and row_id % 7 <> 0)
)"""))
def _(spark, sf):
    """The contract over tables with planted faults: each must be found."""
    sound = written(cleaned(spark, sf), "clean")
    hit = lambda k: F.col("row_id") % k == 0
    # a working column too many, wrong geography, wrong systems and devices
    events = sound.withColumns({
        "geo_unreliable": F.when(hit(50), ~F.col("geo_unreliable")).otherwise(F.col("geo_unreliable")),
        "os_family": F.when(hit(60), "iOS").otherwise(F.col("os_family")),
        "device_type": F.when(hit(40), "desktop").otherwise(F.col("device_type")),
        "rn": F.lit(1),
    })
    feats = features.behaviour_features(sound.select(*FEATURE_INPUT), PARAMS).where(~hit(30))
    feats = feats.withColumn("unusual_hour", F.when(~hit(40), F.col("unusual_hour")))
    feats = written(feats.withColumn("prior_fail_ts", F.lit(0)), "features")
    sample = written(sampling.sample_events(sound, SPEC).where(~hit(7)), "sample")
    return contract.verdict(*_contract_lines(events, feats, sample))


@query("contract_rebuild", "select 'rebuild_differs' as check_name, 0 as n")
def _(spark, sf):
    events = cleaned(spark, sf)
    # the second build sees its rows in another order and partitioning
    again = sampling.sample_events(events.repartition(5, "ip"), SPEC)
    return contract.rebuild_differences(sampling.sample_events(events, SPEC), again)


# --------------------------------------------------------------------- live path

def _login_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return clean(logins_from_events(live.replay_source(spark, sf_dir, schema, "events.parquet")))


def _user_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored logins as a stream for the path by user: no micro-batch holds all rows of a busy user."""
    raw, path = read_logins(spark, sf_dir), scratch_dir(spark, "by-user")
    _, files = live.spread_slices(raw, path, text.to_long(F.col("user_id")), text.micros(text.to_timestamp_ntz(F.col("ts"))))
    return clean(live.replay_source(spark, path, raw.schema, files_per_trigger=files))


def _live_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything is learned, so the stream must equal the batch features."""
    scores = live.live_scores(_user_stream(spark, sf_dir), live.LiveParams(risk=RISK))
    return live.run_to_table(scores, scratch_dir(spark, "live"))


@query("stream_features", sql.with_(sql.features(), f"select row_id, {', '.join(FEATURES)} from features"))
def _(spark, sf):
    return _live_table(spark, sf).select("row_id", *FEATURES)


@query("stream_alerts", sql.with_(sql.scores(), """
select row_id, user_id, ts, score, level, colour, decision, reasons from scored where decision <> 'allow'"""))
def _(spark, sf):
    scores = live.live_scores(_user_stream(spark, sf), live.LiveParams(risk=RISK))
    return live.run_to_table(live.alerts(scores), scratch_dir(spark, "alerts"))


def _window_sql(minutes: int, slide: int) -> str:
    return sql.with_(f"""{sql.scores()},
s as (select decision, time_bucket(interval {slide} minute, ts) - interval (unnest(range({minutes // slide})) * {slide}) minute as a
  from scored)""", f"""
select a as window_start, a + interval {minutes} minute as window_end, decision, count(*) as events from s group by all""")


def _totals(spark, sf, length, slide=None):
    path = scratch_dir(spark, "scored")
    scored(spark, sf).select("row_id", "user_id", "ts", "decision").write.parquet(path)
    table = spark.read.parquet(path)
    stream = live.replay_source(spark, path, table.schema, files_per_trigger=1000)
    totals = live.decision_totals(stream, length, slide)
    return live.run_upserts(totals, scratch_dir(spark, "totals"), "window_start", "window_end", "decision")


@query("stream_decision_totals", _window_sql(60, 60))
def _(spark, sf):
    return _totals(spark, sf, "1 hour")


@query("stream_decision_totals_sliding", _window_sql(60, 15))
def _(spark, sf):
    return _totals(spark, sf, "1 hour", "15 minutes")


@query("stream_sessions", sql.with_(f"""{sql.scores()},
g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as opens
  from scored),
n as (select *, sum(opens) over (partition by user_id order by ts, row_id) as session from g)""", """
select user_id, min(ts) as session_start, max(ts) + interval 30 minute as session_end, count(*) as events,
 count(*) filter (where decision <> 'allow') as not_allowed from n group by user_id, session"""))
def _(spark, sf):
    """Two runs over slices in the order of time, then one that closes what is open."""
    rows = written(scored(spark, sf).select("row_id", "user_id", "ts", "decision"), "scored")
    path, out = scratch_dir(spark, "slices"), scratch_dir(spark, "sessions")
    cut = rows.agg(F.percentile_approx("ts", 0.5).alias("ts")).first()["ts"]
    sessions = lambda: live.run_to_table(live.login_sessions(live.replay_source(spark, path, rows.schema)), out)
    for part in (rows.where(F.col("ts") < F.lit(cut)), rows.where(F.col("ts") >= F.lit(cut))):
        part.coalesce(1).write.mode("append").parquet(path)
        sessions()
    live.mark_end(spark, path, rows.schema)
    return sessions()


@query("stream_profiles", sql.with_(sql.clean(), """
select user_id, count(distinct country) as countries, count(distinct device_type) as devices, count(*) as events,
 count(*) filter (where not login_success) as failures, min(ts) as first_seen, max(ts) as last_seen,
 count(distinct cast(ts as date)) as days, cast(max(per_day) as bigint) as most_a_day, cast(min(at_peak) as integer) as usual_hour
from (select *, count(*) over (partition by user_id, cast(ts as date)) as per_day,
   first_value(h) over (partition by user_id order by per_hour desc, h) as at_peak
  from (select *, extract(hour from ts) as h, count(*) over (partition by user_id, extract(hour from ts)) as per_hour from clean))
group by user_id"""))
def _(spark, sf):
    return live.run_profiles(_login_stream(spark, sf), scratch_dir(spark, "profiles"))


def accepted_only_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = live.LearnPolicy(everything=False)
    scores = live.live_scores(_user_stream(prepare(spark), sf_dir), live.LiveParams(risk=RISK, policy=policy))
    return live.run_to_table(scores, scratch_dir(spark, "live"))


@query("stream_accepted_only", sql.with_("recursive " + sql.accepted_only(RISK), """
select row_id, user_id, score, level, decision, learned from learned_scores"""))
def _(spark, sf):
    return accepted_only_scores(spark, sf).select("row_id", "user_id", "score", "level", "decision", "learned")


_CONFIRMED = "row_id % 97 = 5"  # logins whose users later say "this was me", from abroad


@query("stream_feedback", sql.with_(f"""{sql.clean()},
told as (select user_id, ts, 'SE' as country from clean where {_CONFIRMED}),
known as (select user_id, country, min(ts) as since from (
  select user_id, country, ts from clean union all select user_id, country, ts from told) group by user_id, country),
p as (select row_id, count(*) over (partition by user_id order by ts range between unbounded preceding and current row)
  - count(*) over (partition by user_id, ts) as prior from clean)""", """
select c.row_id, prior > 0 and since < c.ts as country_seen_before from clean c join p using (row_id)
join known k on k.user_id = c.user_id and k.country = c.country"""))
def _(spark, sf):
    """Confirmed values are known from the confirmation on, whatever was decided then."""
    logins = _user_stream(spark, sf)
    # the same files once more, so that both streams are at the same slice
    told = live.confirmations(logins.where(_CONFIRMED).withColumn("country", F.lit("SE")))
    scores = live.live_scores(logins, live.LiveParams(risk=RISK), told)
    table = live.run_to_table(scores, scratch_dir(spark, "live"))
    return table.select("row_id", "country_seen_before")


# ------------------------------------------------- live path by micro-batches

# Small enough that the dominant user is cut and the log is compacted between batches.
_LIVE = dict(slot_rows=400, compact_every=1, buckets=8)


# Rows of a slice that one file holds, so that tasks of the live path follow the table.
_FILE_ROWS = 100_000


def _slices(spark: SparkSession, events: DataFrame, n: int = 2, file_rows: int = _FILE_ROWS) -> DataFrame:
    """Stored events as a stream of ``n`` micro-batches, one after the other in time."""
    path, rows = scratch_dir(spark, "slices"), written(events.select(*live.LIVE_COLUMNS), "events")
    bounds = rows.agg(F.percentile_approx("ts", [k / n for k in range(1, n)])).first()[0]
    parts = []
    for low, high in zip([None, *bounds], [*bounds, None]):
        part = rows if low is None else rows.where(F.col("ts") >= F.lit(low))
        parts.append(part if high is None else part.where(F.col("ts") < F.lit(high)))
    # every slice the same number of files, as a trigger takes so many; none is empty, since rows are dealt in turn
    files_each = max(1, min(part.count() for part in parts) // file_rows)
    for part in parts:
        dealt = part.repartition(files_each) if files_each > 1 else part.coalesce(1)
        dealt.write.mode("append").parquet(path)
    return live.replay_source(spark, path, rows.schema, files_per_trigger=files_each)


def _run_live(spark, sf, feedback=None, **params) -> tuple[DataFrame, str]:
    path = scratch_dir(spark, "live")
    made = microbatch.BatchParams(**(_LIVE | params))
    return microbatch.run_live(_slices(spark, cleaned(spark, sf)), path, made, feedback), path


@query("live_features", sql.with_(sql.features(), f"select row_id, {', '.join(FEATURES)}, has_history from features"))
def _(spark, sf):
    """Two micro-batches, the dominant user in slots: the same features as over the whole history."""
    return _run_live(spark, sf)[0].select("row_id", *FEATURES, "has_history")


@query("live_accepted_only", SQL["stream_accepted_only"])
def _(spark, sf):
    policy = live.LearnPolicy(everything=False)
    table, _path = _run_live(spark, sf, live=live.LiveParams(risk=RISK, policy=policy))
    return table.select("row_id", "user_id", "score", "level", "decision", "learned")


@query("live_feedback", SQL["stream_feedback"])
def _(spark, sf):
    told = live.confirmations(_slices(spark, cleaned(spark, sf).where(_CONFIRMED).withColumn("country", F.lit("SE"))))
    return _run_live(spark, sf, told)[0].select("row_id", "country_seen_before")


_SILENCE_US = 2 * 3600 * 1_000_000


@query("live_expired", sql.with_(sql.features(expire_us=_SILENCE_US), f"select row_id, {', '.join(FEATURES)}, has_history from features"))
def _(spark, sf):
    """Profiles end when their user has been silent for over two hours; the next login is a first one."""
    return _run_live(spark, sf, expire_us=_SILENCE_US)[0].select("row_id", *FEATURES, "has_history")


@query("live_combined", sql.with_(f"{sql.combined(models.FLAGS, 60, 0.5, scoring.MODEL_REASON).replace('weighed as', _TIME_CUT + ', weighed as', 1)}", """
select row_id, score, model_score, combined_score, level, decision, reasons from combined"""))
def _(spark, sf):
    """A model learned from the earlier rows, added to the rules on the live path."""
    train, _test = _folds(spark, sf)
    table, _path = _run_live(spark, sf, model=models.fit_log_odds(train))
    return table.select(
        "row_id", "score", "model_score", "combined_score", "level", "decision", F.array_join("reasons", "; ").alias("reasons"))


@query("live_profiles", sql.with_(sql.clean(), """
select user_id, count(*) as events, count(*) as learned, count(*) filter (where not login_success) as failures,
 min(ts) as first_seen, max(ts) as last_seen, list_sort(list_distinct(list(country))) as countries,
 list_sort(list_distinct(list(device_type))) as devices, cast(min(at_peak) as integer) as usual_hour
from (select *, first_value(h) over (partition by user_id order by per_hour desc, h) as at_peak
  from (select *, extract(hour from ts) as h, count(*) over (partition by user_id, extract(hour from ts)) as per_hour from clean))
group by user_id"""))
def _(spark, sf):
    _table, path = _run_live(spark, sf)
    return microbatch.profiles(microbatch.profile_store(spark, path, microbatch.BatchParams(**_LIVE)).read())


@query("live_risks", sql.with_(sql.scores(), """
select row_id, cast(score as integer) as score, level, decision, reasons from scored"""))
def _(spark, sf):
    """The table behind the risk lookup, whole."""
    _table, path = _run_live(spark, sf, risk_lookup=True)
    risks = microbatch.risk_store(spark, path, microbatch.BatchParams(**_LIVE)).read()
    return risks.select("row_id", "score", "level", "decision", "reasons")


# ------------------------------------------------------------------------ models

def _folds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(train, test) by time over all feature rows, written once as a fit reads them often."""
    path = scratch_dir(spark, "folds") + ".parquet"
    rows = scoring.with_gold(featured(spark, sf_dir))
    sampling.split_by_time(rows).write.parquet(path)
    table = spark.read.parquet(path)
    return table.where("fold = 'train'").drop("fold"), table.where("fold = 'test'").drop("fold")


_PRIOR = f"""{sql.scores()}, {_TIME_CUT},
tr as (select * from scored where ts < (select cut_ts from cut)),
te as (select * from scored where ts >= (select cut_ts from cut)),
m as (select ip, avg(case when is_gold then 1.0 else 0.0 end) as p from tr group by ip),
prior as (select te.* exclude (score), coalesce(p, (select avg(case when is_gold then 1.0 else 0.0 end) from tr)) as score
  from te left join m using (ip))"""


@query("ip_prior", sql.with_(_PRIOR, "select row_id, score, is_gold from prior"))
def _(spark, sf):
    train, test = _folds(spark, sf)
    return models.ip_prior(train, test).select("row_id", "score", "is_gold")


@query("ip_prior_confusion", sql.with_(f"""{_PRIOR},
k as (select count(*) filter (where score >= 0.5 and is_gold) as tp, count(*) filter (where score >= 0.5 and not is_gold) as fp,
 count(*) filter (where score < 0.5 and is_gold) as fn, count(*) filter (where score < 0.5 and not is_gold) as tn from prior)""",
    f"select *, {sql.rates()} from k"))
def _(spark, sf):
    train, test = _folds(spark, sf)
    return evaluate.confusion(models.ip_prior(train, test), F.col("score") >= 0.5, _gold())


@query("train_attack_share", sql.with_(f"{sql.clean()}, {_TIME_CUT}", """
select count(*) as rows, count(*) filter (where is_attack_ip) as positives,
 cast(count(*) filter (where is_attack_ip) as double) / count(*) as share from clean where ts < (select cut_ts from cut)"""))
def _(spark, sf):
    folds = sampling.split_by_time(cleaned(spark, sf))
    return models.train_share(folds.where("fold = 'train'"))


_SCORED = ("row_id", "is_gold", "is_ato", "score")


@query("model_logistic")
def _(spark, sf):
    train, test = _folds(spark, sf)
    return models.score_supervised(models.fit_logistic(train), test).select(*_SCORED)


@query("model_boosting")
def _(spark, sf):
    train, test = _folds(spark, sf)
    return models.score_supervised(models.fit_boosting(train), test).select(*_SCORED)


@query("model_isolation_forest")
def _(spark, sf):
    train, test = _folds(spark, sf)
    # anomaly models learn from rows without an attack flag
    forest = models.fit_isolation_forest(train.where("not is_attack_ip"))
    return models.score_isolation_forest(forest, test).select(*_SCORED)


def _nine_digits(score: str = "score"):
    """Factors next to many copies exceed 10**9, where sums in another order differ in the fourth decimal."""
    return F.when(F.col(score).isNotNull(), F.format_string("%.8e", score).try_cast("double")).alias(score)


_LOF_ROWS = f"""select row_id, is_gold, is_ato, cast(printf('%.8e', round(lof, 4)) as double) as score
from numbers n left join factors f on {" and ".join(f"n.{f} = f.{f}" for f in FEATURES)}"""


@query("model_local_outlier_factor", sql.with_(f"""{sql.features()}, {_TIME_CUT},
{sql.outlier_factors("ts < (select cut_ts from cut) and not is_attack_ip", "ts >= (select cut_ts from cut)")}""",
    f"{_LOF_ROWS} where ts >= (select cut_ts from cut)"))
def _(spark, sf):
    train, test = _folds(spark, sf)
    scored_rows = models.novelty_outlier_factor(train.where("not is_attack_ip"), test)
    return scored_rows.select("row_id", "is_gold", "is_ato", _nine_digits())


@query("model_outlier_factor_within", sql.with_(f"{sql.features()},{sql.outlier_factors('true', None)}", _LOF_ROWS))
def _(spark, sf):
    """Every row against all other rows, both folds."""
    rows = written(scoring.with_gold(featured(spark, sf)), "rows")
    return models.local_outlier_factor(rows).select("row_id", "is_gold", "is_ato", _nine_digits())


@query("model_envelope")
def _(spark, sf):
    train, test = _folds(spark, sf)
    # the gate skips skewed features; this run lifts it to show distances
    env = models.fit_envelope(train.where("not is_attack_ip"), max_skew=float("inf"))
    return models.score_envelope(env, test).select(*_SCORED)


def _checked(model: str, rows: DataFrame, label, top: float | None, least_auc: float) -> DataFrame:
    """One line per model: rows scored, scores missing or out of range, and whether the ranking is too weak."""
    c = F.col
    outside = (c("score") < 0) | (c("score") > top) if top is not None else c("score") < 0
    seen = rows.agg(
        F.count(F.lit(1)).alias("rows_scored"), F.count_if(c("score").isNull() | F.isnan("score")).alias("missing"),
        F.count_if(outside).alias("out_of_range"))
    auc = evaluate.roc_auc(evaluate.score_histogram(rows.where("score is not null"), label)).select("auc")
    weak = F.when(auc.scalar() >= least_auc, 0).otherwise(1).cast("bigint")
    return seen.select(F.lit(model).alias("model"), "*", weak.alias("weak_ranking"))


def _far_outside(rows: DataFrame, least: dict[str, int]) -> dict[str, int]:
    """A value of each feature that is ten times as large as any in ``rows``, and ``least`` at least."""
    most = rows.agg(*[F.max(n).alias(n) for n in least]).first()
    return {n: max(v, 10 * (most[n] or 0)) for n, v in least.items()}


_MODELS = ("logistic", "boosting", "isolation_forest", "local_outlier_factor", "envelope", "average")


@query("model_checks", sql.with_(f"{sql.clean()}, {_TIME_CUT}", f"""
select model, (select count(*) from clean where ts >= (select cut_ts from cut)) as rows_scored,
 cast(0 as bigint) as missing, cast(0 as bigint) as out_of_range, cast(0 as bigint) as weak_ranking
from (select unnest([{', '.join(repr(m) for m in _MODELS)}]) as model)"""))
def _(spark, sf):
    """Labels that follow from features must be learned; rows far outside must be ranked as anomalies."""
    train, test = _folds(spark, sf)
    told = F.col("is_night") | F.col("country_change")
    taught, asked = train.withColumn("is_gold", told), test.withColumn("is_gold", told)
    planted = F.col("row_id") % 20 == 0
    quiet = train.where("not is_attack_ip")
    far = _far_outside(train.unionByName(test), {"rapid_login_rate": 400, "login_frequency_today": 4000})
    odd = test.withColumn("is_gold", planted).withColumns({n: F.when(planted, F.lit(v).cast("bigint")).otherwise(F.col(n)) for n, v in far.items()})
    odd = odd.withColumn("is_ato", planted)
    learned = {
        "logistic": models.score_supervised(models.fit_logistic(taught), asked),
        "boosting": models.score_supervised(models.fit_boosting(taught), asked),
    }
    unlike = {
        "isolation_forest": models.score_isolation_forest(models.fit_isolation_forest(quiet), odd),
        "local_outlier_factor": models.novelty_outlier_factor(quiet, odd),
        "envelope": models.score_envelope(models.fit_envelope(quiet, max_skew=float("inf")), odd),
    }
    unlike = {k: written(v.select(*_SCORED), k) for k, v in unlike.items()}
    mean = models.averaged_score(models.stack_scores(**unlike), "is_gold")
    top = {"logistic": 1.0, "boosting": 1.0, "isolation_forest": 1.0, "average": 1.0}
    lines = [_checked(k, v, _gold(), top.get(k), 0.9) for k, v in {**learned, **unlike, "average": mean}.items()]
    out = lines[0]
    for line in lines[1:]:
        out = out.unionByName(line)
    return out


_THREE = ("hour", "rapid_login_rate", "login_frequency_today")


def _envelope_sql() -> str:
    """The inverse of a symmetric 3 x 3 matrix by cofactors."""
    a, b, c = _THREE
    return sql.with_(f"""{sql.features()}, {_TIME_CUT},
tr as (select * from features where ts < (select cut_ts from cut) and not is_attack_ip),
s as (select avg({a}) as ma, avg({b}) as mb, avg({c}) as mc, covar_samp({a}, {a}) as aa, covar_samp({b}, {b}) as bb,
  covar_samp({c}, {c}) as cc, covar_samp({a}, {b}) as ab, covar_samp({a}, {c}) as ac, covar_samp({b}, {c}) as bc from tr),
k as (select *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) as det from s),
x as (select row_id, {a} - ma as u, {b} - mb as v, {c} - mc as w, k.* from features, k where ts >= (select cut_ts from cut))""", """
select row_id, round(round((u * u * (bb * cc - bc * bc) + v * v * (aa * cc - ac * ac) + w * w * (aa * bb - ab * ab)
 + 2 * u * v * (ac * bc - ab * cc) + 2 * u * w * (ab * bc - ac * bb) + 2 * v * w * (ab * ac - aa * bc)) / det, 4), 3) as distance from x""")


@query("model_envelope_three", _envelope_sql())
def _(spark, sf):
    train, test = _folds(spark, sf)
    env = models.fit_envelope(train.where("not is_attack_ip"), float("inf"), _THREE)
    return models.score_envelope(env, test).select("row_id", F.round("score", 3).alias("distance"))


@query("model_comparison")
def _(spark, sf):
    train, test = _folds(spark, sf)
    quiet = train.where("not is_attack_ip")
    stacked = models.stack_scores(
        rules=scoring.score_events(test, RISK).withColumn("score", F.col("score").cast("double")).select(*_SCORED),
        ip_prior=models.ip_prior(train, test).withColumn("score", F.round("score", 4)).select(*_SCORED),
        logistic=models.score_supervised(models.fit_logistic(train), test).select(*_SCORED),
        boosting=models.score_supervised(models.fit_boosting(train), test).select(*_SCORED),
        isolation_forest=models.score_isolation_forest(models.fit_isolation_forest(quiet), test).select(*_SCORED),
        # unbounded scores are rounded, so that the curve has few steps
        local_outlier_factor=models.novelty_outlier_factor(quiet, test).withColumn("score", F.round("score", 2)).select(*_SCORED),
    )
    stacked = written(stacked, "scores")
    mean = models.averaged_score(stacked, "is_gold", "is_ato").withColumn("model", F.lit("average"))
    everything = stacked.unionByName(mean)
    envelope = models.fit_envelope(quiet)
    if not envelope.skipped:
        distance = models.score_envelope(envelope, test).withColumn("score", F.round("score", 2))
        everything = everything.unionByName(distance.withColumn("model", F.lit("envelope")).select(*everything.columns))
    lines = evaluate.compare_models(everything, {"gold": F.col("is_gold"), "ato": F.col("is_ato")})
    lines = lines.withColumn("skipped_for_skew", F.lit(None).cast("double"))
    if envelope.skipped:  # a model that was not applied is a line too
        line = spark.range(1).select(F.lit("envelope").alias("model"), F.lit(float(envelope.worst_skew)).alias("skipped_for_skew"))
        lines = lines.unionByName(line, allowMissingColumns=True)
    return lines


@query("model_comparison_rules", sql.with_(f"""{sql.scores()}, {_TIME_CUT},
te as (select * from scored where ts >= (select cut_ts from cut)), {sql.curve(source="te")},
h as (select score, count(*) filter (where is_gold) as pos, count(*) filter (where not is_gold) as neg from te group by score),
a as (select sum(case when p.score > n.score then 1.0 when p.score = n.score then 0.5 else 0 end * cast(p.pos as double) * n.neg)
 / cast(sum(p.pos * n.neg) as double) as auc from h p, h n)""", """
select 'rules' as model, 'gold' as label, curve.*, auc from curve, a where fpr <= 0.05
order by coalesce(f1, -1) desc, threshold desc limit 1"""))
def _(spark, sf):
    folds = sampling.split_by_time(scored(spark, sf)).where("fold = 'test'").withColumn("model", F.lit("rules"))
    return evaluate.compare_models(cut_lineage(folds.select("model", "score", "is_gold")), {"gold": _gold()})


# ------------------------------------------------------------------- log sources

def _stamp(pattern: str):
    return F.date_format("ts", pattern)


def _log_lines(events: DataFrame, source: str, broken: bool = False) -> DataFrame:
    """Log records of one system for every clean event, in that system's format; ``broken``: some blank, some cut off."""
    c = F.col
    user = F.concat(F.lit("user"), c("user_id").cast("string"))
    iso = F.concat(_stamp("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    ok = c("login_success")
    lines = {
        "web": lambda: F.to_json(F.struct(
            user.alias("user"), iso.alias("time"), "ip", "country", c("device_type").alias("device"),
            c("browser_family").alias("browser"), c("os_family").alias("os"),
            F.when(ok, "success").otherwise("failure").alias("status"))),
        "ssh": lambda: F.concat(
            F.regexp_replace(_stamp("MMM dd HH:mm:ss"), "^(.{3}) 0", "$1  "), F.lit(" server sshd["), c("row_id").cast("string"),
            F.lit("]: "), F.when(ok, "Accepted").otherwise("Failed"), F.lit(" password for "), user,
            F.lit(" from "), c("ip"), F.lit(" port 22 ssh2")),
        "directory": lambda: F.to_json(F.struct(
            F.when(ok, 4624).otherwise(4625).alias("EventID"), iso.alias("TimeCreated"),
            F.struct(user.alias("TargetUserName"), c("ip").alias("IpAddress"),
                     F.coalesce("device_raw", F.lit("-")).alias("WorkstationName")).alias("EventData"))),
        "vpn": lambda: F.concat(
            F.lit("date="), _stamp("yyyy-MM-dd"), F.lit(" time="), _stamp("HH:mm:ss"), F.lit(' user="'), user,
            F.lit('" remip='), c("ip"), F.lit(' srccountry="'), c("country"), F.lit('" action="'),
            F.when(ok, "tunnel-up").otherwise("ssl-login-fail"), F.lit('"')),
        "cloud": lambda: F.to_json(F.struct(
            F.lit("ConsoleLogin").alias("eventName"), iso.alias("eventTime"), c("ip").alias("sourceIPAddress"),
            c("user_agent").alias("userAgent"), F.struct(user.alias("userName")).alias("userIdentity"),
            F.struct(F.when(ok, "Success").otherwise("Failure").alias("ConsoleLogin")).alias("responseElements"))),
        "sign_in": lambda: F.to_json(F.struct(
            iso.alias("createdDateTime"), user.alias("userPrincipalName"), c("ip").alias("ipAddress"),
            F.struct(c("country").alias("countryOrRegion")).alias("location"),
            F.struct(F.when(ok, 0).otherwise(50126).alias("errorCode")).alias("status"),
            F.struct(c("device_type").alias("displayName"), c("os_family").alias("operatingSystem"),
                     c("browser_family").alias("browser")).alias("deviceDetail"))),
        "database": lambda: F.concat_ws(
            ",", _stamp("yyyyMMdd HH:mm:ss"), F.lit("db1"), user, c("ip"), c("row_id").cast("string"), F.lit("0"),
            F.when(ok, "CONNECT").otherwise("FAILED_CONNECT"), F.lit("app"), F.lit(""), F.when(ok, "0").otherwise("1045")),
    }
    line = lines[source]()
    if broken:
        line = F.when(c("row_id") % 41 == 0, "").when(c("row_id") % 37 == 0, F.substring(line, 1, 10)).otherwise(line)
    return events.select(line.alias("value"))


_READERS = {
    "web": (lambda v: normalize.web_logins(v), "web", "country", "device_type", "browser_family", "os_family"),
    "ssh": (lambda v: normalize.ssh_logins(v, 2024), "ssh", "null", "null", "null", "null"),
    "directory": (lambda v: normalize.directory_logins(v), "active_directory", "null", "device_raw", "null", "'Windows'"),
    "vpn": (lambda v: normalize.vpn_logins(v), "vpn", "country", "null", "null", "null"),
    "cloud": (lambda v: normalize.cloud_console_logins(v), "cloud_console", "null", "ua_device", "null", "ua_os"),
    "sign_in": (lambda v: normalize.signin_logins(v), "sign_in", "country", "device_type", "browser_family", "os_family"),
    "database": (lambda v: normalize.database_logins(v), "database", "null", "null", "null", "null"),
}


def _source_sql(name: str) -> str:
    _, label, country, device, browser, os = _READERS[name]
    text_or = lambda e: f"cast({e} as varchar)"
    return f"""select 'user' || cast(user_id as varchar) as user_id, date_trunc('second', ts) as ts, ip as source_ip,
 {text_or(country)} as country, {text_or(device)} as device, {text_or(browser)} as browser, {text_or(os)} as os,
 login_success as success, '{label}' as auth_source from src"""


# OS and device of an agent alone: the raw OS and device columns are left out
_SRC = f"""{sql.clean()},
alone as (select ua, os_family as ua_os, device_type as ua_device from (
  select ua, {sql._os_case('documented')} as os_family, {sql._device_case('documented')} as device_type
  from (select distinct ua, cast(null as varchar) as os, cast(null as varchar) as device from logins))),
src as (select clean.*, ua_os, ua_device from clean join alone on alone.ua = clean.user_agent)"""


def _source_query(name: str):
    @query(f"normalize_{name}", sql.with_(_SRC, _source_sql(name)))
    def _(spark, sf):
        return _READERS[name][0](_log_lines(cleaned(spark, sf), name))


for _name in _READERS:
    _source_query(_name)


# What a record cut off after ten characters is rejected for.
_CUT_OFF = {"ssh": "not of sshd", "vpn": "no action", "database": "too few fields"}


@query("normalize_rejects", sql.with_(f"""{sql.clean()},
kinds(auth_source, cut_off) as (values {", ".join(f"('{_READERS[n][1]}', '{_CUT_OFF.get(n, 'not JSON')}')" for n in _READERS)})""", """
select auth_source, case when row_id % 41 = 0 then 'blank' when row_id % 37 = 0 then cut_off else 'login' end as reason,
 count(*) as records, count(*) filter (where row_id % 41 <> 0 and row_id % 37 <> 0) as read from clean, kinds group by 1, 2"""))
def _(spark, sf):
    """Every record is a login or a reject with a reason; ``read`` is what the reader made of those records."""
    events, parts = cleaned(spark, sf), []
    for name, (reader, label, *_) in _READERS.items():
        lines = _log_lines(events, name, broken=True)
        logins = reader(lines).agg(F.count(F.lit(1))).scalar()
        counts = normalize.reject_counts(lines, label)
        parts.append(counts.withColumn("read", F.when(F.col("reason") == "login", logins).otherwise(F.lit(0).cast("bigint"))))
    return normalize.union_sources(*parts)


@query("normalize_all", sql.with_(_SRC, f"""
select auth_source, count(*) as events, count(distinct user_id) as users, count(*) filter (where success) as successes,
 min(ts) as first_ts from ({' union all '.join(_source_sql(n) for n in _READERS)}) group by auth_source"""))
def _(spark, sf):
    events = cleaned(spark, sf)
    parts = [_READERS[n][0](_log_lines(events, n)) for n in _READERS]
    return normalize.union_sources(*parts).groupBy("auth_source").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"),
        F.count_if("success").alias("successes"), F.min("ts").alias("first_ts"),
    )
