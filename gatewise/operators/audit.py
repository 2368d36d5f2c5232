"""Whole-table audits: each is one grouping job over all rows.

Names say whether a job reads raw rows (text columns) or clean rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from gatewise.functions import agents, text
from gatewise.functions.agents import has_any
from gatewise.operators.checks import as_rows, count_each

_C = F.col


def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


# ------------------------------------------------------------- columns and keys

def column_grid(raw: DataFrame) -> DataFrame:
    """Raw columns against criteria: (column, missing, unparsable, minimum, maximum)."""
    c = _C
    numeric = {"idx": text.to_long(c("idx")), "user_id": text.to_long(c("user_id")),
               "asn": text.to_long(c("asn")), "rtt": text.to_double(c("rtt"))}
    parsed: dict[str, Column] = {**numeric, "ts": text.to_timestamp_ntz(c("ts"))}
    for flag in ("success", "attack", "ato"):
        parsed[flag] = F.when(c(flag).isin("True", "False"), c(flag))
    parsed["ip"] = F.when(text.is_ipv4(c("ip")), c("ip"))
    parsed["country"] = F.when(c("country").rlike(r"^[A-Z]{2}\z"), c("country"))
    names = list(parsed)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for n in names:
        aggs += [
            F.count_if(c(n).isNull()).alias(f"{n}__missing"),
            F.count_if(c(n).isNotNull() & parsed[n].isNull()).alias(f"{n}__bad"),
        ]
        if n in numeric:
            aggs += [F.min(parsed[n].cast("double")).alias(f"{n}__lo"), F.max(parsed[n].cast("double")).alias(f"{n}__hi")]
    nothing = F.lit(None).cast("double")
    line = [
        F.struct(
            F.lit(n).alias("column_name"), c("rows"), c(f"{n}__missing").alias("missing"),
            c(f"{n}__bad").alias("unparsable"),
            (c(f"{n}__lo") if n in numeric else nothing).alias("minimum"),
            (c(f"{n}__hi") if n in numeric else nothing).alias("maximum"),
        )
        for n in names
    ]
    return raw.agg(*aggs).select(F.inline(F.array(*line)))


def row_id_sequence(clean: DataFrame) -> DataFrame:
    """Is ``row_id`` unique, non-null and without gaps? No sort."""
    c = _C
    s = clean.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("row_id").alias("distinct_ids"),
        F.min("row_id").alias("min_id"), F.max("row_id").alias("max_id"),
    )
    return s.select(
        "*", (c("rows") - c("distinct_ids")).alias("repeated_or_null"),
        (c("max_id") - c("min_id") + 1 - c("distinct_ids")).alias("gaps"),
    )


def ip_form(clean: DataFrame) -> DataFrame:
    """Addresses that are not dotted quads, and quads with an octet above 255."""
    quad = _C("ip").rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}\z")
    over = F.exists(F.split("ip", r"\."), lambda o: o.try_cast("int") > 255)
    return count_each(clean, {
        "total_rows": F.lit(True), "malformed": ~quad, "octet_over_255": quad & over,
        "valid": text.is_ipv4(_C("ip")),
    })


def iso_country_codes(spark: SparkSession, extra: tuple[str, ...] = ("XK",)) -> DataFrame:
    """Alpha-2 codes as the JVM knows them plus user-assigned ones (about 250 rows)."""
    codes = [*spark._jvm.java.util.Locale.getISOCountries(), *extra]
    return spark.sql("select explode(split(:codes, ',')) as code", args={"codes": ",".join(codes)})


def country_membership(clean: DataFrame, codes: DataFrame) -> DataFrame:
    """Countries outside the code list with their rows; the list is a fixed ~250 rows."""
    found = clean.groupBy("country").agg(F.count(F.lit(1)).alias("events"))
    return found.join(F.broadcast(codes), found.country == codes.code, "left_anti")


def country_counts(clean: DataFrame, codes: DataFrame) -> DataFrame:
    """Events and users per country and whether the code is known."""
    found = clean.groupBy("country", "user_id").agg(F.count(F.lit(1)).alias("n"))
    found = found.groupBy("country").agg(F.sum("n").alias("events"), F.count(F.lit(1)).alias("users"))
    joined = found.join(F.broadcast(codes), found.country == codes.code, "left")
    return joined.select("country", "events", "users", _C("code").isNotNull().alias("is_known"))


def duplicate_keys(events: DataFrame, *keys: str) -> DataFrame:
    """Key combinations that occur more than once, with their count."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def duplicate_rows(events: DataFrame) -> DataFrame:
    """Number of whole-row duplicate groups and of surplus rows.

    First pass on a 64-bit hash (eight bytes per row in the shuffle); only rows whose
    hash repeats are compared in full.
    """
    cols = events.columns
    hashed = events.withColumn("_h", F.xxhash64(*cols))
    repeated = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_h")
    groups = (
        hashed.join(repeated, "_h", "left_semi").groupBy(*cols)
        .agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    return groups.agg(
        F.count(F.lit(1)).alias("duplicate_groups"),
        F.coalesce(F.sum(_C("n") - 1), F.lit(0)).alias("surplus_rows"),
    )


def value_space(events: DataFrame, *columns: str) -> DataFrame:
    """Every distinct value of every listed column with its rows (long form)."""
    pairs = F.array(*[F.struct(F.lit(n).alias("c"), _C(n).cast("string").alias("v")) for n in columns])
    return (
        events.select(F.explode(pairs).alias("p"))
        .groupBy(_C("p.c").alias("column_name"), _C("p.v").alias("value"))
        .agg(F.count(F.lit(1)).alias("events"))
    )


def mapping_coverage(clean: DataFrame, raw_col: str, derived: str, unmapped: str = "unknown") -> DataFrame:
    """Raw value, derived family, rows, and whether the value stayed unmapped."""
    return (
        clean.groupBy(_C(raw_col).alias("raw_value"), _C(derived).alias("family"))
        .agg(F.count(F.lit(1)).alias("events"))
        .withColumn("is_unmapped", F.coalesce(_C("family") == unmapped, F.lit(True)))
    )


DEVICES = ("mobile", "desktop", "tablet", "bot", "unknown")


def os_by_device(clean: DataFrame) -> DataFrame:
    """Cross-tab of OS family and device type; the columns are the five device types."""
    wide = clean.groupBy("os_family").pivot("device_type", list(DEVICES)).agg(F.count(F.lit(1)))
    return wide.select("os_family", *[F.coalesce(d, F.lit(0)).alias(d) for d in DEVICES])


def _state(col: str) -> Column:
    return F.when(_C(col).isNull(), "null").when(_C(col) == "", "null").when(_C(col) == "-", "dash").otherwise("set")


def placeholder_matrix(raw: DataFrame) -> DataFrame:
    """Region state against city state on raw rows."""
    return raw.groupBy(_state("region").alias("region_state"), _state("city").alias("city_state")).agg(
        F.count(F.lit(1)).alias("events")
    )


def hour_distribution(clean: DataFrame) -> DataFrame:
    """Rows and share per hour of day."""
    hours = clean.groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("events"))
    # at most 25 rows reach this window
    total = F.sum("events").over(W.partitionBy(F.lit(0)))
    return hours.withColumn("share", _share(_C("events"), total))


def functional_dependency(events: DataFrame, key: str, value: str) -> DataFrame:
    """Does ``key`` decide ``value``? Keys in all, keys with more than one value, their rows.

    NULL is a value of its own.
    """
    v = _C(value).cast("string")
    per_key = events.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"),
        F.count_if(_C(value).isNull()).alias("nulls"),
    )
    mixed = (_C("lo") != _C("hi")) | ((_C("nulls") > 0) & (_C("nulls") < _C("n")))
    mixed = F.coalesce(mixed, F.lit(False))
    return per_key.agg(
        F.count(F.lit(1)).alias("keys_total"),
        F.count_if(mixed).alias("keys_mixed"),
        F.coalesce(F.sum(F.when(mixed, _C("n"))), F.lit(0)).alias("rows_mixed"),
    )


def label_by_ip(clean: DataFrame) -> DataFrame:
    """Addresses that are always, never or sometimes flagged."""
    per_ip = clean.groupBy("ip").agg(
        F.bool_and("is_attack_ip").alias("always"), F.bool_or("is_attack_ip").alias("ever")
    )
    return per_ip.agg(
        F.count(F.lit(1)).alias("ips"), F.count_if("always").alias("always_attack"),
        F.count_if(~_C("ever")).alias("never_attack"), F.count_if(_C("ever") & ~_C("always")).alias("mixed"),
    )


def multi_country_asns(clean: DataFrame) -> DataFrame:
    """Networks seen in two or more countries, with rows and share of all rows.

    (asn, country) is counted first, so a large network collapses on the map side.
    """
    pairs = clean.groupBy("asn", "country").agg(F.count(F.lit(1)).alias("n"))
    per_asn = pairs.groupBy("asn").agg(F.count("country").alias("countries"), F.sum("n").alias("events"))
    total = clean.agg(F.count(F.lit(1)).alias("n"))
    return per_asn.where("countries >= 2").withColumn("share", _share(_C("events"), total.scalar()))


BANDS = (("1000+", 1000), ("100-999", 100), ("10-99", 10))


def ip_reuse(clean: DataFrame) -> DataFrame:
    """Addresses per band of users served, with the busiest address of the band."""
    per_ip = clean.groupBy("ip", "user_id").agg(F.count(F.lit(1)).alias("n")).groupBy("ip").agg(
        F.count(F.lit(1)).alias("users")
    )
    band = reduce(lambda acc, b: acc.when(_C("users") >= b[1], b[0]), BANDS[1:], F.when(_C("users") >= BANDS[0][1], BANDS[0][0]))
    return per_ip.withColumn("band", band.otherwise("1-9")).groupBy("band").agg(
        F.count(F.lit(1)).alias("ips"), F.max("users").alias("most_users"),
        # ties: the smallest address, so the result does not depend on the order
        F.min_by("ip", F.struct(-_C("users"), _C("ip"))).alias("busiest_ip"),
    )


def events_per_user(clean: DataFrame) -> DataFrame:
    """Mean, median, p90, p95, p99 and maximum of events per user, exact.

    Percentiles run on the distribution of counts (count -> users), whose size is
    the number of different counts, not the number of users.
    """
    users = clean.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    dist = users.groupBy("n").agg(F.count(F.lit(1)).alias("users"))
    points = {"median_events": 0.5, "p90_events": 0.9, "p95_events": 0.95, "p99_events": 0.99}
    return dist.agg(
        F.sum("users").alias("users"),
        _share(F.sum(_C("n") * _C("users")), F.sum("users")).alias("mean_events"),
        *[F.percentile("n", p, _C("users")).alias(name) for name, p in points.items()],
        F.max("n").alias("max_events"),
    )


def attack_concentration(clean: DataFrame, top: int = 41) -> DataFrame:
    """Share of attack events held by the top users, and users by number of attacks."""
    per_user = clean.groupBy("user_id").agg(F.count_if("is_attack_ip").alias("attacks"), F.count(F.lit(1)).alias("n"))
    per_user = per_user.where("attacks > 0")
    best = per_user.orderBy(F.desc("attacks"), "user_id").limit(top).agg(F.sum("attacks").alias("x"))
    total = per_user.agg(
        F.sum("attacks").alias("attack_events"), F.count(F.lit(1)).alias("attack_users"),
        F.count_if(_C("attacks") >= 10).alias("users_10_plus"),
        F.coalesce(F.sum(F.when(_C("attacks") >= 10, _C("n"))), F.lit(0)).alias("events_of_10_plus"),
        F.count_if(_C("attacks") <= 2).alias("users_1_or_2"),
    )
    return total.withColumn("top_events", best.scalar()).withColumn(
        "top_share", _share(_C("top_events"), _C("attack_events"))
    )


def dominant_user(clean: DataFrame) -> DataFrame:
    """Report on the user with the most rows: shares, countries, labels, rate.

    The user is found by one aggregate and filtered for; its rows are only counted.
    """
    per_user = clean.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    # most rows first, then the least id; counts can be negated safely, ids cannot
    top = per_user.agg(F.min(F.struct((-_C("n")).alias("n"), "user_id"))["user_id"])
    mine = _C("user_id") == top.scalar()
    # count first, by everything the report needs; distinct sets stay tiny
    facts = clean.groupBy(mine.alias("mine"), "country").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("login_success").alias("ok"),
        F.count_if("is_attack_ip").alias("attacks"), F.count_if("ua_os_conflict").alias("conflicts"),
        F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.first(F.when(mine, _C("user_id")), True).alias("u"),
    )
    m = _C("mine")
    report = facts.agg(
        F.max("u").alias("user_id"),
        F.sum(F.when(m, _C("n"))).alias("events"),
        F.sum("n").alias("all_events"),
        F.count(F.when(m, _C("country"))).alias("countries"),
        F.sum(F.when(m, _C("ok"))).alias("successes"),
        F.sum(F.when(m, _C("attacks"))).alias("attack_events"),
        F.sum("attacks").alias("all_attack_events"),
        F.sum(F.when(m, _C("conflicts"))).alias("conflicts"),
        F.sum("conflicts").alias("all_conflicts"),
        F.min(F.when(m, _C("lo"))).alias("first_ts"),
        F.max(F.when(m, _C("hi"))).alias("last_ts"),
    )
    hours = (text.micros(_C("last_ts")) - text.micros(_C("first_ts"))) / 3.6e9
    return report.select(
        "user_id", "events", "countries", "successes", "attack_events", "conflicts",
        _share(_C("events"), _C("all_events")).alias("event_share"),
        _share(_C("attack_events"), _C("all_attack_events")).alias("attack_share"),
        _share(_C("conflicts"), _C("all_conflicts")).alias("conflict_share"),
        F.try_divide(_C("events").cast("double"), hours).alias("events_per_hour"),
    )


# --------------------------------------------------------------- release dates

@dataclass(frozen=True)
class ReleaseRule:
    """Version text in a raw column that cannot occur before ``since`` (None: at all)."""

    name: str
    column: str
    pattern: str
    since: str | None


# ---------------------------------------------------------------- fixed values
# Release dates are public; versions without a date came after the data ends.
RELEASES = (
    ReleaseRule("chrome_85", "browser_raw", r"^Chrome 85", "2020-08-25"),
    ReleaseRule("chrome_89", "browser_raw", r"^Chrome 89", None),
    ReleaseRule("chrome_90_plus", "browser_raw", r"^Chrome (9[0-9]|[1-9][0-9]{2})", None),
    ReleaseRule("android_11", "os_raw", r"^Android 11", "2020-09-08"),
    ReleaseRule("android_12_plus", "os_raw", r"^Android (1[2-9]|[2-9][0-9])", None),
    ReleaseRule("ios_14", "os_raw", r"^iOS 14", "2020-09-16"),
    ReleaseRule("ios_15_plus", "os_raw", r"^iOS (1[5-9]|[2-9][0-9])", None),
)
# ----------------------------------------------------------- end fixed values


def impossible_versions(clean: DataFrame, rules: tuple[ReleaseRule, ...] = RELEASES) -> DataFrame:
    """Rows per rule whose version is older than its release, in one pass without a join."""
    hits = {}
    for rule in rules:
        hit = _C(rule.column).rlike(rule.pattern)
        if rule.since:
            hit = hit & (_C("ts") < F.lit(rule.since).cast("timestamp_ntz"))
        hits[rule.name] = hit
    hits["any_rule"] = reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), hits.values())
    return as_rows(count_each(clean, hits), "rule", "events")


# ---------------------------------------------------------- agents and content

_PLATFORM_WORDS = ("iPhone", "iPad", "iPod", "iOS", "Windows", "Android", "Andorid", "CrOS",
                   "Mac OS X", "Macintosh", "Mac_PowerPC", "Linux", "X11", "KaiOS")


def agent_gaps(clean: DataFrame) -> DataFrame:
    """Absences and device contradictions in user agents."""
    ua, device = F.lower("user_agent"), _C("device_raw")
    tablet = has_any(ua, agents.TABLET_MARKERS)
    mobile = has_any(ua, ("Mobile", "iPhone", "Android"))
    return as_rows(count_each(clean, {
        "total_rows": F.lit(True),
        "ua_silent_on_platform": ~has_any(ua, _PLATFORM_WORDS),
        "ua_short": F.length("user_agent") < 15,
        "device_null": device.isNull(),
        "tablet_without_marker": (device == "tablet") & ~tablet,
        "desktop_with_mobile_ua": (device == "desktop") & mobile,
        "mobile_with_silent_ua": (device == "mobile") & ~has_any(ua, _PLATFORM_WORDS),
        "os_column_other": _C("os_raw") == "Other ",
    }))


def text_content(events: DataFrame, *columns: str) -> DataFrame:
    """Control characters and non-ASCII text per column."""
    wide = events.agg(*[
        a for n in columns for a in (
            F.count_if(_C(n).rlike(r"[\x00-\x1f]")).alias(f"{n}__control"),
            F.count_if(_C(n).rlike(r"[^\x00-\x7f]")).alias(f"{n}__wide"),
        )
    ])
    lines = [
        F.struct(F.lit(n).alias("column_name"), _C(f"{n}__control").alias("control_rows"),
                 _C(f"{n}__wide").alias("non_ascii_rows"))
        for n in columns
    ]
    return wide.select(F.inline(F.array(*lines)))


def label_overlap(clean: DataFrame) -> DataFrame:
    """All combinations of attack, success, takeover and private flags with subtotals."""
    names = ("is_attack_ip", "login_success", "is_ato", "is_private_ip")
    # count the at most 81 combinations first, then cube those
    base = clean.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    return base.cube(*names).agg(F.sum("n").alias("events"), F.grouping_id().cast("int").alias("level"))


def family_collapse(clean: DataFrame) -> DataFrame:
    """Distinct raw browser strings against distinct families."""
    pairs = clean.select("browser_raw", "browser_family").distinct()
    return pairs.agg(
        F.count_distinct("browser_raw").alias("raw_values"), F.count_distinct("browser_family").alias("families"),
        F.count_distinct(F.when(_C("browser_family").rlike("[0-9]"), _C("browser_family"))).alias("families_with_digit"),
    )


def bot_breakdown(clean: DataFrame, profile: str = "documented") -> DataFrame:
    """Generator-bot rows by the first bot word in the agent, with device and labels."""
    lowered = F.lower("user_agent")
    word = None
    for name in agents.GENERATOR_BOTS[profile]:
        hit = lowered.contains(name.lower())
        word = F.when(hit, name) if word is None else word.when(hit, name)
    return clean.where("is_generator_bot").groupBy(word.alias("bot")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(_C("device_raw") == "bot").alias("device_bot"),
        F.count_if("login_success").alias("successes"), F.count_if("is_attack_ip").alias("attack_events"),
    )
