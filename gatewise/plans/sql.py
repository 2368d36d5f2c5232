"""SQL counterparts of the registered queries, for an independent check.

They are written the plain way: windows over a whole user, sorts of whole tables,
``case`` chains. Fixed values (keyword lists, agents, points) come from the same
constants as the Spark side; the logic does not.
"""

from __future__ import annotations

from gatewise.functions import agents
from gatewise.functions.risk import FEATURES, KINDS, LEVELS, RULES, RiskParams
from gatewise.sources.projection import AGENTS

PRIVATE = r"^(10|127|192[.]168|169[.]254|172[.](1[6-9]|2[0-9]|3[01]))[.]"


def quoted(text: str | None) -> str:
    return "null" if text is None else "'" + text.replace("'", "''") + "'"


def logins() -> str:
    """CTEs ending in ``logins``: raw login rows over ``events``."""
    rows = ", ".join(f"({i}, {', '.join(quoted(v) for v in row)})" for i, row in enumerate(AGENTS))
    return f"""
ua(k, ua, browser, os, device) as (values {rows}),
base as (select *, case when event_id % 20 < 9 then 0 else user_id + 1 end as uid from events),
dealt as (
  select *, case when event_id % 9 = 0 then event_id % 40 else 1 + uid % 7 end as d,
         (uid + case when event_id % 13 = 0 then event_id else 0 end) % 16 as k0
  from base),
logins as (
  select cast(event_id as varchar) as idx, cast(ts as varchar) as ts, cast(uid as varchar) as user_id,
    case when event_id % 25 = 0 then cast((event_id * 7919) % 90000 as varchar) end as rtt,
    case uid % 4 when 0 then '10.0.' when 1 then '84.210.' when 2 then '172.20.' else '172.40.' end
      || cast(uid % 50 as varchar) || '.' || cast(d as varchar) as ip,
    case when event_id % 23 = 0 then 'US' when uid % 5 = 4 then 'SE' else 'NO' end as country,
    case when event_id % 4 = 0 then '-' when event_id % 11 = 0 then null else 'Oslo' end as region,
    case when event_id % 8 = 0 then '-' else 'Oslo' end as city,
    cast(29695 + uid % 3 + case when event_id % 23 = 0 then 100 else 0 end as varchar) as asn,
    ua.ua, ua.browser, ua.os, ua.device,
    case when event_type <> 'error' then 'True' else 'False' end as success,
    case when d % 10 = 8 then 'True' else 'False' end as attack,
    case when event_type <> 'error' and event_id % 499 = 8 then 'True' else 'False' end as ato
  from dealt join ua on ua.k = dealt.k0)"""


def word_match(column: str, words, whole_token: bool = False) -> str:
    body = "|".join(words)
    if whole_token:
        body = f"(^|[^A-Za-z0-9])({body})($|[^A-Za-z0-9])"
    return f"coalesce(regexp_matches({column}, {quoted('(?i)' + body)}), false)"


def _os_case(profile: str) -> str:
    genbot = word_match("ua", agents.GENERATOR_BOTS[profile])
    arms = []
    for r in agents.OS_RULES[profile]:
        test = word_match(r.where, r.words, r.whole_token)
        if r.not_generator:
            test += f" and not {genbot}"
        arms.append(f"when {test} then {quoted(r.label)}")
    return f"case {' '.join(arms)} else 'unknown' end"


def _device_case(profile: str) -> str:
    m = word_match
    if profile == "shipped":
        return f"""case when device in ('bot', 'unknown') then device
      when {m('ua', ['iPad'])} then 'tablet' when {m('ua', ['iPhone', 'Mobile'])} then 'mobile'
      when {m('ua', ['Android'])} then 'tablet' when device in ('mobile', 'tablet') then device else 'desktop' end"""
    phone = f"{m('ua', ['iPhone'], True)} or ({m('ua', ['Mobile'], True)} and not {m('ua', agents.DESKTOP_MARKERS)})"
    return f"""case when device = 'bot' then 'bot' when {m('ua', agents.TABLET_MARKERS)} then 'tablet'
      when {phone} then 'mobile' when {m('ua', ['Android', 'Andorid'])} then 'tablet'
      when device in ('mobile', 'tablet') then device when coalesce(device, 'unknown') = 'unknown' then 'unknown'
      else 'desktop' end"""


def _conflict(profile: str) -> str:
    if profile == "shipped":
        return " or ".join(
            f"({word_match('ua', a)} and {word_match('os', o)})" for a, o in agents.CONFLICT_PAIRS
        )
    arms = " ".join(
        f"when {word_match('os', r.words, r.whole_token)} then {quoted(r.label)}"
        for r in agents.OS_RULES["documented"] if r.where == "os"
    )
    return f"coalesce(os_family <> 'unknown' and os_family <> (case {arms} end), false)"


def clean(profile: str = "documented") -> str:
    """CTEs ending in ``clean``."""
    geo = " or region is null or city is null" if profile == "documented" else ""
    # doubling the blanks gives each token its own pair, so neighbours do not share one
    spread = "' ' || replace(browser, ' ', '  ') || ' '"
    version = quoted("(?i) ([0-9]+([._-][0-9]+)*(-git)?|variation/[0-9]+) ")
    return f"""{logins()},
typed as (
  select try_cast(idx as bigint) as row_id, try_cast(ts as timestamp) as ts, try_cast(user_id as bigint) as user_id,
    case when try_cast(rtt as double) <= 60000 then try_cast(rtt as double) end as rtt, rtt as rtt_text,
    ip, country, case when region not in ('', '-') then region end as region,
    case when city not in ('', '-') then city end as city, try_cast(asn as bigint) as asn,
    ua, browser, os, device, success = 'True' as login_success, attack = 'True' as is_attack_ip, ato = 'True' as is_ato,
    {_os_case(profile)} as os_family,
    trim(regexp_replace(regexp_replace({spread}, {version}, ' ', 'g'), ' +', ' ', 'g'), ' ') as browser_family,
    {_device_case(profile)} as device_type,
    regexp_matches(ip, {quoted(PRIVATE)}) as is_private_ip
  from logins),
clean as (
  select row_id, ts, user_id, rtt, ip, country, region, city, asn, ua as user_agent, browser as browser_raw,
    os as os_raw, device as device_raw, login_success, is_attack_ip, is_ato, os_family, browser_family, device_type,
    is_private_ip, is_private_ip{geo} as geo_unreliable, rtt_text is null as rtt_missing,
    rtt_text is not null and try_cast(rtt_text as double) > 60000 as rtt_outlier,
    {_conflict(profile)} as ua_os_conflict, browser <> browser_family as version_stripped,
    {word_match('ua', agents.GENERATOR_BOTS[profile])} as is_generator_bot,
    {word_match('ua', agents.VLC)} as is_vlc
  from typed)"""


def lives(expire_us: int) -> str:
    """CTE ``lived`` over ``clean``: users renamed by when their silence of over ``expire_us`` last ended."""
    return f"""gaps as (select *, epoch_us(ts) as t, max(epoch_us(ts)) over (partition by user_id order by epoch_us(ts)
    range between unbounded preceding and 1 preceding) as before from clean),
begun as (select *, max(case when before is null or t - before > {expire_us} then t end) over
    (partition by user_id order by t range between unbounded preceding and current row) as life from gaps),
lived as (select * exclude (t, before, life) replace (user_id || ':' || life as user_id) from begun)"""


def features(params: RiskParams = RiskParams(), profile: str = "documented", expire_us: int | None = None) -> str:
    """CTEs ending in ``features``: clean rows with features from plain windows."""
    seen = ",\n    ".join(
        f"coalesce(us > min(us) over (partition by user_id, {col}), false) as {kind}_seen_before"
        for kind, col in KINDS.items()
    )
    lo, hi = params.night_hours
    back = "order by us range between"
    base, source = (clean(profile), "clean") if expire_us is None else (f"{clean(profile)},\n{lives(expire_us)}", "lived")
    return f"""{base},
stamped as (select *, epoch_us(ts) as us, cast(ts as date) as day, hour(ts) as hr from {source}),
counted as (
  select *, {seen},
    count(*) over (partition by user_id {back} unbounded preceding and 1 preceding) as prior_events,
    count(*) over (partition by user_id) as user_rows,
    count(*) filter (where not login_success) over
      (partition by user_id {back} {params.lookback_us} preceding and 1 preceding) as fails,
    count(*) over (partition by user_id {back} {params.burst_us} preceding and 1 preceding) as burst,
    count(*) over (partition by user_id, day {back} unbounded preceding and 1 preceding) as today,
    count(*) over (partition by user_id, hr {back} unbounded preceding and 1 preceding) as same_hour
  from stamped),
features as (
  select * exclude (us, day, hr, fails, burst, today, same_hour),
    cast(hr as integer) as hour, hr between {lo} and {hi} as is_night, isodow(ts) >= 6 as is_weekend,
    prior_events > 0 and not country_seen_before as country_change,
    prior_events > 0 and not device_seen_before as device_change,
    prior_events > 0 and not browser_seen_before as browser_change,
    fails > 0 as failed_recently, burst as rapid_login_rate, today as login_frequency_today,
    case when prior_events = 0 then false
         else cast(same_hour as double) / prior_events < {params.unusual_share} end as unusual_hour,
    prior_events > 0 as has_history
  from counted)"""


def rule_tests(params: RiskParams = RiskParams()) -> dict[str, str]:
    new = {k: f"(has_history and not {k}_seen_before)" for k in KINDS}
    return {
        "new_country": new["country"], "new_ip": new["ip"], "recent_failure": "failed_recently",
        "rapid": f"rapid_login_rate >= {params.rapid_min}", "night": "is_night", "new_asn": new["asn"],
        "new_device": new["device"], "frequency": f"login_frequency_today >= {params.frequency_min}",
        "new_os": new["os"], "new_browser": new["browser"],
    }


def scores(params: RiskParams = RiskParams(), profile: str = "documented") -> str:
    """CTEs ending in ``scored``."""
    tests = rule_tests(params)
    points = " + ".join(f"(case when {tests[r]} then {p} else 0 end)" for r, p, _ in RULES)
    why = ", ".join(f"case when {tests[r]} then {quoted(t)} end" for r, _, t in RULES)
    levels = " ".join(f"when score >= {low} then {quoted(n)}" for n, low in LEVELS)
    acts = " ".join(f"when {quoted(lv)} then {quoted(a)}" for lv, a in params.decisions)
    return f"""{features(params, profile)},
pointed as (select *, {points} as score, concat_ws('; ', {why}) as reasons,
   is_attack_ip and login_success as is_gold from features),
levelled as (select *, case {levels} end as level from pointed),
scored as (select *, case level {acts} end as decision,
   case level when 'low' then 'green' when 'medium' then 'yellow' when 'critical' then 'red' end as colour
   from levelled)"""


def hist(label: str = "is_gold") -> str:
    """CTE ``hist`` over ``scored``."""
    return f"""hist as (select score, count(*) filter (where {label}) as pos,
   count(*) filter (where not {label}) as neg from scored group by score)"""


def rates(alias: str = "") -> str:
    return """cast(tp as double) / nullif(tp + fp, 0) as precision, cast(tp as double) / nullif(tp + fn, 0) as recall,
   cast(2 * tp as double) / nullif(2 * tp + fp + fn, 0) as f1, cast(fp as double) / nullif(fp + tn, 0) as fpr"""


def curve(label: str = "is_gold", source: str = "scored", score: str = "score") -> str:
    """CTE ``curve``: every distinct score as a threshold, counted by a self-join of scores to rows."""
    return f"""curve0 as (
  select t.s as threshold,
    cast(sum(case when e.{score} >= t.s and {label} then 1 else 0 end) as bigint) as tp,
    cast(sum(case when e.{score} >= t.s and not {label} then 1 else 0 end) as bigint) as fp,
    cast(sum(case when e.{score} < t.s and {label} then 1 else 0 end) as bigint) as fn,
    cast(sum(case when e.{score} < t.s and not {label} then 1 else 0 end) as bigint) as tn
  from {source} e, (select distinct {score} as s from {source}) t group by t.s),
curve as (select *, {rates()} from curve0)"""


def seeded_hash(seed: str, column: str) -> str:
    return f"cast('0x' || substr(md5('{seed}:' || cast({column} as varchar)), 1, 8) as bigint)"


def tiers(spec, profile: str = "documented", base: str | None = None) -> str:
    """CTEs ending in ``tiers`` over clean rows."""
    return f"""{base or clean(profile)},
tiers as (
  select user_id, count(*) as user_rows, count(*) filter (where is_attack_ip) as attacks,
    count(*) filter (where is_ato) as atos,
    case when count(*) > {spec.robot_share} * (select count(*) from clean) then 'robot'
      when count(*) filter (where is_ato) > 0 then 'ato'
      when count(*) filter (where is_attack_ip) >= {spec.heavy_attacks} then 'heavy'
      when count(*) filter (where is_attack_ip) > 0 then 'light' else 'normal' end as tier
  from clean group by user_id)"""


def chosen(spec) -> str:
    quota = " ".join(f"when {quoted(t)} then {p}" for t, p in spec.keep_percent)
    return f"""chosen as (select * from tiers where {seeded_hash(spec.seed, "coalesce(cast(user_id as varchar), '<null>')")} % 100 < case tier {quota} end)"""


def sample(spec, profile: str = "documented", base: str | None = None) -> str:
    """CTEs ending in ``sample``: clean rows of chosen users, ranked per user and cut."""
    return f"""{tiers(spec, profile, base)}, {chosen(spec)},
ranked as (
  select c.*, tier, row_number() over (partition by c.user_id
     order by case when is_ato then 0 else 1 end, {seeded_hash(spec.seed, 'row_id')}, row_id) as place
  from clean c join chosen on c.user_id is not distinct from chosen.user_id),
sample as (select * exclude (place) from ranked
  where is_ato or place <= case when tier = 'robot' then {spec.robot_cap} else {spec.user_cap} end)"""


def with_(ctes: str, body: str) -> str:
    return f"with {ctes.strip()}\n{body}"


def accepted_only(params: RiskParams = RiskParams(), accepted: str = "allow") -> str:
    """CTEs ending in ``learned_scores``: logins read in order, a time at a time; only accepted ones teach values.

    ``known`` grows along each user's times; what is counted of attempts needs no learning.
    """
    kinds = {k: f"'{k}=' || coalesce(cast({col} as varchar), '')" for k, col in KINDS.items()}
    new = {k: f"(len(known) > 0 and not list_contains(known, {v}))" for k, v in kinds.items()}
    tests = {
        "new_country": new["country"], "new_ip": new["ip"], "new_asn": new["asn"], "new_device": new["device"], "new_os": new["os"],
        "new_browser": new["browser"], "recent_failure": "failed_recently", "night": "is_night",
        "rapid": f"(len(known) > 0 and burst >= {params.rapid_min})", "frequency": f"(len(known) > 0 and today >= {params.frequency_min})",
    }
    points = " + ".join(f"(case when {tests[r]} then {p} else 0 end)" for r, p, _ in RULES)
    levels = " ".join(f"when score >= {low} then {quoted(n)}" for n, low in LEVELS)
    acts = " ".join(f"when {quoted(lv)} then {quoted(a)}" for lv, a in params.decisions)
    limit = min([low for n, low in LEVELS if dict(params.decisions)[n] != accepted], default=1 << 30)
    return f"""{features(params)},
facts as (select f.*, c.burst, c.today, dense_rank() over (partition by f.user_id order by f.ts) as step
  from features f join counted c using (row_id)),
walk as (select user_id, cast(0 as bigint) as step, cast([] as varchar[]) as known from facts group by user_id
  union all
  select w.user_id, w.step + 1, list_distinct(list_concat(w.known,
    flatten(list([{", ".join(kinds.values())}]) filter (where {points} < {limit}))))
  from (select w.user_id, w.step, w.known, f.* exclude (user_id, step) from walk w join facts f on f.user_id = w.user_id and f.step = w.step + 1) w
  group by w.user_id, w.step, w.known),
judged as (select f.*, {points} as new_score from facts f join walk w on w.user_id = f.user_id and w.step = f.step - 1),
levelled_scores as (select row_id, user_id, new_score as score, case {levels.replace("score", "new_score")} end as level from judged),
learned_scores as (select *, case level {acts} end as decision, case level {acts} end = {quoted(accepted)} as learned from levelled_scores)"""


def combined(flags, points: int, said_from: float, reason: str, params: RiskParams = RiskParams()) -> str:
    """CTEs ending in ``combined``: rule scores plus a model of flag counts learned from rows before the time cut."""
    at = lambda f, y, v: f"(count(*) filter (where {f} = {v} and is_gold = {y}) + 1.0) / (count(*) filter (where is_gold = {y}) + 2)"
    weights = ", ".join(
        f"ln({at(f, 'true', 'true')}) - ln({at(f, 'false', 'true')}) as yes_{f}, ln({at(f, 'true', 'false')}) - ln({at(f, 'false', 'false')}) as no_{f}"
        for f in flags)
    odds = " + ".join(f"(case when {f} then yes_{f} else no_{f} end)" for f in flags)
    levels = " ".join(f"when combined_score >= {low} then {quoted(n)}" for n, low in LEVELS)
    acts = " ".join(f"when {quoted(lv)} then {quoted(a)}" for lv, a in params.decisions)
    return f"""{scores(params)},
known as (select s.* replace (coalesce(is_gold, false) as is_gold) from scored s),
weighed as (select ln((count(*) filter (where is_gold) + 1.0) / (count(*) filter (where not is_gold) + 1.0)) as base, {weights}
  from known where ts < (select cut_ts from cut)),
modelled as (select k.* exclude (level, decision, colour, reasons), reasons as said, round(1 / (1 + exp(-(base + {odds}))), 4) as model_score
  from known k, weighed),
summed as (select *, score + cast(floor(model_score * {points}) as integer) as combined_score from modelled),
ranked as (select *, case {levels} end as level from summed),
combined as (select *, case level {acts} end as decision,
   concat_ws('; ', nullif(said, ''), case when model_score >= {said_from} then {quoted(reason)} end) as reasons from ranked)"""


def outlier_factors(reference: str, probes: str | None, k: int = 20) -> str:
    """CTEs ending in ``factors`` over ``features``: local outlier factors from all pairs of distinct vectors.

    ``reference`` and ``probes`` are conditions on rows; without probes the reference rows are compared among themselves.
    """
    names = [f"cast({f} as double) as {f}" for f in FEATURES]
    vector = ", ".join(FEATURES)
    weights = ", ".join(
        f"case when var_pop({f}) > 0 then cast(printf('%.6e', 1 / var_pop({f})) as double) else 0 end as p_{f}" for f in FEATURES)
    d = "sqrt(" + " + ".join(f"(a.{f} - b.{f}) * (a.{f} - b.{f}) * p_{f}" for f in FEATURES) + ")"
    near = lambda pairs: f"""select vid, nid, d, nw from (select *, sum(nw) over (partition by vid order by d
    range between unbounded preceding and current row) - sum(nw) over (partition by vid, d) as before from {pairs}) where before < {k}"""  # noqa: E731
    dense = lambda lists: f"""select vid, sum(nw) / (sum(nw * greatest(d, kd)) + 1e-10) as lrd
    from {lists} join reach on reach.oid = nid group by vid"""  # noqa: E731
    asked = "" if probes is None else f"""
asked as (select row_number() over () as vid, * from (select distinct {vector} from numbers where {probes})),
apart as (select a.vid, b.vid as nid, b.w as nw, {d} as d from asked a, refs b, weights),
near as ({near("apart")}),
density_asked as ({dense("near")}),"""
    lists, density, found = ("near", "density_asked", "asked") if probes is not None else ("own", "density", "refs")
    return f"""numbers as (select * replace ({", ".join(names)}), is_attack_ip and login_success as is_gold from features),
weights as (select {weights} from numbers where {reference}),
refs as (select row_number() over () as vid, * from (select {vector}, cast(count(*) as double) as w from numbers where {reference} group by {vector})),
pairs as (select a.vid, b.vid as nid, b.w - case when a.vid = b.vid then 1 else 0 end as nw, {d} as d from refs a, refs b, weights),
own as ({near("(select * from pairs where nw > 0)")}),
reach as (select vid as oid, max(d) as kd from own group by vid),
density as ({dense("own")}),{asked}
factors as (select t.*, x.around / y.lrd as lof from {found} t
  left join (select l.vid, sum(l.nw * o.lrd) / sum(l.nw) as around from {lists} l join density o on o.vid = l.nid group by l.vid) x on x.vid = t.vid
  left join {density} y on y.vid = t.vid)"""
