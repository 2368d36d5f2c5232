"""Keyed state of one user: what was known strictly before each login.

The processor only keeps history and reports facts per event; features, scores and
reasons are computed from the facts by the column expressions the batch job uses.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gatewise.functions.risk import KINDS, RULES, RiskParams
from gatewise.streaming.packed import blobs, table_of

LOGIN, CONFIRM = "login", "confirm"
FACTS = (
    T.StructField("_prior", T.LongType()),
    *[T.StructField(f"_seen_{k}", T.BooleanType()) for k in KINDS],
    T.StructField("_last_failure", T.LongType()),
    T.StructField("_in_burst", T.LongType()),
    T.StructField("_today_before", T.LongType()),
    T.StructField("_hour_before", T.LongType()),
    T.StructField("_learned", T.BooleanType()),
)
#: Rows of a user judged with one look at what is known; rows with anything unknown are then read one by one.
_BLOCK = 8_192
#: Known values of a user that lie in the user's own state; further ones are looked up one by one.
_PROFILE_VALUES = 512
_DAY_US = 86_400 * 1_000_000
_HOUR_US = 3_600 * 1_000_000
#: No such time, and a time after all others.
_NEVER, _END = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_TIMES = ("known_at_us", "last_us", "day", "fail", "fail_before")
_COUNTS = ("known", "known_at", "at_last", "today")
# ``recent``: times of the last span, ascending; ``hours``: learned logins of each hour; both as bytes of int64.
# ``first_us``: known values and since when, as JSON, since Python state converts a map entry by entry.
_USER = ", ".join(f"{n} bigint" for n in (*_TIMES, *_COUNTS)) + ", recent binary, hours binary, first_us string, more boolean"


@dataclass(frozen=True)
class LearnPolicy:
    """What may enter the profile.

    ``everything``: every login (the batch features' view). Otherwise only logins whose
    decision is in ``accepted`` teach values and hours; attempts and failures are
    always counted, since they say what happened, not what is normal.
    """

    everything: bool = True
    accepted: tuple[str, ...] = ("allow",)


def _key(value) -> str:
    """Map keys cannot be NULL; a prefix keeps NULL apart from any text."""
    return "-" if value is None else f"={value}"


def _numbers(column: pa.ChunkedArray, null: int) -> np.ndarray:
    return pc.fill_null(pc.cast(column, pa.int64()), null).to_numpy()


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    """A number per row and the value behind each number; NULL is a value."""
    found = pc.dictionary_encode(column.combine_chunks(), null_encoding="encode")
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_pylist()


def _begins(*same: np.ndarray) -> np.ndarray:
    """For each row the first row of its run of equal rows."""
    new = np.zeros(len(same[0]), bool)
    new[:1] = True
    for values in same:
        new[1:] |= values[1:] != values[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _running(flags: np.ndarray) -> np.ndarray:
    """How many flags are set before each row, and before the end."""
    return np.concatenate([[0], np.cumsum(flags)])


class _Stored:
    """States of the users of a call, one array per field, and what of their values was known when."""

    def __init__(self, users, more, names: list[str]):
        self.users, self.more, self.names = users, more, names
        n = len(names)
        for field in _TIMES:
            setattr(self, field, np.full(n, _NEVER))
        for field in _COUNTS:
            setattr(self, field, np.zeros(n, np.int64))
        self.hours = np.zeros((n, 24), np.int64)
        self.recent, self.values, self.spilled = [np.empty(0, np.int64)] * n, [{} for _ in names], [False] * n
        for u, name in enumerate(names):
            found = users.getValue((name,))
            if found is None:
                continue
            *plain, recent, hours, values, spilled = found
            for field, value in zip((*_TIMES, *_COUNTS), plain):
                if value is not None:
                    getattr(self, field)[u] = value
            self.recent[u], self.hours[u] = np.frombuffer(recent, np.int64), np.frombuffer(hours, np.int64)
            self.values[u], self.spilled[u] = json.loads(values), spilled

    def first(self, u: int, value: str) -> int:
        """Since when the user's value is known."""
        at = self.values[u].get(value)
        if at is None and self.spilled[u]:
            found = self.more.getValue((self.names[u], value))
            at = None if found is None else found[0]
        return _END if at is None else at

    def learn(self, u: int, value: str, at: int) -> None:
        if len(self.values[u]) < _PROFILE_VALUES:
            self.values[u][value] = at
        else:
            self.spilled[u] = True
            self.more.updateValue((self.names[u], value), (at,))

    def save(self) -> None:
        for u, name in enumerate(self.names):
            times = [None if (at := int(getattr(self, f)[u])) == _NEVER else at for f in _TIMES]
            counts = [int(getattr(self, f)[u]) for f in _COUNTS]
            kept = (self.recent[u].tobytes(), self.hours[u].tobytes(), json.dumps(self.values[u]), self.spilled[u])
            self.users.updateValue((name,), (*times, *counts, *kept))


class LoginHistory(StatefulProcessor):
    """Facts per login and, for ``confirm`` rows, values added to the known sets.

    A call holds the rows of a micro-batch of some users, packed (:mod:`packed`), and state is kept by user. A row older
    than the newest row of the user is late: it is scored against the current state and never changes it. Rows of one call
    are ordered first; the size of a call is bounded by the size of a micro-batch. All that depends on attempts alone
    is worked out in columns; what is learned depends on what was learned, see :meth:`_accept`.
    """

    def __init__(self, params: RiskParams, policy: LearnPolicy, columns: tuple[str, ...]):
        self.params, self.policy, self.columns = params, policy, columns
        level = lambda score: next((name for name, lowest in params.levels if score >= lowest), None)
        most = sum(points for _, points, _ in RULES)
        self.accepted = np.array([dict(params.decisions).get(level(s)) in policy.accepted for s in range(most + 1)])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.users = handle.getMapState("users", "user string", _USER)
        self.more = handle.getMapState("more", "user string, value string", "first_us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        table = table_of(blob for part in rows for blob in part["packed"]).select(list(self.columns))
        for name, facts in zip((f.name for f in FACTS), self._facts(table)):
            table = table.append_column(name, facts)
        for blob in blobs(table):
            yield pd.DataFrame({"packed": [blob]})

    def _facts(self, table: pa.Table) -> list[pa.Array]:
        """The columns of FACTS, in the order of the rows."""
        codes, users = _coded(table["user_id"])
        at = _numbers(table["at_us"], _END)  # untimed rows come last
        order = np.lexsort((at, codes))
        user, us = codes[order], at[order]
        timed = us != _END
        confirm = pc.equal(table["row_kind"], CONFIRM).to_numpy()[order] & timed
        failed = pc.equal(pc.fill_null(table["login_success"], True), False).to_numpy()[order]
        stored = _Stored(self.users, self.more, [_key(u) for u in users])
        starts = np.searchsorted(user, np.arange(len(users) + 1))

        late = us < stored.last_us[user]
        attempt = timed & ~confirm & ~late
        own, same = _begins(user), _begins(user, us)
        day, hour = us // _DAY_US, (us // _HOUR_US) % 24
        tried = _running(attempt)
        again = us == stored.last_us[user]
        today = tried[same] - tried[_begins(user, day)] + np.where(
            stored.day[user] == day, stored.today[user] - np.where(again, stored.at_last[user], 0), 0)

        place = np.arange(len(us))
        last = np.concatenate([[-1], np.maximum.accumulate(np.where(attempt & failed, place, -1))])[same]
        known_fail, before = stored.fail[user], stored.fail_before[user]
        carried = np.where(known_fail < us, known_fail, np.where(known_fail == us, before, _NEVER))
        failure = np.where(last >= own, us[np.maximum(last, 0)], carried)

        burst = np.zeros(len(us), np.int64)
        spans = []
        for u, (a, b) in enumerate(zip(starts, starts[1:])):
            span = np.concatenate([stored.recent[u], us[a:b][attempt[a:b]]])
            burst[a:b] = np.searchsorted(span, us[a:b]) - np.searchsorted(span, us[a:b] - self.params.burst_us)
            spans.append(span)

        pairs, names = zip(*(self._pairs(table[c], order, user) for c in KINDS.values()))
        first = [
            np.array([stored.first(u, f"{k}{v}") for u, v in named], np.int64) for k, named in zip(KINDS, names)]
        unknown = [f == _END for f in first]
        if self.policy.everything:
            learned = attempt
            for pair, f, new in zip(pairs, first, unknown):
                teach = (attempt | confirm) & new[pair]
                f[pair[teach][::-1]] = us[teach][::-1]  # the earliest is written last
        else:
            learned = np.zeros(len(us), bool)
            for u, (a, b) in enumerate(zip(starts, starts[1:])):
                rows = slice(a, b)
                since = self._since(stored, u)
                learned[rows] = self._accept(
                    us[rows], attempt[rows], confirm[rows], hour[rows], failure[rows], burst[rows], today[rows],
                    [p[rows] for p in pairs], first, since)
        seen = [f[pair] < us for pair, f in zip(pairs, first)]

        taught = _running(learned)
        tie = np.where(us == stored.known_at_us[user], stored.known_at[user], 0)
        prior = taught[same] - taught[own] + stored.known[user] - tie
        by_hour = np.lexsort((us, hour, user))
        u2, h2, t2 = user[by_hour], hour[by_hour], us[by_hour]
        taught_then = _running(learned[by_hour])
        hours = np.empty(len(us), np.int64)
        hours[by_hour] = taught_then[_begins(u2, h2, t2)] - taught_then[_begins(u2, h2)]
        hours += stored.hours[user, hour] - tie

        self._keep(stored, starts, us, attempt, failed, learned, day, hour, spans)
        for k, named, f, new in zip(KINDS, names, first, unknown):
            for j in np.flatnonzero(new & (f != _END)):
                u, v = named[j]
                stored.learn(u, f"{k}{v}", int(f[j]))
        stored.save()

        back = np.empty(len(order), np.int64)
        back[order] = place
        told = lambda values, none: pa.array(values[back], mask=none[back])
        numbers = lambda values: told(np.where(timed, values, 0), confirm)
        return [
            numbers(prior), *[told(s & timed, confirm) for s in seen], told(failure, confirm | ~timed | (failure == _NEVER)),
            numbers(burst), numbers(today), numbers(hours), told(learned | confirm, np.zeros(len(us), bool)),
        ]

    @staticmethod
    def _pairs(column: pa.ChunkedArray, order: np.ndarray, user: np.ndarray) -> tuple[np.ndarray, list]:
        """For each row the number of its (user, value), and what each number stands for."""
        codes, values = _coded(column)
        found, pair = np.unique(user * len(values) + codes[order], return_inverse=True)
        keys = [_key(v) for v in values]
        return pair, [(u, keys[v]) for u, v in zip((found // len(values)).tolist(), (found % len(values)).tolist())]

    @staticmethod
    def _since(stored: _Stored, u: int) -> int:
        """The time after which a user has history."""
        if not stored.known[u]:
            return _END
        return stored.known_at_us[u] if stored.known[u] == stored.known_at[u] else _NEVER

    def _accept(self, us, attempt, confirm, hour, failure, burst, today, pairs, first, since) -> np.ndarray:
        """Which logins of a user are learned, by the same rules and points as the columns; ``first`` is brought up to date.

        A login whose values are all known already is judged by what happened before, and changes nothing that
        another login is judged by. Only the others are read in their order.
        """
        p, points = self.params, {rule: n for rule, n, _ in RULES}
        always = np.where(failure >= us - p.lookback_us, points["recent_failure"], 0)
        always[failure == _NEVER] = 0
        always += np.where((p.night_hours[0] <= hour) & (hour <= p.night_hours[1]), points["night"], 0)
        history = always + np.where(burst >= p.rapid_min, points["rapid"], 0)
        history += np.where(today >= p.frequency_min, points["frequency"], 0)
        new = [points[f"new_{k}"] for k in KINDS]
        accepted = self.accepted
        learned = np.zeros(len(us), bool)
        for low in range(0, len(us), _BLOCK):
            block = slice(low, low + _BLOCK)
            then = us[block]
            opened = then <= since
            for pair, f in zip(pairs, first):
                opened |= f[pair[block]] >= then
            learned[block] = attempt[block] & ~opened & accepted[history[block]]
            rows = low + np.flatnonzero(opened & (attempt[block] | confirm[block]))
            read = (rows, us[rows], attempt[rows], always[rows], history[rows], *[pair[rows] for pair in pairs])
            for i, at, login, alone, score, *values in zip(*(column.tolist() for column in read)):
                if login:
                    if at > since:
                        for f, value, n in zip(first, values, new):
                            if f[value] >= at:
                                score += n
                    else:
                        score = alone
                    if not accepted[score]:
                        continue
                    learned[i] = True
                    since = min(since, at)
                for f, value in zip(first, values):
                    if f[value] == _END:
                        f[value] = at
        return learned

    def _keep(self, s: _Stored, starts, us, attempt, failed, learned, day, hour, spans) -> None:
        """Bring counts and times of all users up to date."""
        for u, (a, b) in enumerate(zip(starts, starts[1:])):
            tried = us[a:b][attempt[a:b]]
            if not len(tried):
                continue
            last, today = tried[-1], tried[-1] // _DAY_US
            same = len(tried) - np.searchsorted(tried, last)
            s.at_last[u] = same + (s.at_last[u] if s.last_us[u] == last else 0)
            s.today[u] = len(tried) - np.searchsorted(tried, today * _DAY_US) + (s.today[u] if s.day[u] == today else 0)
            s.last_us[u], s.day[u] = last, today
            s.recent[u] = spans[u][np.searchsorted(spans[u], last - self.params.burst_us):]
            fails = us[a:b][attempt[a:b] & failed[a:b]]
            if len(fails):
                newest = fails[-1]
                earlier = fails[:np.searchsorted(fails, newest)]
                if len(earlier):
                    s.fail_before[u] = earlier[-1]
                elif s.fail[u] != newest:
                    s.fail_before[u] = s.fail[u]
                s.fail[u] = newest
            taught = us[a:b][learned[a:b]]
            if len(taught):
                newest = taught[-1]
                same = len(taught) - np.searchsorted(taught, newest)
                s.known_at[u] = same + (s.known_at[u] if s.known_at_us[u] == newest else 0)
                s.known_at_us[u] = newest
                s.known[u] += len(taught)
                s.hours[u] += np.bincount(hour[a:b][learned[a:b]], minlength=24)
