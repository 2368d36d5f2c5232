"""Suffix sorting by linear grouping.

Phase one sorts suffixes into groups by their longest Lyndon prefix. Groups are processed from the
highest down: each suffix of a group finds its previous smaller suffix, the last position before it whose
group is lower still, by following pointers already set; the suffixes found that way are moved
behind the rest of their own group, higher the more suffixes of the processed group point to them. Phase two
walks the order being made from its lowest suffix up: the suffix before each one, and then along its
previous-smaller pointers, takes the next free place of its group. Nothing is renamed and sorted again.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in ascending order; the last symbol must be the least and unique."""
    n = len(symbols)
    if n <= 1:
        return np.arange(n)
    by_symbol = np.argsort(symbols, kind="stable")
    lead = np.r_[True, symbols[by_symbol][1:] != symbols[by_symbol][:-1]]
    begins = np.flatnonzero(lead)
    group_of = np.empty(n, np.int64)
    group_of[by_symbol] = begins[np.cumsum(lead) - 1]
    slots = by_symbol.tolist()  # members of a group stand together, from its begin
    place = np.empty(n, np.int64)
    place[by_symbol] = np.arange(n)
    place = place.tolist()
    group = group_of.tolist()  # begin of a position's group
    size = [0] * n
    for begin, count in zip(begins.tolist(), np.diff(np.r_[begins, n]).tolist()):
        size[begin] = count
    before = [-1] * n  # previous smaller suffix
    votes = [0] * n
    end = n
    while end > 0:
        begin = group[slots[end - 1]]
        if end - begin == 1:
            i = slots[begin]
            j = i - 1
            while j >= 0 and group[j] >= begin:
                j = before[j]
            before[i] = j
            if j >= 0:
                # One suffix alone: its predecessor goes behind the others of its group.
                g = group[j]
                last = g + size[g] - 1
                if last != g:
                    at, other = place[j], slots[last]
                    slots[at], slots[last] = other, j
                    place[other], place[j] = at, last
                    size[g] -= 1
                    group[j], size[last] = last, 1
            end = begin
            continue
        members = sorted(slots[begin:end])
        found = []
        most = 1
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= begin:
                j = before[j]
            before[i] = j
            if j >= 0:
                v = votes[j] = votes[j] + 1
                if v == 1:
                    found.append(j)
                elif v > most:
                    most = v
        if most == 1:
            levels = [found]
        else:
            levels = [[] for _ in range(most)]
            for j in found:
                levels[most - votes[j]].append(j)
        for level in levels:
            for j in level:
                votes[j] = 0
                g = group[j]
                last = g + size[g] - 1
                size[g] -= 1
                at, other = place[j], slots[last]
                slots[at], slots[last] = other, j
                place[other], place[j] = at, last
            for j in level:
                # The suffixes moved out of one group stand behind what is left of it.
                g = group[j]
                fresh = g + size[g]
                group[j] = ~fresh
            for j in level:
                fresh = ~group[j]
                group[j] = fresh
                size[fresh] += 1
        end = begin
    filled = [0] * n
    out = [-1] * n
    out[0] = n - 1
    filled[group[n - 1]] = 1
    done = [False] * n
    done[n - 1] = True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            done[j] = True
            g = group[j]
            out[g + filled[g]] = j
            filled[g] += 1
            j = before[j]
    return np.array(out)
