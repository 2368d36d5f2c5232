"""Parts of the corpus operators by themselves."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from gatewise.llm import lattice, packing, ring
from gatewise.llm.suffixes import suffix_order


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=0, max_size=60))
def test_suffix_order(symbols):
    s = np.array([*symbols, 0])
    assert suffix_order(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9))
def test_bounds_and_best_fit(lengths):
    lengths = np.array(lengths)
    bins, offsets = packing.best_fit_decreasing(lengths, 30)
    number = bins.max() + 1
    for b in range(number):
        own = np.sort(offsets[bins == b])
        assert lengths[bins == b].sum() <= 30 and own[0] == 0
    bound = packing.lower_bound(*np.unique(lengths, return_counts=True), 30)
    assert bound <= _fewest(sorted(lengths.tolist(), reverse=True), 30) <= number


def _fewest(items, capacity):
    best = len(items)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] + items[k] <= capacity:
                place(k + 1, [*bins[:i], bins[i] + items[k], *bins[i + 1:]])
        place(k + 1, [*bins, items[k]])

    place(0, [])
    return best


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 5), st.lists(st.integers(0, 9), min_size=5, max_size=20))
def test_allotment(shards, counts):
    """Against keys put down one after the other, first at home, then clockwise."""
    arcs = [(10 * k, k % shards, n) for k, n in enumerate(counts)]
    total = sum(counts)
    free = [total // shards + (s < total % shards) for s in range(shards)]
    where, waiting = {}, []
    for k, (node, shard, n) in enumerate(arcs):
        for r in range(n):
            if free[shard]:
                free[shard] -= 1
                where[node, r] = shard
            else:
                waiting.append((k, node, r))
    queue = []
    for step in range(2 * len(arcs)):
        k = step % len(arcs)
        shard = arcs[k][1]
        while queue and free[shard]:
            free[shard] -= 1
            where[queue.pop(0)] = shard
        if step < len(arcs):
            queue += [(node, r) for j, node, r in waiting if j == k]
    got = {(x["node"], r): x["shard"] for x in ring.allot(arcs, shards) for r in range(x["lo"], x["hi"])}
    assert got == where and not queue
    slots = sorted((x["shard"], x["slot"] + r) for x in ring.allot(arcs, shards) for r in range(x["hi"] - x["lo"]))
    assert len(slots) == len(set(slots)) == total


def test_decoding_finds_the_nearest_lattice_point():
    rng = np.random.default_rng(3)
    x = rng.uniform(-1.5, 1.5, (60, 8))
    found = lattice.decode(x) / 2
    assert len(lattice.SHORTEST) == 240
    around = np.concatenate([np.zeros((1, 8), int), lattice.SHORTEST]) / 2
    for a, b in zip(x, found):
        near = ((b + around - a) ** 2).sum(1)
        assert near.argmin() == 0  # no neighbour is nearer; a Voronoi cell is bounded by the shortest vectors
        assert (2 * b % 2 == (2 * b % 2)[0]).all() and b.sum() % 2 == pytest.approx(0)
