"""Certified neighbours against all pairs."""

import numpy as np

from gatewise.operators.neighbours import nearest

SCALE = np.array([1.0, 0.25, 4.0, 0.0])


def _brute(w, x, k):
    """(row, neighbour) -> weight, up to a weight of k and all as far as the last."""
    want = {}
    refs = np.flatnonzero(w > 0)
    for i in range(len(x)):
        d = np.sqrt((SCALE * (x[refs] - x[i]) ** 2).sum(1)).round(9)
        others = refs != i
        order = np.argsort(d[others], kind="stable")
        ids, d = refs[others][order], d[others][order]
        enough = np.cumsum(w[ids]) >= k
        far = d[enough.argmax()] if enough.any() else np.inf
        want |= {(i, int(n)): (w[n], float(v)) for n, v in zip(ids[d <= far], d[d <= far])}
    return want


def _found(spark, w, x, k, **sizes):
    rows = [(i, float(w[i]), True, [float(v) for v in x[i]]) for i in range(len(x))]
    vectors = spark.createDataFrame(rows, "vid bigint, w double, asks boolean, x array<double>")
    got = nearest(vectors, SCALE, k, **sizes).collect()
    assert len({(r.vid, r.nid) for r in got}) == len(got)
    return {(r.vid, r.nid): (r.nw, round(r.d, 9)) for r in got}


def test_equal_brute_force_with_ties_copies_a_dense_spot_and_probes(spark):
    """Grid points with many ties, a dense spot that fills many parts of a ring, and rows that only ask."""
    rng = np.random.default_rng(5)
    grid = rng.integers(0, 5, (250, 4)).astype(float)
    spot = 2 + rng.normal(size=(350, 4)) / 1000
    asking = np.r_[rng.normal(size=(40, 4)) * 3, 2 + rng.normal(size=(160, 4)) / 1000, np.full((1, 4), 1e6)]
    x = np.r_[grid, spot, asking]
    w = np.r_[rng.integers(1, 4, 600), np.zeros(len(asking), int)].astype(float)
    got, want = _found(spark, w, x, 7, pivots=6, rings=4, block=32), _brute(w, x, 7)
    assert got.keys() == want.keys()
    assert all(got[key][0] == want[key][0] and abs(got[key][1] - want[key][1]) <= 1e-6 for key in want)


def test_fewer_reference_rows_than_asked_for(spark):
    x, w = np.arange(12.0).reshape(3, 4), np.array([1.0, 1.0, 0.0])
    assert _found(spark, w, x, 5).keys() == {(0, 1), (1, 0), (2, 0), (2, 1)}
    assert _found(spark, np.zeros(3), x, 5) == {}
    assert _found(spark, w[:0], x[:0], 5) == {}
