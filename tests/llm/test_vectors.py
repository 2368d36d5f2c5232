"""Near vectors against all pairs, with groups that link wholly, in part and not at all."""

import itertools

import numpy as np

from gatewise.llm import lattice
from tests.llm.brute import components


def _turned(rng, x, cos):
    r = rng.standard_normal(x.shape)
    r -= (r @ x) * x
    r /= np.linalg.norm(r)
    return cos * x + np.sqrt(1 - cos * cos) * r


def _planted(dim=48):
    rng = np.random.default_rng(5)
    unit = lambda: (lambda v: v / np.linalg.norm(v))(rng.standard_normal(dim))
    rows = [unit() for _ in range(300)]
    for cos, n in ((0.92, 40), (0.95, 40), (0.999, 60), (0.899, 30)):
        center = unit()
        rows += [center] + [_turned(rng, center, cos) for _ in range(n)]
    edge = unit()
    other = _turned(rng, edge, 0.9)  # two tight groups about the threshold apart
    rows += [_turned(rng, edge, 0.9995) for _ in range(12)] + [_turned(rng, other, 0.9995) for _ in range(12)]
    rows += [rows[0] * 3, rows[0] * 1e-200, rows[1]]
    return [(k, [float(c) for c in v]) for k, v in enumerate(rows)]


def test_near_vectors(spark):
    rows = _planted()
    bad = [(9001, None), (9002, []), (9003, [0.0] * 48), (9004, [float("nan")] * 48), (9005, [None] * 48), (9006, [1.0, 2.0]), (9007, [float("inf")] + [0.0] * 47), (None, rows[0][1])]
    table = spark.createDataFrame(rows + bad + [rows[5]], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r for r in lattice.near_vectors(table, block=16).collect()}
    assert len(got) == len(rows) + len(bad)
    x = np.array([v for _, v in rows])
    x = x / np.abs(x).max(1)[:, None]
    x = x / np.linalg.norm(x, axis=1)[:, None]
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    want = link.sum(1)
    n = np.array([got[k].n_links for k, _ in rows])
    assert n.sum() >= 0.9 * want.sum() and (n <= want + (np.abs(x @ x.T - 0.9) < 1e-9).sum(1)).all()
    exact = components(range(len(rows)), zip(*np.nonzero(link)))
    same = [got[k].component_id == exact[k] for k, _ in rows]
    assert np.mean(same) >= 0.98
    for k, _ in bad:
        assert got[k].n_links == 0 and got[k].component_id == k and got[k].kept == True  # noqa: E712
    assert lattice.near_vectors(table.where("vec_id > 9000")).count() == 7
    assert lattice.near_vectors(table.where("false")).count() == 0


def test_lengths_apart(spark):
    """Each length links as it would alone, the rare ones as well."""
    rng = np.random.default_rng(2)
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0, 2.0, 0.0]), (4, [1.0, 2.0, 0.0]), (5, [1.0, 2.0, 0.1]), (6, [2.0]), (7, [0.5]), (8, [-1.0]), (9, [-2.0, 1.0])]
    for base, dim in ((100, 12), (200, 16), (300, 40)):
        center = rng.standard_normal(dim)
        center /= np.linalg.norm(center)
        rows += [(base + k, _turned(rng, center, cos).tolist()) for k, cos in enumerate([0.97] * 12 + [0.999] * 6 + [0.3] * 6)]
    got = {r.vec_id: r for r in lattice.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), block=4).collect()}
    links = {k: set() for k, _ in rows}
    for (a, x), (b, y) in itertools.combinations(rows, 2):
        if len(x) == len(y) and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
            links[a].add(b)
            links[b].add(a)
    assert {k: got[k].n_links for k in links} == {k: len(v) for k, v in links.items()}
    ids = [k for k, _ in rows]
    want = components(ids, [(a, b) for a in links for b in links[a]])
    assert {k: got[k].component_id for k in links} == {k: want[k] for k in links}


def test_keys_recall():
    rng = np.random.default_rng(9)
    a = rng.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = np.stack([_turned(rng, v, 0.9) for v in a])
    proj = lattice.projections(64)
    (own_a, near_a), (own_b, near_b) = (lattice.keys(v, proj, lattice.PROBES) for v in (a, b))
    met = (own_a == own_b) | (near_a == own_b[:, :, None]).any(2) | (near_b == own_a[:, :, None]).any(2)
    assert met.any(1).mean() >= 0.9
