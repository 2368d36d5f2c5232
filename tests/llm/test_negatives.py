"""Hard negatives against all pairs, with blocks of every size, ties, repeated rows and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewise.llm import negatives
from tests.llm.conftest import pulled

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
SCHEMA = "vec_id bigint, embedding array<double>, label int"


def plain(rows):
    seen = {}
    for vec_id, x, label in rows:
        if vec_id is None or label is None or x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        q = tuple(int(np.floor(256 * c)) for c in x)
        seen[vec_id, q, (label + 1) % 10 if vec_id % 7 == 0 else label] = None
    out = set()
    for a, x, label in seen:
        if a % 100:
            continue
        scored = {(-sum(p * q for p, q in zip(x, y)), b, other == label) for b, y, other in seen if b != a and len(x) == len(y)}
        for s, positive in sorted({(s, b) for s, b, same in scored if same})[:5]:
            negative = sorted({(t, b) for t, b, same in scored if not same and 30 * -s <= 100 * -t <= 90 * -s})[:10]
            out |= {(a, positive, k + 1, b, -s, -t) for k, (t, b) in enumerate(negative)}
    return out


def _rows(n=420, dim=24, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((6, dim))
    x = centers[rng.integers(0, 6, n)] + 0.7 * rng.standard_normal((n, dim))
    x[50:80] = x[50]  # ties
    return [(k, [float(c) for c in v], int(rng.integers(0, 4))) for k, v in enumerate(x)]


def _check(table, rows, **options):
    got = pulled(negatives.negatives_report(table) if not options else negatives.mine(
        table, F.col("vec_id") % 100 == 0,
        label=F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")), **options), *COLUMNS)
    assert got == sorted(plain(rows), key=repr)
    return got


@pytest.mark.parametrize("options", [{}, {"block": 1}, {"block": 60}])
def test_all_pairs(spark, options):
    rows = _rows()
    odd = [
        (1000, None, 1), (1001, [0.1] * 24, None), (1002, [None] * 24, 1), (1003, [float("nan")] * 24, 1), (1004, [float("inf")] * 24, 1),
        (1100, [0.5, 0.25], 2), (1101, [0.5, 0.5], 2), (1102, [0.25, 0.25], 3), (None, rows[0][1], 1), (1200, [], 1), (1201, [], 1), (1202, [], 2),
        rows[100], rows[7], (8, rows[9][1], 3),
    ]
    table = spark.createDataFrame(rows + odd, SCHEMA).repartition(5)
    clash = table.withColumns({c: F.lit(None).cast("string") for c in ("id", "x", "width", "chosen", "anchor", "score", "place")})
    assert len(_check(clash, rows + odd, **options)) > 100


def test_long_and_large_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(k, [float(c) for c in 50 * rng.standard_normal(131)], k % 3) for k in range(160)]
    rows += [(700, [3e5] * 5, 1), (701, [4e5] * 5, 2), (702, [3e5] * 4 + [2e5], 1), (703, [1e5] * 5, 4)]
    assert len(_check(spark.createDataFrame(rows, SCHEMA), rows)) > 10


def test_nothing_to_find(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.negatives_report(empty).count() == 0
    alone = spark.createDataFrame([(100, [1.0, 2.0], 1), (101, [1.0, 1.0], 2)], SCHEMA)
    assert negatives.negatives_report(alone).count() == 0


def test_bounds_hold_on_every_level():
    rng = np.random.default_rng(4)
    for dim in (2, 3, 16, 24, 50, 64):
        a, b = (negatives.Summaries(np.floor(256 * rng.standard_normal((40, dim)))) for _ in range(2))
        exact = a.x @ b.x.T
        tighter = np.inf
        for (am, ad), (rm, rd) in zip(a.levels, b.levels):
            middle, spread = am @ rm.T, ad @ rd.T
            assert (exact <= middle + spread + 1e-6).all() and (exact >= middle - spread - 1e-6).all()
            assert spread.sum() < tighter
            tighter = spread.sum()


def test_clustered_rows_are_ruled_out_without_scores(monkeypatch):
    rng = np.random.default_rng(6)
    smooth = np.repeat(rng.standard_normal((300, 4)), 16, axis=1) * 100 + rng.standard_normal((300, 64))
    v = negatives.Summaries(np.floor(smooth))
    scored = []
    monkeypatch.setattr(negatives, "scores", lambda a, b, whole=negatives.scores: scored.append(len(a)) or whole(a, b))
    exact = v.x @ v.x.T
    least = np.sort(exact, axis=1)[:, -5]
    a, r, s = negatives.candidates(v, v, np.ones((300, 300), bool), least, np.full(300, np.inf))
    assert len(a) == (exact >= least[:, None]).sum() and sum(scored) < 0.1 * exact.size
