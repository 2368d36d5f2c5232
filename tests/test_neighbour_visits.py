"""The work of the neighbour search: parts that a row is held against."""

import numpy as np

from gatewise.operators import neighbours


def test_rows_visit_few_parts(spark, monkeypatch):
    """Flags, hours and running counts, as the features have them: near rows agree in all flags."""
    rng = np.random.default_rng(4)
    n = 4000
    count = np.arange(n) % 800
    x = np.c_[rng.random(n) < 0.5, rng.random(n) < 0.1, rng.random(n) < 0.02, count * 24 // 800, count, rng.integers(0, 9, n)].astype(float)
    x = np.unique(x, axis=0)
    rows = [(i, 1.0, True, [float(v) for v in p]) for i, p in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vid bigint, w double, asks boolean, x array<double>")
    visits, plain = [], neighbours.written

    def seen(df, label, *rest):
        table = plain(df, label, *rest)
        if label == "second":
            visits.append(table.count())
        return table

    monkeypatch.setattr(neighbours, "written", seen)
    scale = 1 / x.var(axis=0)
    got = neighbours.nearest(vectors, scale, 5, block=64).groupBy("vid").max("d").collect()
    assert sum(visits) < 6 * len(x)
    far = {r[0]: r[1] for r in got}
    for i in range(0, len(x), 97):
        d = np.sort(np.sqrt((scale * (x - x[i]) ** 2).sum(1)))
        assert abs(far[i] - d[5]) < 1e-9
