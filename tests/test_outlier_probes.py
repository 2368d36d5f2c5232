"""Outlier factors of floods of scored rows, and averages with missing scores."""

import numpy as np
import pytest

from gatewise.operators import models
from gatewise.operators.models import FEATURES


def _rows(spark, x, first):
    return spark.createDataFrame(
        [(first + i, *map(float, v)) for i, v in enumerate(x)], "row_id bigint, " + ", ".join(f"{f} double" for f in FEATURES))


def test_every_row_of_a_flood_is_scored_high(spark):
    """More distinct scored rows in one place than a block holds."""
    rng = np.random.default_rng(8)
    reference = rng.normal(size=(400, len(FEATURES)))
    flood = 6 + rng.normal(size=(1500, len(FEATURES))) / 100
    usual = rng.normal(size=(50, len(FEATURES)))
    probes = _rows(spark, np.r_[flood, usual], 1000)
    got = models.novelty_outlier_factor(_rows(spark, reference, 0), probes, k=20, block=64).toPandas().set_index("row_id")["score"]
    assert len(got) == 1550 and got.notna().all()
    assert got.loc[:2499].min() > got.loc[2500:].median()


def test_recall_at_the_production_block(spark):
    """Of the 20 nearest reference rows, those found; and never fewer than 20."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, len(FEATURES))) * np.r_[3.0, 2.0, np.full(len(FEATURES) - 2, 0.3)]
    reference, probes = _rows(spark, x[:3000], 0), _rows(spark, x[3000:], 5000)
    vectors, zs = models._standardised(reference, probes)
    found = models._neighbours(vectors, zs, 20, 4, 512, probed=True).toPandas()
    v = vectors.toPandas()
    z, w, vid = v[zs].to_numpy(), v["w"].to_numpy(), v["vid"].to_numpy()
    near = found.sort_values(["vid", "d"]).groupby("vid")["nid"].apply(lambda s: set(s.head(20)))
    share = []
    for i in np.flatnonzero(w == 0):
        exact = vid[w > 0][np.argsort(((z[w > 0] - z[i]) ** 2).sum(1), kind="stable")[:20]]
        assert len(near[vid[i]]) == 20
        share.append(len(near[vid[i]] & set(exact)) / 20)
    print("recall", np.mean(share))
    assert np.mean(share) > 0.4


def test_missing_scores_are_left_out_of_the_average(spark):
    rows = [("a", 1, 0.0), ("a", 2, 10.0), ("a", 3, None), ("b", 1, 0.0), ("b", 2, 1.0), ("b", 3, 1.0), ("c", 1, 5.0), ("c", 2, 5.0), ("c", 3, 5.0)]
    stacked = spark.createDataFrame(rows, "model string, row_id bigint, score double")
    got = {r.row_id: r.score for r in models.averaged_score(stacked).collect()}
    assert got == {1: 0.0, 2: pytest.approx(2 / 3, abs=1e-4), 3: 0.5}
