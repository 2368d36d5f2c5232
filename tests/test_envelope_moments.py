"""The envelope's moments against Spark's own aggregates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewise.operators.models import FEATURES, _moments, fit_envelope, numeric


def test_moments_equal_the_aggregates(spark):
    """Skewed, constant, far from zero, and with missing values."""
    rows = spark.range(3000).select(
        (F.col("id") % 7).cast("double").alias("a"), (1e6 + (F.col("id") % 11) ** 3).alias("b"),
        F.when(F.col("id") % 5 > 0, (F.col("id") % 13).cast("double")).alias("c"), F.lit(2.0).alias("d"))
    names = ("a", "b", "c", "d")
    mean, skew, cov = _moments(rows, names)
    want = rows.agg(*[F.avg(n).alias(f"m{n}") for n in names], *[F.skewness(n).alias(f"k{n}") for n in names],
                    *[F.covar_samp(p, q).alias(p + q) for p in names for q in names]).first()
    assert [want[f"m{n}"] for n in names] == pytest.approx(mean.tolist(), rel=1e-12)
    assert [want[f"k{n}"] for n in "abc"] == pytest.approx(skew[:3].tolist(), rel=1e-9)
    assert [want[p + q] for p in names for q in names] == pytest.approx(cov.ravel().tolist(), rel=1e-9, abs=1e-6)


def test_fit_takes_no_aggregate_of_all_pairs(spark, monkeypatch):
    """136 covariances in one aggregate are too much code to compile."""
    asked = []
    plain = F.covar_samp
    monkeypatch.setattr(F, "covar_samp", lambda *pair: asked.append(pair) or plain(*pair))
    rows = spark.range(200).select(*[(F.col("id") * (i + 3) % (i + 17)).alias(n) for i, n in enumerate(FEATURES)])
    found = fit_envelope(numeric(rows), max_skew=float("inf"))
    assert not asked and found.names == FEATURES and np.isfinite(found.precision).all()
