"""Labelled samples for the classifiers, and optimisation by Adam."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

FOLDS = 5
#: Bound of a training sample: rows per class. Their texts are taken whole.
SAMPLE_ROWS = 1000


def held_out(doc_id="doc_id"):
    """Whether a row is kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> pd.DataFrame:
    """At most ``rows`` texts of each class outside the held-out fold, with ``y``.

    The ids are drawn by hash, so the sample is the same on every run. Only its ids and texts, bounded by
    the parameter, come to the driver; texts are whole.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    drawn = None
    for y in (0, 1):
        # One and a half times as many, since some texts may be missing.
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows + rows // 2)
        drawn = part if drawn is None else drawn.unionByName(part)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(drawn), "doc_id").toPandas()
    found = found.sort_values(["doc_id", "text"]).drop_duplicates("doc_id")
    return found.groupby("y", group_keys=False).head(rows).reset_index(drop=True)


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.rate, self.t = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            params[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
