"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. A passage is described by how often byte classes follow
each other and by how its words repeat, then encoded by a learned layer. Gated attention, learned from
document labels alone, weights the passages; the weighted mean of their encodings is scored by a
logistic layer. Inputs are the text only.

Defined results: NULL, empty and wordless texts get the share of label 1, for nothing speaks against
them; texts of one passage have weight one; repeated rows get equal scores; without both classes among the labels
every score is that share (one half without labels); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gatewise.llm import textbytes as tb
from gatewise.llm.learning import SAMPLE_ROWS, Adam, held_out, labelled_sample

PASSAGE = 64
THRESHOLD = 0.3
HIDDEN, GATE, STEPS, BATCH, RATE, DECAY = 24, 12, 1500, 64, 0.01, 1e-4

_GROUPS = (b" \t", b"\n\r\x0b\x0c", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"*$%&#@^~|\\/<>=+_", b"\"'()[]{}-`", bytes(range(0x80, 0x100)))
_CLASS = np.full(256, len(_GROUPS), np.int64)
for _k, _group in enumerate(_GROUPS):
    _CLASS[list(_group)] = _k
_N = len(_GROUPS) + 1
FEATURES = _N * _N + 4


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage and the first passage of each row (one entry more than rows)."""
    n = len(offsets) - 1
    starts, ends, rows = tb.word_spans(data, offsets, tb.NOT_SPACE)
    first_word = np.searchsorted(rows, np.arange(n + 1))
    words = np.diff(first_word)
    count = np.maximum(-(-words // PASSAGE), 1)
    first = np.r_[0, np.cumsum(count)]
    total = int(first[-1])
    out = np.zeros((total, FEATURES), np.float32)
    if len(starts):
        owner = first[rows] + (np.arange(len(rows)) - first_word[rows]) // PASSAGE
        # A passage reaches from its first word to the next passage; what precedes a text's first word is dropped.
        step = np.zeros(len(data), np.int64)
        lead = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        step[starts[lead]] = np.diff(np.r_[0, owner[lead]])
        of = np.cumsum(step)
        of[:starts[0]] = owner[0]
        kind = _CLASS[data]
        pair = kind[:-1] * _N + kind[1:]
        inside = of[:-1] == of[1:]
        code = of[:-1][inside] * (_N * _N) + pair[inside]
        grams = np.bincount(code, minlength=total * _N * _N).reshape(total, -1)
        out[:, :_N * _N] = np.sqrt(grams / np.maximum(grams.sum(1, keepdims=True), 1))
        hashes = tb.word_hashes(data, starts, ends, tb.LOWER)
        again = np.zeros(len(rows))
        again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        size = np.bincount(owner, minlength=total)
        out[:, -4] = np.bincount(owner, again, total) / np.maximum(size, 1)
        order = np.lexsort((hashes, owner))
        fresh = np.r_[True, (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])]
        out[:, -3] = np.bincount(owner[order], fresh, total) / np.maximum(size, 1)
        out[:, -2] = np.bincount(owner, np.minimum(ends - starts, 40), total) / np.maximum(size, 1) / 10
        out[:, -1] = size / PASSAGE
    return out, first


class AttentionModel:
    """Encoder, gated attention and logistic layer; ``params`` are plain arrays."""

    def __init__(self, params: dict[str, np.ndarray] | None, constant: float = 0.5):
        self.params, self.constant = params, constant

    @staticmethod
    def fresh(seed: int = 7) -> dict[str, np.ndarray]:
        rng = np.random.default_rng(seed)
        draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float64)
        return {"mean": np.zeros(FEATURES), "scale": np.ones(FEATURES), "E": draw(FEATURES, HIDDEN), "e": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE, 1)[:, 0], "c": draw(HIDDEN, 1)[:, 0], "b": np.zeros(1)}

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p = self.params
        x = (x - p["mean"]) / p["scale"]
        h = np.tanh(x @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        g = (t * s) @ p["w"]
        size = np.diff(first)
        bag = np.repeat(np.arange(len(size)), size)
        a = np.exp(g - np.maximum.reduceat(g, first[:-1])[bag])
        a = a / np.add.reduceat(a, first[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"][0], -30, 30)))
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "y": y, "bag": bag}

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.params is None:
            return np.full(len(first) - 1, self.constant)
        wordless = (x[first[:-1], -1] == 0) & (np.diff(first) == 1)
        return np.where(wordless, self.constant, self.forward(x.astype(np.float64), first)["y"])

    def gradients(self, f: dict, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, bag, a = self.params, f["bag"], f["a"]
        d = weight * (f["y"] - y)
        dz = d[:, None] * p["c"]
        da = (f["h"] * dz[bag]).sum(1)
        mean = np.bincount(bag, a * da, len(d))
        dg = a * (da - mean[bag])
        dh = a[:, None] * dz[bag]
        dt, ds = dg[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2), dg[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        dh = dh + dt @ p["V"].T + ds @ p["U"].T
        dq = dh * (1 - f["h"] ** 2)
        g = {"E": f["x"].T @ dq, "e": dq.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ dg, "c": f["z"].T @ d, "b": np.array([d.sum()])}
        return {k: v + (DECAY * p[k] if k in ("E", "V", "U", "w", "c") else 0) for k, v in g.items()}


def fit(texts: list[str], y: np.ndarray, steps: int = STEPS, seed: int = 7) -> AttentionModel:
    """Learn from document labels; classes weigh the same."""
    if len(set(y.tolist())) < 2:
        return AttentionModel(None, float(y.mean()) if len(y) else 0.5)
    data, offsets = tb.texts(pa.array(texts, pa.large_string()))
    parts = [passages(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]) for lo, hi in tb.chunks(offsets)]
    x = np.concatenate([part for part, _ in parts])
    first = np.r_[0, np.cumsum(np.concatenate([np.diff(f) for _, f in parts]))]
    share = y.mean()
    model = AttentionModel(AttentionModel.fresh(seed), float(share))
    model.params["mean"], model.params["scale"] = x.mean(0), x.std(0) + 1e-2
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    rng, adam = np.random.default_rng(seed), Adam(model.params, RATE)
    for _ in range(-(-steps * BATCH // len(y))):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            docs = order[lo:lo + BATCH]
            size = first[docs + 1] - first[docs]
            bounds = np.r_[0, np.cumsum(size)]
            rows = np.repeat(first[docs] - bounds[:-1], size) + np.arange(bounds[-1])
            f = model.forward(x[rows].astype(np.float64), bounds)
            adam.step(model.params, model.gradients(f, y[docs], weight[docs] / len(docs)))
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> AttentionModel:
    sample = labelled_sample(docs, labels, "quality", rows)
    return fit(sample["text"].tolist(), sample["y"].to_numpy(float))


def score_documents(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """doc_id and score of every document; no shuffle."""
    def task(frames):
        for batch, data, offsets in tb.batches(frames):
            x, first = passages(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x, first))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, "doc_id long, score double")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, learn_from: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted to be of low quality; every column is kept."""
    model = train(learn_from, labels)
    schema = docs.schema

    def task(frames):
        for batch, data, offsets in tb.batches(frames):
            x, first = passages(data, offsets)
            yield batch.filter(pa.array(model.score(x, first) >= THRESHOLD))

    return docs.mapInArrow(task, schema)
