"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

A text is split into sentences, and a sentence is a row of symbols: letters without case, bytes beyond
ASCII, and one blank for white space, commas and the like; digits and other punctuation are left out. Its spans are the instances. A
span of length L holds the subsequences of four symbols that start at L consecutive places of the
sentence, with at most ``SKIPS`` symbols skipped in each, weighted by ``GAP_WEIGHT`` to the power of what
they skip. The kernel of two spans is the product of these vectors, each normalised by its own
self-similarity (each occurrence taken by itself; a short span like one of the greatest length). So an insult keeps most of its likeness when a
character is inserted, and what stands around it, with or without a blank, is outside the span.

A toxic document holds a toxic span, the others hold none. A linear SVM on Nyström features is
trained in turns with the choice of the toxic spans: in each sentence of a toxic document the worst span, if it
is on the toxic side, and always the worst of the document. Clean documents give the worst span of each
sentence. Toxic spans are also learned with one symbol inserted. The first choice goes by the odds of
a subsequence among toxic documents, where copied surroundings count once. Since the SVM is linear, kernel,
landmarks and weights fold into one table over subsequences, and scoring is one pass over the
bytes. A document scores as its worst span of the lengths in ``SPANS``. Single characters set apart by blanks are read as one word.

Defined results: NULL, empty and wordless texts score as a span that resembles no landmark; repeated
rows get equal scores; without both classes among the labels every score is 0; other columns are ignored.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gatewise.llm import textbytes as tb
from gatewise.llm.learning import SAMPLE_ROWS, held_out, labelled_sample

GAP_WEIGHT, SKIPS = 0.6, 2
#: Places of the second to fourth symbol after the first.
PATTERNS = [p for p in itertools.combinations(range(1, SKIPS + 4), 3) if p[2] <= SKIPS + 3]
SPANS = (4, 8)
#: Landmarks: half toxic spans, half drawn from so many times as many of the clean spans that look most toxic.
LANDMARKS, HARD = 256, 4
ROUNDS, STEPS, DECAY = 4, 40, 1e-4
THRESHOLD = 0.5
#: Spans whose features are worked out at a time in training.
BLOCK = 256
#: Spans of toxic documents are taken for toxic above the value that this share of clean sentences reaches.
CLEAN_SHARE = 0.002
#: Weight of all clean spans in training; the toxic ones, and those with insertions, have weight 1 each.
CLEAN_SPANS = 100.0
#: How much a flagged clean document weighs against a missed toxic one when the threshold is set.
CLEAN_WEIGHT = 4.0
#: One in so many documents of the sample sets the threshold and trains nothing else.
CALIBRATE = 4

BLANK, PAD = 31, 255
SYMBOLS = 32
CODES = SYMBOLS**4
_SKIP, _END, _STOP = 253, 252, 251
# Letters without case, five symbols for bytes beyond ASCII; digits are left out like most punctuation.
_SYMBOL = np.full(256, _SKIP, np.uint8)
_SYMBOL[0x61:0x7B] = _SYMBOL[0x41:0x5B] = np.arange(26)
_SYMBOL[0x80:] = 26 + np.arange(0x80) % 5
_SYMBOL[~tb.NOT_SPACE] = _SYMBOL[list(b',;:/|()[]{}<>"=+&')] = BLANK  # other punctuation is left out
_SYMBOL[[0x0A, 0x0B, 0x0C, 0x0D]] = _END
_SYMBOL[list(b".!?")] = _STOP  # an end before white space only


def _weight(pattern: tuple[int, int, int]) -> float:
    return GAP_WEIGHT ** (pattern[2] - 3)


#: A span with fewer subsequences than a whole one of the greatest length is normalised like that one.
LEAST_NORM = max(SPANS) * sum(_weight(p) ** 2 for p in PATTERNS)


@dataclass
class Sentences:
    """Symbols of all sentences of some rows; each begins and ends with a blank, shared by neighbours."""

    seq: np.ndarray  # symbol
    row: np.ndarray  # row of the symbol; the blank between rows belongs to the later one
    ends: np.ndarray  # how many sentence ends there are up to here
    until: np.ndarray  # place of the next sentence end


def _plain_blanks(data: np.ndarray) -> np.ndarray:
    """No-break, wide and zero-width blanks (U+00A0, U+2000 to U+200F, U+202F, U+3000) as plain ones; may write to ``data``."""
    two = np.flatnonzero((data[:-1] == 0xC2) & (data[1:] == 0xA0))
    a, b, c = data[:-2], data[1:-1], data[2:]
    three = np.flatnonzero(((a == 0xE2) & (b == 0x80) & ((c < 0x90) | (c == 0xAF))) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)))
    for k, at in ((2, two), (3, three)):
        for step in range(k):
            data[at + step] = 0x20
    return data


def sentences(data: np.ndarray, offsets: np.ndarray) -> Sentences:
    data = _plain_blanks(np.insert(data, offsets, 0x0A))
    begin = offsets + np.arange(len(offsets))
    seq = _SYMBOL[data]
    after = np.r_[seq[1:], _END]
    seq = np.where(seq == _STOP, np.where((after == BLANK) | (after == _END), _END, _SKIP), seq)
    place = np.flatnonzero(seq != _SKIP)
    seq = seq[place]
    # Runs of blanks and ends become one symbol, an end if one is among them or a row begins there.
    gap = seq >= BLANK
    lead = np.flatnonzero(~gap | np.r_[True, ~gap[:-1]])
    is_end = np.maximum.reduceat(seq == _END, lead) & gap[lead]
    # The last of a run is kept: it is in the row that begins there.
    last = np.r_[lead[1:], len(seq)] - 1
    seq, place = np.where(gap[lead], BLANK, seq[lead]).astype(np.uint8), place[last]
    # A blank between single characters goes.
    n = len(seq)
    if n > 4:
        blank = seq == BLANK
        inner = np.zeros(n, bool)
        inner[2:-2] = blank[2:-2] & ~is_end[2:-2] & blank[:-4] & blank[4:] & ~blank[1:-3] & ~blank[3:-1]
        seq, place, is_end = seq[~inner], place[~inner], is_end[~inner]
    row = np.searchsorted(begin, place, "right") - 1
    stops = np.flatnonzero(is_end)
    ends = np.cumsum(is_end)
    until = np.r_[stops, len(seq) - 1][np.minimum(ends, len(stops))]
    return Sentences(seq, row, ends, until)


def subsequences(s: Sentences):
    """(code, place of its first symbol, weight) of every gapped subsequence within a sentence, by pattern."""
    seq = s.seq.astype(np.int32)
    for p in PATTERNS:
        m = len(seq) - p[2]
        if m > 0:
            at = np.flatnonzero(s.ends[:m] == s.ends[p[2] - 1:m + p[2] - 1])  # no end strictly inside
            yield ((seq[at] * SYMBOLS + seq[at + p[0]]) * SYMBOLS + seq[at + p[1]]) * SYMBOLS + seq[at + p[2]], at, _weight(p)


def span_values(s: Sentences, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the greatest value of the spans that start there, and that span's length."""
    n = len(s.seq)
    total, norm = np.zeros(n), np.zeros(n)
    for code, at, weight in subsequences(s):
        total[at] += weight * table[code]
        norm[at] += weight * weight
    total, norm = np.r_[0, np.cumsum(total)], np.r_[0, np.cumsum(norm)]
    here = np.arange(n)
    best, length = np.full(n, -np.inf), np.zeros(n, np.int64)
    for size in SPANS:
        end = np.maximum(np.minimum(here + size, s.until), here)
        value = (total[end] - total[:-1]) / np.sqrt(np.maximum(norm[end] - norm[:-1], LEAST_NORM))
        better = value > best
        best[better], length[better] = value[better], size
    return best, length


WIDTH = max(SPANS) + 1 + SKIPS + 3


def cut_out(s: Sentences, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Spans as rows of a matrix: length, then the symbols they reach, padded."""
    place = at[:, None] + np.arange(WIDTH)
    reach = np.minimum(at + length + SKIPS + 2, s.until[at])
    out = np.where(place <= reach[:, None], s.seq[np.minimum(place, len(s.seq) - 1)], PAD)
    return np.c_[length, out].astype(np.uint8)


def phi(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse normalised vectors of spans: span, code, value."""
    length, sym = spans[:, 0].astype(np.int64), spans[:, 1:].astype(np.int32)
    parts, norm = [], np.zeros(len(spans))
    for p in PATTERNS:
        for k in range(min(int(length.max(initial=0)), WIDTH - p[2])):
            row = np.flatnonzero((k < length) & (sym[:, k + p[2]] != PAD))
            own = sym[row]
            code = ((own[:, k] * SYMBOLS + own[:, k + p[0]]) * SYMBOLS + own[:, k + p[1]]) * SYMBOLS + own[:, k + p[2]]
            parts.append((row, code, np.full(len(row), _weight(p))))
            norm[row] += _weight(p) ** 2
    row, code, value = (np.concatenate([x[j] for x in parts]) if parts else np.zeros(0, np.int64) for j in range(3))
    return row, code, value / np.sqrt(np.maximum(norm, LEAST_NORM))[row]


def features(spans: np.ndarray, codes: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Products of spans with the columns of a table by code, such as landmarks; by blocks of spans."""
    out = np.zeros((len(spans), columns.shape[1]), np.float32)
    for lo in range(0, len(spans), BLOCK):
        row, code, value = phi(spans[lo:lo + BLOCK])
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        live = np.flatnonzero(codes[at] == code)
        order = live[np.argsort(row[live], kind="stable")]
        if len(order):
            lead = np.flatnonzero(np.r_[True, row[order][1:] != row[order][:-1]])
            out[lo + row[order][lead]] = np.add.reduceat(columns[at[order]] * value[order][:, None], lead, axis=0)
    return out


def landmark_columns(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes that landmarks hold, ascending, and their values by landmark."""
    row, code, value = phi(marks)
    codes, at = np.unique(code, return_inverse=True)
    columns = np.zeros((len(codes), len(marks)))
    np.add.at(columns, (at, row), value)
    return codes, columns


class KernelModel:
    """``table`` folds kernel, landmarks and weights; ``bias`` is the score of an unlike span."""

    def __init__(self, table: np.ndarray | None = None, bias: float = -1.0, slope: float = 1.0):
        self.table, self.bias, self.slope = table, bias, slope

    def worst(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Margin of each row's worst span."""
        s = sentences(data, offsets)
        value, _ = span_values(s, self.table)
        out = np.full(len(offsets) - 1, self.bias)
        inside = s.row < len(out)  # the end of the last row
        np.maximum.at(out, s.row[inside], value[inside] + self.bias)
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.table is None:
            return np.zeros(len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.worst(data, offsets), -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared hinge loss by Newton steps over the rows inside the margin; sums run over blocks of rows."""
    size = x.shape[1] + 1
    w = np.zeros(size)
    ridge = np.diag(np.r_[np.full(size - 1, DECAY), 1e-9])
    inside = np.ones(len(x), bool)
    for _ in range(STEPS):
        left, right = ridge.copy(), np.zeros(size)
        for lo in range(0, len(x), 16 * BLOCK):
            own = np.flatnonzero(inside[lo:lo + 16 * BLOCK]) + lo
            xi = np.c_[x[own], np.ones(len(own))]
            left += (xi * weight[own, None]).T @ xi
            right += xi.T @ (weight[own] * y[own])
        w = np.linalg.solve(left, right)
        now = y * (x @ w[:-1].astype(x.dtype) + w[-1]) < 1
        if (now == inside).all() or not now.any():
            break
        inside = now
    return w[:-1], float(w[-1])


def _parts(data: np.ndarray, offsets: np.ndarray):
    """Row range and sentences of slices of the sample."""
    for lo, hi in tb.chunks(offsets):
        yield lo, hi, sentences(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])


def _odds(data: np.ndarray, offsets: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log odds of a subsequence standing in a toxic document; none below zero.

    Places with the same surroundings, eight symbols before to five behind, count once in a class, so copies do.
    """
    around = []
    for lo, hi, s in _parts(data, offsets):
        window = np.zeros(len(s.seq), np.uint64)
        wide = np.r_[np.zeros(8, np.uint8), s.seq, np.zeros(SKIPS + 3, np.uint8)].astype(np.uint64)
        for k in range(8 + SKIPS + 4):
            window = window * np.uint64(0xC2B2AE3D27D4EB4F) + wide[k:k + len(s.seq)] + np.uint64(1)
        toxic = y[np.minimum(lo + s.row, hi - 1)] == 1
        around.append(tb.mix(window) & ~np.uint64(1) | toxic.astype(np.uint64))
    size = [len(w) for w in around]
    every, fresh = np.concatenate(around), np.zeros(sum(size), bool)
    for k in range(16):  # a sixteenth at a time
        own = np.flatnonzero(every >> np.uint64(60) == k)
        fresh[own[np.unique(every[own], return_index=True)[1]]] = True
    del every
    held, begin = [np.ones(CODES), np.ones(CODES)], 0
    for (_, _, s), own in zip(_parts(data, offsets), around):
        new = fresh[begin:begin + len(own)]
        begin += len(own)
        toxic = (own & np.uint64(1)) == 1
        for code, at, weight in subsequences(s):
            for c in (0, 1):
                held[c] += np.bincount(code[new[at] & (toxic[at] == bool(c))], minlength=CODES)
    odds = np.log(held[1] / held[0])
    shift = np.log(held[1].sum() / held[0].sum())
    return np.maximum(odds - max(shift, 0), 0)


def _worst_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The worst span of every sentence: span, value, row."""
    spans, values, rows = [], [], []
    for lo, _, s in _parts(data, offsets):
        value, length = span_values(s, table)
        order = np.lexsort((-value, s.ends))
        at = order[np.r_[True, s.ends[order][1:] != s.ends[order][:-1]]]
        at = at[s.until[at] > at]
        spans.append(cut_out(s, at, length[at]))
        values.append(value[at])
        rows.append(lo + s.row[at])
    return np.concatenate(spans), np.concatenate(values), np.concatenate(rows)


def inserted(spans: np.ndarray, seed: int) -> np.ndarray:
    """Each span with one letter put in, once at each inner place."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(2, max(SPANS) + 3):
        rows = np.flatnonzero((k < spans[:, 0].astype(int) + 3) & (spans[:, min(k + 1, WIDTH)] != PAD))
        own = spans[rows]
        new = np.c_[own[:, :k + 1], rng.integers(0, 26, len(rows)), own[:, k + 1:-1]].astype(np.uint8)
        new[:, 0] = np.minimum(own[:, 0] + 1, WIDTH - 1)
        out.append(new)
    return np.concatenate(out)


def fit(texts: list[str], y: np.ndarray, landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> KernelModel:
    if len(set(y.tolist())) < 2:
        return KernelModel()
    part, every = np.zeros(len(y), int), y
    for c in (0, 1):
        part[y == c] = np.arange((y == c).sum()) % CALIBRATE
    train = part != 1  # a class of one row trains and sets no threshold
    data, offsets = tb.texts(pa.array([t for t, mine in zip(texts, train) if mine], pa.large_string()))
    rest, rest_y, y = [t for t, mine in zip(texts, train) if not mine], y[~train], y[train]
    table = _odds(data, offsets, y)
    spans, value, rows = _worst_spans(data, offsets, table)
    if len(set(y[rows].tolist())) < 2:
        return KernelModel()  # one class has no words
    positive = pool = np.zeros((0, WIDTH + 1), np.uint8)
    for turn in range(rounds):
        toxic = np.flatnonzero(y[rows] == 1)
        clean = y[rows] == 0
        limit = np.quantile(value[clean], 1 - CLEAN_SHARE)
        order = toxic[np.lexsort((-value[toxic], rows[toxic]))]
        first = np.r_[True, rows[order][1:] != rows[order][:-1]]
        positive = np.unique(np.r_[positive, spans[order[first | (value[order] > limit)]]], axis=0)
        hard = spans[clean][np.argsort(-value[clean], kind="stable")]
        pool = np.unique(np.r_[pool, hard], axis=0)
        more = inserted(positive, turn)
        rng = np.random.default_rng(turn)
        half = rng.permutation(positive)[: landmarks // 2]
        marks = np.r_[half, rng.permutation(hard[: HARD * landmarks])[: landmarks - len(half)]]
        codes, columns = landmark_columns(marks)
        eigen, vectors = np.linalg.eigh(columns.T @ columns)
        good = eigen > 1e-6 * eigen.max()
        root = vectors[:, good] / np.sqrt(eigen[good])  # Nyström: features = kernel values x root
        x = features(np.r_[positive, more, pool], codes, columns @ root)
        label = np.r_[np.ones(len(positive) + len(more)), -np.ones(len(pool))]
        weight = np.concatenate([np.full(n, share / n) for n, share in ((len(positive), 1.0), (len(more), 1.0), (len(pool), CLEAN_SPANS))])
        u, bias = _svm(x, label, weight)
        table = np.zeros(CODES, np.float32)
        table[codes] = columns @ (root @ u)
        model = KernelModel(table, bias)
        spans, value, rows = _worst_spans(data, offsets, table)
    # The slope and the place of the half: between clean and toxic documents the spans were not taken from.
    if len(set(rest_y.tolist())) < 2:
        rest, rest_y = texts, every
    data, offsets = tb.texts(pa.array(rest, pa.large_string()))
    worst = [model.worst(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) for a, b in tb.chunks(offsets)]
    model.bias -= _cut(np.concatenate(worst), rest_y)
    model.slope = 4.0
    return model


def _cut(worst: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the fewest errors, both classes weighing the same; the middle of its gap."""
    order = np.argsort(worst, kind="stable")
    value, label = worst[order], y[order]
    missed = np.r_[0, np.cumsum(label)] / max(1, label.sum())
    wrong = (1 - np.r_[0, np.cumsum(1 - label)] / max(1, (1 - label).sum())) * CLEAN_WEIGHT
    usable = np.r_[True, value[1:] > value[:-1], True]  # between different values only
    k = int(np.argmin(np.where(usable, missed + wrong, np.inf)))
    if k in (0, len(value)):
        return float(value[0] - 0.1 if k == 0 else value[-1] + 0.1)
    return float((value[k - 1] + value[k]) / 2)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> KernelModel:
    sample = labelled_sample(docs, labels, "toxic", rows)
    return fit(sample["text"].tolist(), sample["y"].to_numpy(float))


def score_documents(docs: DataFrame, model: KernelModel) -> DataFrame:
    """doc_id and score of every document; no shuffle. The table travels as a broadcast of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.bias, model.slope))

    def task(frames):
        own = KernelModel(*shared.value)
        for batch, data, offsets in tb.batches(frames):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.score(data, offsets))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, "doc_id long, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
