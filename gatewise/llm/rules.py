"""Quality rules: an isolation forest on rule statistics.

Every whole text is reduced to counts that quality rules look at (words, characters, symbols, repeated lines and
phrases, letters, digits, punctuation). Two rules always hold: a document of fewer than 20 words, or one with over
30 % of its words in repeated phrases, fails. Of the others, an isolation forest says how unusual their
shares are: trees split a small sample at random places of random statistics, and a document that few splits
set apart from the rest is anomalous. How short the mean path may be is calibrated on labelled rows, for short, middling and
long texts apart, since shares of few words scatter more.

Every labelled document outside the held-out fold is counted and scored for the thresholds, by a histogram of scores.
A tree grows from ``TREE_ROWS`` rows by definition; they come from a pool, drawn by hash, that is large enough for all
trees to have rows of their own, and only the pool's counts reach the driver. Anomalies must be rare for random splits to
isolate them, so a tree's sample holds few rows labelled bad, whatever their share among the labels. Every document is scored, whole.

Defined results: a NULL or empty text has no words and fails; repeated rows get the same verdict; rows of one id
count once in training (the least counts); without labelled rows of both classes no forest judges and the two rules decide
alone; labels other than 0 and 1 are not used; an empty table gives an empty result; columns other than id and text
are not looked at and, where rows are filtered, pass unchanged, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gatewise.llm.learning import held_out
from gatewise.llm.textbytes import NOT_SPACE, batches, byte_class, mix, shingle_hashes, word_hashes, word_spans
from gatewise.session import written

#: Trees, rows a tree is grown from, and the share of them labelled bad.
TREES, TREE_ROWS, BAD_SHARE = 200, 256, 0.04
#: Labelled documents of a class that the trees' samples are drawn from.
POOL_ROWS = TREES * TREE_ROWS
SEED = 20
#: Digits of a score, so that thresholds come from a small histogram of any number of rows.
DIGITS = 4
#: The rules that hold without a forest.
LEAST_WORDS, MOST_REPEATED, PHRASE = 20, 30, 8
#: Lower ends, in words, of the bands that have a threshold each, and the rows of a class a band needs for its own.
BANDS, BAND_ROWS = (0, 100, 400), 40

# The symbols counted.
SYMBOLS = b"#*$%&|<>"
_DIGITS = byte_class(range(0x30, 0x3A))
_UPPER = byte_class(range(0x41, 0x5B))
_LETTERS = byte_class([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_ASCII_LETTERS = byte_class([*range(0x41, 0x5B), *range(0x61, 0x7B)])
_POINTS = byte_class([b for b in range(0x21, 0x7F) if not (chr(b).isalnum())])
_FIRST_BYTES = byte_class([*range(0x80), *range(0xC0, 0x100)])
_SYMBOLS = byte_class(SYMBOLS)

#: Counts of a text, in the order they are returned.
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_digits",
    "n_points", "n_letter_words",
)


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _doubles(keys: np.ndarray) -> np.ndarray:
    """Which of the keys occur more than once."""
    _, place, times = np.unique(keys, return_inverse=True, return_counts=True)
    return times[place] > 1


def count(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of counts per text; words, lines and phrases are told apart by 64-bit hashes."""
    n = len(offsets) - 1
    out = np.zeros((n, len(COUNTS)), np.int64)
    starts, ends, rows = word_spans(data, offsets, NOT_SPACE)
    if not len(starts):
        return out
    put = lambda name, values: out.__setitem__((slice(None), COUNTS.index(name)), values)
    put("n_words", np.bincount(rows, minlength=n))
    put("word_chars", _per_row(NOT_SPACE[data] & _FIRST_BYTES[data], offsets))
    for name, table in (("n_symbols", _SYMBOLS), ("n_letters", _ASCII_LETTERS), ("n_upper", _UPPER), ("n_digits", _DIGITS), ("n_points", _POINTS)):
        put(name, _per_row(table[data], offsets))
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_LETTERS[data], out=letters[1:])
    put("n_letter_words", np.bincount(rows[letters[ends] > letters[starts]], minlength=n))
    # lines with a word: those that the first word of a line lies in
    cuts = np.union1d(np.flatnonzero(data == 0x0A), offsets[1:-1] - 1)
    line = np.searchsorted(cuts, starts)
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    line, line_row = line[first], rows[first]
    begin = np.r_[0, cuts + 1][line]
    end = np.r_[cuts, len(data)][line]
    # a text that ends without a newline ends behind its last byte
    end = np.where(data[np.minimum(end, len(data) - 1)] == 0x0A, end, np.minimum(end + 1, len(data)))
    put("n_lines", np.bincount(line_row, minlength=n))
    salt = mix(np.arange(1, n + 1, dtype=np.uint64))
    alike = np.unique(word_hashes(data, begin, end) ^ salt[line_row], return_index=True)[1]
    put("n_dup_lines", np.bincount(line_row, minlength=n) - np.bincount(line_row[alike], minlength=n))
    phrases, phrase_row, at = shingle_hashes(word_hashes(data, starts, ends), rows, PHRASE, short=False)
    if len(phrases):
        again = at[_doubles(phrases ^ salt[phrase_row])]
        cover = np.bincount(again, minlength=len(starts) + 1) - np.bincount(again + PHRASE, minlength=len(starts) + 1)
        put("n_repeat_words", np.bincount(rows[np.cumsum(cover)[:-1] > 0], minlength=n))
    return out


def shares(counts: np.ndarray) -> np.ndarray:
    """What the forest looks at: counts as shares, which mean the same for short and long texts."""
    c = {name: counts[:, k].astype(float) for k, name in enumerate(COUNTS)}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.column_stack([
        c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words,
        c["n_upper"] / np.maximum(c["n_letters"], 1), c["n_digits"] / chars, c["n_points"] / chars,
        np.log(words / lines), c["n_letter_words"] / words])


def fails_rules(counts: np.ndarray) -> np.ndarray:
    words, repeated = counts[:, COUNTS.index("n_words")], counts[:, COUNTS.index("n_repeat_words")]
    return (words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * words)


# ---- forest -----------------------------------------------------------------------------------------------


def mean_depth(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` rows, for leaves that were not split further."""
    n = np.asarray(n, float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Complete binary trees; a node that was not split sends everything left, down to its path length.

    ``limits``: the highest score that passes, per band of :data:`BANDS`.
    """

    feature: np.ndarray
    place: np.ndarray
    length: np.ndarray
    rows: int
    limits: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the shorter the mean path, the higher."""
        total, trees = np.zeros(len(x)), len(self.feature)
        levels = self.length.shape[1].bit_length() - 1
        for lo in range(0, len(x), 2048):
            part = x[lo:lo + 2048]
            row, tree = np.arange(len(part))[:, None], np.arange(trees)[None, :]
            node = np.zeros((len(part), trees), np.int64)
            for _ in range(levels):
                node = 2 * node + 1 + (part[row, self.feature[tree, node]] >= self.place[tree, node])
            total[lo:lo + 2048] = self.length[tree, node - (2**levels - 1)].mean(axis=1)
        return 2.0 ** (-total / max(float(mean_depth(self.rows)), 1e-9))

    def kept(self, counts: np.ndarray, score: np.ndarray) -> np.ndarray:
        band = np.searchsorted(BANDS, counts[:, COUNTS.index("n_words")], "right") - 1
        return np.round(score, DIGITS) <= self.limits[band]


def grow(good: np.ndarray, bad: np.ndarray, seed: int = SEED) -> Forest:
    """Each tree from a sample of its own, of :data:`TREE_ROWS` rows, few of them bad."""
    random = np.random.default_rng(seed)
    few = min(len(bad), max(1, round(TREE_ROWS * BAD_SHARE)))
    size = min(len(good), TREE_ROWS - few) + few
    levels = max(1, int(np.ceil(np.log2(size))))
    feature = np.zeros((TREES, 2**levels - 1), np.int64)
    place, length = np.full(feature.shape, np.inf), np.zeros((TREES, 2**levels))
    for t in range(TREES):
        x = np.vstack([good[random.choice(len(good), size - few, replace=False)], bad[random.choice(len(bad), few, replace=False)]])
        open_ = [(0, 0, x)]
        while open_:
            node, depth, rows = open_.pop()
            low, high = rows.min(axis=0), rows.max(axis=0)
            varies = np.flatnonzero(high > low)
            if depth == levels or len(rows) < 2 or not len(varies):
                # the leftmost end below this node
                end = (node + 1) * 2 ** (levels - depth) - 1 - (2**levels - 1)
                length[t, end] = depth + mean_depth(len(rows))
                continue
            k = random.choice(varies)
            at = random.uniform(low[k], high[k])
            # a split between the two ends, also when rounding puts it on the lower one
            at = at if at > low[k] else high[k]
            feature[t, node], place[t, node] = k, at
            right = rows[:, k] >= at
            open_ += [(2 * node + 1, depth + 1, rows[~right]), (2 * node + 2, depth + 1, rows[right])]
    return Forest(feature, place, length, size)


def _limit(seen: pd.DataFrame) -> float:
    """Where the shares of good rows above and of bad rows below are least together; between the two scores there.

    ``seen``: score, y and n, the number of rows.
    """
    table = seen.pivot_table(index="score", columns="y", values="n", aggfunc="sum", fill_value=0).sort_index()
    scores, good, bad = table.index.to_numpy(), table[1].cumsum().to_numpy(), table[0].cumsum().to_numpy()
    best = int(np.argmin(1 - good / good[-1] + bad / bad[-1]))
    return float((scores[best] + scores[min(best + 1, len(scores) - 1)]) / 2)


def _limits(seen: pd.DataFrame) -> np.ndarray:
    """A threshold per band, that of all rows where a band has few; ``seen``: band, y, score, n."""
    whole, limits = _limit(seen), []
    for band in range(len(BANDS)):
        own = seen[seen["band"] == band]
        enough = min(own.loc[own["y"] == y, "n"].sum() for y in (0, 1)) >= BAND_ROWS
        limits.append(_limit(own) if enough else whole)
    return np.array(limits)


# ---- Spark ------------------------------------------------------------------------------------------------


def counted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Id and counts of every whole text."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def work(frames):
        for part, data, offsets in batches(frames):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array(c) for c in count(data, offsets).T]], ["doc_id", *COUNTS])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(work, f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = POOL_ROWS) -> Forest | None:
    """A forest whose trees draw from at most ``rows`` documents a class, calibrated on all labelled ones outside the held-out fold."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    # counts are joined, not texts
    least = counted(docs).join(known, "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(*COUNTS)).alias("c"))
    least = written(least.select("doc_id", "y", "c.*"), "rule-counts")
    passing = least.where((F.col("n_words") >= LEAST_WORDS) & (100 * F.col("n_repeat_words") <= MOST_REPEATED * F.col("n_words")))
    pool = {}
    for y in (0, 1):
        drawn = passing.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).toPandas().sort_values("doc_id")
        pool[y] = shares(drawn[list(COUNTS)].to_numpy(np.int64))
    if not min(len(pool[0]), len(pool[1])):
        return None
    forest = grow(pool[1], pool[0])

    def score(frames):
        for frame in frames:
            counts = frame[list(COUNTS)].to_numpy(np.int64)
            band = np.searchsorted(BANDS, counts[:, COUNTS.index("n_words")], "right") - 1
            yield pd.DataFrame({"band": band, "y": frame["y"], "score": np.round(forest.score(shares(counts)), DIGITS)})

    # at most one row per band, class and score of few digits
    seen = passing.mapInPandas(score, "band int, y int, score double").groupBy("band", "y", "score").agg(F.count(F.lit(1)).alias("n"))
    forest.limits = _limits(seen.toPandas())
    return forest


def _judged(forest: Forest | None, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts, whether the rules fail, anomaly score and verdict."""
    counts = count(data, offsets)
    failed = fails_rules(counts)
    if forest is None:
        return counts, failed, np.zeros(len(counts)), ~failed
    score = forest.score(shares(counts))
    return counts, failed, score, ~failed & forest.kept(counts, score)


def rules_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, rules, anomaly score and verdict of every document."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    told = COUNTS[:5]

    def work(frames):
        for part, data, offsets in batches(frames):
            counts, failed, score, kept = _judged(held.value, data, offsets)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array(counts[:, k]) for k in range(len(told))], pa.array(failed), pa.array(kept), pa.array(score)],
                ["doc_id", *told, "base_failed", "kept", "anomaly"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in told)
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, {counts}, base_failed boolean, kept boolean, anomaly double")


def keep_regular(docs: DataFrame, learned_from: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that pass the rules and the forest."""
    held = docs.sparkSession.sparkContext.broadcast(train(learned_from, labels))

    def work(frames):
        for part, data, offsets in batches(frames, text):
            yield part.filter(pa.array(_judged(held.value, data, offsets)[3]))

    return docs.mapInArrow(work, docs.schema)
