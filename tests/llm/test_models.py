"""Classifiers on held-out rows, and on rows without text or labels."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from gatewise.llm import quality, textbytes as tb, toxicity

LARGE = "/root/testdata/sf0.1"


@pytest.mark.parametrize("module, label, report", [(quality, "quality", quality.quality_report), (toxicity, "toxic", toxicity.toxicity_report)])
def test_held_out(spark, module, label, report):
    docs, labels = spark.read.parquet(f"{LARGE}/documents.parquet"), spark.read.parquet(f"{LARGE}/labels.parquet")
    got = report(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    for y in (0, 1):
        mine = got[got[label] == y]
        assert (mine["predicted"] == y).mean() > 0.9, (label, y)
    assert got["score"].between(0, 1).all()


@pytest.mark.parametrize("report, label", [(quality.quality_report, "quality"), (toxicity.toxicity_report, "toxic")])
def test_edge_rows(spark, docs, rows, nothing, report, label):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    odd = labels.unionByName(labels.limit(3)).unionByName(spark.sql("select 1002L doc_id, cast(null as int) quality, cast(null as int) toxic"))
    got = report(docs, odd).toPandas()
    assert len(got) == len(rows) and got["score"].between(0, 1).all()
    assert report(docs, odd.where("false")).toPandas()["score"].nunique() == 1
    assert report(nothing, odd).count() == 0


def test_attention_gradients():
    rng = np.random.default_rng(1)
    x, first, y = rng.standard_normal((9, quality.FEATURES)), np.array([0, 3, 4, 9]), np.array([1.0, 0.0, 1.0])
    model = quality.AttentionModel(quality.AttentionModel.fresh())
    weight = np.ones(3)

    def loss():
        p = model.forward(x, first)["y"]
        decay = sum((model.params[k] ** 2).sum() for k in ("E", "V", "U", "w", "c")) * quality.DECAY / 2
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() + decay

    grads = model.gradients(model.forward(x, first), y, weight)
    for name in ("E", "V", "U", "w", "c", "b", "e"):
        at = tuple(0 for _ in model.params[name].shape)
        model.params[name][at] += 1e-6
        up = loss()
        model.params[name][at] -= 2e-6
        down = loss()
        model.params[name][at] += 1e-6
        assert grads[name][at] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-7)


def test_sentences():
    def read(text):
        data = np.frombuffer(text.encode(), np.uint8).copy()
        s = toxicity.sentences(data, np.array([0, len(data)]))
        return "".join("|" if k in (0, *s.until) else "_" if c == toxicity.BLANK else chr(97 + c) for k, c in enumerate(s.seq))

    assert read("You  Idiot, go. A b c d! x1y*z") == "|you_idiot_go|abcd|xyz|"
    assert read("e.g. no\u00a0break\u3000wide") == "|eg|no_break_wide|"
    assert read("") == read(" \n ") == read("..") == "|"


def test_scores_against_single_spans():
    """The table scan equals the greatest value over all spans, each counted by itself from its symbols."""
    rng = np.random.default_rng(3)
    table = rng.standard_normal(toxicity.CODES)
    texts = ["You idiot, go away. Be well!", "", "a", "x y z w v", "no", "Été à la plage\nand then\u00a0some more words", "q" * 40]
    data, offsets = tb.texts(pa.array(texts))
    got = toxicity.KernelModel(table, 0.0).worst(data, offsets)
    for text, value in zip(texts, got):
        own = np.frombuffer(text.encode(), np.uint8)
        s = toxicity.sentences(own, np.array([0, len(own)]))
        seq, stops = s.seq.tolist(), sorted({0, *s.until.tolist()})
        best = 0.0
        for begin, end in zip(stops, stops[1:]):
            sentence = seq[begin:end + 1]
            for first in range(len(sentence) - 1):
                for size in toxicity.SPANS:
                    total = norm = 0.0
                    for i in range(first, min(first + size, len(sentence) - 1)):
                        for a, b, c in itertools.combinations(range(i + 1, min(i + toxicity.SKIPS + 4, len(sentence))), 3):
                            weight = toxicity.GAP_WEIGHT ** (c - i - 3)
                            x = [sentence[j] for j in (i, a, b, c)]
                            total += weight * table[((x[0] * 32 + x[1]) * 32 + x[2]) * 32 + x[3]]
                            norm += weight**2
                    best = max(best, total / max(norm, toxicity.LEAST_NORM) ** 0.5)
        assert value == pytest.approx(best), text


def test_kernel_of_spans():
    """Features equal a direct count of common gapped subsequences of two spans."""
    def spans(words):
        data, offsets = tb.texts(pa.array(words))
        s = toxicity.sentences(data, offsets)
        at = np.flatnonzero(s.until[:-1] > np.arange(len(s.seq) - 1))
        at = at[np.r_[True, s.row[at][1:] != s.row[at][:-1]]]
        return toxicity.cut_out(s, at, np.full(len(at), 8))

    def vector(word):
        sentence, out, norm = f" {word} ", {}, 0.0
        for i in range(min(8, len(sentence) - 1)):
            for a, b, c in itertools.combinations(range(i + 1, min(i + toxicity.SKIPS + 4, len(sentence))), 3):
                weight = toxicity.GAP_WEIGHT ** (c - i - 3)
                key = "".join(sentence[j] for j in (i, a, b, c))
                out[key], norm = out.get(key, 0) + weight, norm + weight**2
        return {k: v / max(norm, toxicity.LEAST_NORM) ** 0.5 for k, v in out.items()}

    words, marks = ["idiot", "idxiot", "banana"], ["idiot", "ananas"]
    got = toxicity.features(spans(words), *toxicity.landmark_columns(spans(marks)))
    want = [[sum(v * vector(m).get(k, 0) for k, v in vector(w).items()) for m in marks] for w in words]
    assert got == pytest.approx(np.array(want), rel=1e-4)
    assert got[1, 0] > 0.2 and got[2, 0] == 0


@pytest.fixture(scope="module")
def learned(spark):
    return toxicity.train(spark.read.parquet(f"{LARGE}/documents.parquet"), spark.read.parquet(f"{LARGE}/labels.parquet"))


def flagged(model, sentences):
    data, offsets = tb.texts(pa.array(sentences))
    return model.score(data, offsets) >= toxicity.THRESHOLD


INSULTS = ["idiot", "stupid", "moron", "clown", "scum", "trash", "loser", "disgusting", "worthless", "pathetic"]
CARRIER = "Thonre was the %s of inered ha."


def test_insults_with_insertions(learned):
    put_in = {sign: [CARRIER % (w[:k] + sign + w[k:]) for w in INSULTS for k in range(1, len(w))] for sign in "xqzvjeat17*.-"}
    every = flagged(learned, [text for sign in put_in.values() for text in sign])
    assert every.mean() >= 0.9
    for sign in "17*-":
        assert flagged(learned, put_in[sign]).all(), sign
    assert not flagged(learned, [CARRIER % "other", CARRIER % "the"]).any()


@pytest.mark.parametrize("form", ["and the,%s,there of", "and the\u00a0%s\u00a0there of", "and (%s) there of", "AND THE %s!"])
def test_insults_without_plain_blanks(learned, form):
    assert flagged(learned, [form % w for w in INSULTS]).all()


def test_insults_letter_by_letter(learned):
    assert flagged(learned, [CARRIER % " ".join(w) for w in INSULTS]).all()
