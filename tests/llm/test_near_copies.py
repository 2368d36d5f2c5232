"""The near-copy operator and stage at limits of five words and 80 %."""

import re

import corpus_pipeline
from gatewise.llm import jaccard
from tests.llm import brute
from tests.llm.conftest import DATA, pulled


def _shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(brute.LOWER))
    return frozenset(tuple(words[k:k + width]) for k in range(len(words) - width + 1)) or frozenset([tuple(words)] if words else [])


def _components(rows, width, percent):
    sets = [(d, _shingles(t, width)) for d, t in rows]
    edges = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    return brute.components([d for d, _ in sets], edges)


def _planted():
    """A text of 200 words, and copies with 4 and with 5 of its words changed."""
    words = [f"word{k}" for k in range(200)]
    four = [f"other{k}" if k in (30, 70, 110, 150) else w for k, w in enumerate(words)]
    five = [f"third{k}" if k in (20, 60, 100, 140, 180) else w for k, w in enumerate(words)]
    return [(5001, " ".join(words)), (5002, " ".join(four)), (5003, " ".join(five))]


def test_stage_keeps_one_of_a_pair_between_the_two_limits(spark):
    rows = _planted()
    share = lambda a, b, width: len(_shingles(a, width) & _shingles(b, width)) / len(_shingles(a, width) | _shingles(b, width))
    assert share(rows[0][1], rows[1][1], 3) < 0.9 and 0.80 <= share(rows[0][1], rows[1][1], 5) < 0.89 and share(rows[0][1], rows[2][1], 5) < 0.8
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, DATA, 5, 80)
    assert pulled(kept, "doc_id") == [(5001,), (5003,)]
    assert pulled(jaccard.keep_one(docs), "doc_id") == [(5001,), (5002,), (5003,)]  # the query's own limits


def test_near_copies_of_five_words(docs, rows):
    named = [r for r in rows if r[0] is not None] + _planted()
    frame = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(_planted(), "doc_id bigint, text string"))
    want = _components(named, 5, 80)
    got = pulled(jaccard.near_copies(frame, 5, 80).where("doc_id is not null").distinct(), "doc_id", "component_id")
    assert got == sorted(want.items(), key=repr)
