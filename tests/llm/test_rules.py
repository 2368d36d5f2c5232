"""Counts against plain ones, the forest against its definition, and verdicts on held-out and edge rows."""

import re

import numpy as np
from pyspark.sql import functions as F

from gatewise.llm import rules
from gatewise.llm.learning import held_out
from tests.llm.conftest import pulled

LARGE = "/root/testdata/sf0.1"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BASE = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def plain(text):
    text = text or ""
    words, seen, again, windows, covered = WORDS.findall(text), set(), 0, {}, set()
    for line in text.split("\n"):
        if WORDS.search(line):
            again += line in seen
            seen.add(line)
    for k in range(len(words) - 7):
        windows.setdefault(tuple(words[k:k + 8]), []).append(k)
    for places in windows.values():
        if len(places) > 1:
            covered.update(k + i for k in places for i in range(8))
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered), n < 20 or 100 * len(covered) > 30 * n


EXTRA = [
    "a b c d e f g h " * 3, "x\n" * 5, "x\n\nx\r\nx\n x", "\n\n", "é ü#€ <b>\x0b\x0c|\x85 a b", "a b c d e f g h a b c d e f g h",
    "one line\none line", "one line\none line\n", "w " * 25, " ".join(map(str, range(40))) + " 0 1 2 3 4 5 6 7",
]


def test_counts(spark, docs, rows, nothing):
    extra = spark.createDataFrame([(5000 + k, t) for k, t in enumerate(EXTRA)], "doc_id bigint, text string")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    clash = docs.withColumns({c: F.lit("x") for c in ("n_words", "kept", "anomaly", "y", "_id", "c")})
    got = rules.rules_report(clash.unionByName(extra, allowMissingColumns=True), labels)
    want = [(d, *plain(t)) for d, t in [*rows, *[(5000 + k, t) for k, t in enumerate(EXTRA)]]]
    assert pulled(got, *BASE) == sorted(want, key=repr)
    assert got.where("base_failed and kept").count() == 0
    assert rules.rules_report(nothing, labels).count() == 0
    # one and the same text, one verdict
    assert got.where("doc_id in (1013, 1021)").select("kept", "anomaly").distinct().count() == 1


def test_without_labels_the_rules_decide(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    for some in (labels.where("false"), labels.where("quality = 1"), labels.withColumn("quality", F.lit(None).cast("int"))):
        assert rules.rules_report(docs, some).where("kept = base_failed").count() == 0


def test_rows_pass_unchanged(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    clash = docs.withColumns({c: F.lit("x") for c in ("n_words", "kept", "anomaly")})
    kept = rules.keep_regular(clash, docs, labels)
    assert kept.columns == clash.columns and kept.where("n_words = 'x'").count() == kept.count()
    want = rules.rules_report(docs, labels).where("kept").select("doc_id")
    assert pulled(kept, "doc_id") == pulled(want, "doc_id")


def test_held_out(spark):
    docs, labels = spark.read.parquet(f"{LARGE}/documents.parquet"), spark.read.parquet(f"{LARGE}/labels.parquet")
    got = rules.rules_report(docs, labels).join(labels.where(held_out()), "doc_id").toPandas()
    judged = got[~got["base_failed"]]
    assert judged[judged["quality"] == 1]["kept"].mean() > 0.97
    assert got[got["quality"] == 0]["kept"].mean() < 0.06
    # the two rules alone let half of the bad ones through
    assert got[got["quality"] == 0]["base_failed"].mean() < 0.7


def _depth(forest, tree, x):
    """Path length of one row, node by node."""
    node, depth, levels = 0, 0, forest.length.shape[1].bit_length() - 1
    while depth < levels:
        node = 2 * node + (2 if x[forest.feature[tree, node]] >= forest.place[tree, node] else 1)
        depth += 1
    return forest.length[tree, node - (2**levels - 1)]


def test_forest():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(0, 1, (500, 3)), rng.normal(0, 1, (20, 3)) + [9, 0, 0]
    forest = rules.grow(good, bad)
    x = np.vstack([good[:30], bad, [[0, 0, 0], [50, 50, 50]]])
    score = forest.score(x)
    for row, s in zip(x, score):
        mean = np.mean([_depth(forest, t, row) for t in range(rules.TREES)])
        assert np.isclose(s, 2 ** (-mean / rules.mean_depth(forest.rows)))
    assert score[30:50].min() > score[:30].mean() and score[-1] == score.max()
    again = rules.grow(good, bad)
    assert (again.place == forest.place).all()
    assert rules.mean_depth(1) == 0 and rules.mean_depth(2) == 1 and np.isclose(rules.mean_depth(3), 2 * (np.log(2) + np.euler_gamma) - 4 / 3)


def test_every_training_row_ends_in_a_leaf_of_its_own_size():
    few = np.arange(4.0)[:, None]
    forest = rules.grow(few, np.array([[100.0]]))
    assert (forest.score(np.array([[100.0]])) > forest.score(few)).all() and (forest.length >= 0).all()


def test_thresholds_come_from_all_labelled_rows(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    seen, limits = [], rules._limits
    monkeypatch.setattr(rules, "_limits", lambda table: seen.append(table) or limits(table))
    forest = rules.train(docs, labels, rows=30)
    judged = rules.counted(docs).join(labels.where(~held_out() & F.col("quality").isin(0, 1)), "doc_id").toPandas()
    want = (~rules.fails_rules(judged[list(rules.COUNTS)].to_numpy(np.int64))).sum()
    assert len(forest.limits) == len(rules.BANDS) and seen[0]["n"].sum() == want > 60
