"""Merkle proofs against trees built in one place, and multiproofs of any range of leaves."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from gatewise.llm import merkle
from tests.llm.conftest import pulled

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _hash(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(values):
    return _hash("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def _tree(level):
    levels = [level]
    while len(level) > 1:
        level = [_hash(level[i:i + 3]) for i in range(0, len(level), 3)]
        levels.append(level)
    return levels


def _siblings(levels, i):
    for level in levels[:-1]:
        first = i - i % 3
        yield level[first:i], level[i + 1:first + 3]
        i //= 3


def plain(rows):
    """``rows``: doc_id, source, lang, n_chars, text."""
    first = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=first)
    for own in groups.values():
        own.sort(key=lambda r: (first(r[0]), _leaf(r)))
    trees = [_tree([_leaf(r) for r in groups[s]]) for s in names]
    top = _tree([t[-1][0] for t in trees])
    for j, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            siblings = [*_siblings(trees[j], i), *_siblings(top, j)]
            cut = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            folded = _leaf((*r[:4], r[4].replace("\n", ""))) if cut else _leaf(r)
            for left, right in siblings:
                folded = _hash([*left, folded, *right])
            proof = _hash(d for left, right in siblings for d in (*left, *right))
            yield r[0], trees[j][0][i], trees[j][-1][0], top[-1][0], proof, folded, folded == top[-1][0]


def test_manifest_of_edge_rows(spark, docs, rows, nothing):
    sources = F.expr("case n % 11 when 0 then null when 1 then '' when 2 then 'é' when 3 then concat('one-', n) else concat('s', n % 3) end")
    # further columns by names that the job uses inside
    odd = docs.withColumn("source", sources).withColumns({c: F.lit(None).cast("string") for c in ("part", "rank", "grp", "tree", "digest", "_rank", "leaf", "root", "id")})
    want = list(plain([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd.collect()]))
    got = merkle.manifest_report(odd)
    assert got.columns[:len(COLUMNS)] == list(COLUMNS) and pulled(got, *COLUMNS) == sorted(want, key=repr)
    assert any(w[-1] for w in want) and not all(w[-1] for w in want)
    assert merkle.manifest_report(nothing).count() == 0


@pytest.mark.parametrize("leaves, levels", [(9, 1), (5, 2), (50, 7)])
def test_partitions_that_hold_parts_of_several_sources(spark, monkeypatch, leaves, levels):
    monkeypatch.setattr(merkle, "LEAVES", leaves)
    monkeypatch.setattr(merkle, "LEVELS", levels)
    sizes = {"a": 82, "b": 1, "c": 27, "d": 2, "e": 4}
    rows = [(k * 7 % 1009, s, None, k, f"t\n{k % 5}") for s, n in sizes.items() for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert pulled(merkle.manifest_report(docs), *COLUMNS) == sorted(plain(rows), key=repr)


def test_text_ids_and_other_fields(spark):
    rows = [(f"d{k}", "s", k) for k in range(30)]
    table = spark.createDataFrame(rows, "name string, kind string, value int")
    got = merkle.manifest(table, ("name", "kind", "value"), "kind", "name").collect()
    levels = _tree([_leaf(r) for r in sorted(rows, key=lambda r: r[0])])
    assert {r.root for r in got} == {_tree([levels[-1][0]])[-1][0]} and all(r.verified for r in got)
    assert [r.leaf for r in sorted(got, key=lambda r: r.doc_id)] == levels[0]


def test_missing_is_the_least_that_completes_all_proofs():
    for n in (1, 2, 3, 4, 9, 10, 26, 28):
        for lo in range(n):
            for hi in range(lo + 1, n + 1):
                levels = _tree([str(k) for k in range(n)])
                asked = merkle.missing(lo, hi, n)
                nodes = {(0, k): levels[0][k] for k in range(lo, hi)}
                own = dict(nodes)
                merkle.derive(own, n)
                assert not set(asked) & set(own)
                nodes |= {(level, k): levels[level][k] for level, k in asked}
                merkle.derive(nodes, n)
                for k in range(lo, hi):
                    assert merkle.path(nodes, k, n) == list(_siblings(levels, k))
                # none of them follows from the others: without it some proof is incomplete
                for gone in asked:
                    less = {(0, k): levels[0][k] for k in range(lo, hi)} | {c: levels[c[0]][c[1]] for c in asked if c != gone}
                    merkle.derive(less, n)
                    assert gone not in less
                published = list(merkle.frontier(lo, hi, n))
                assert all(c in own for c in published)
