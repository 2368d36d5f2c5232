"""Benchmark decontamination as a prefix-filtered set join.

Each benchmark item is cut into windows of 13 words (a shorter item is one window). A window is the
set of its three-word shingles; a document holds the window only if it holds all of them, so one
shingle is a sufficient prefix: the rarest over all documents. Documents are probed with these prefix
shingles only. A match fixes where the window would have to begin; position and length bounds drop
those outside the document, a hash of the whole window and then its words are compared.

The windows of a block of items are broadcast; a block has at most ``BLOCK_WINDOWS`` of them. Larger
benchmarks take several blocks, one after the other, over all documents.

Defined results: NULL and wordless texts and items have no words and hit nothing; an item without id
counts under the empty id; repeated items count once by id; repeated documents get equal results. Where
contaminated rows are dropped, the others keep all their columns, whatever their names; where hits are
returned, a document column by the name of a result column is left out for it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gatewise.llm import textbytes as tb
from gatewise.llm.columns import set_aside
from gatewise.session import written

WINDOW = 13
SHINGLE = 3
BLOCK_WINDOWS = 200_000
#: A document is contaminated when its hit words are at least one in this many.
SHARE = 20


def _words(data, offsets):
    starts, ends, rows = tb.word_spans(data, offsets, tb.ALNUM)
    return starts, ends, rows, tb.word_hashes(data, starts, ends, tb.LOWER)


def _fold(hashes: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The hash of ``size`` words from ``at``."""
    total = np.zeros(len(at), np.uint64)
    for k in range(int(size.max(initial=0))):
        more = size > k
        total[more] = total[more] * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[at[more] + k]
    return tb.mix(total + size.astype(np.uint64))


def _shown(data, starts, ends, at: int, size: int) -> bytes:
    """The lower-cased words, joined by blanks."""
    return b" ".join(tb.LOWER[data[starts[k]:ends[k]]].tobytes() for k in range(at, at + size))


def _cut(frames):
    """Items to windows: words, and hash and place of each shingle."""
    for batch in frames:
        data, offsets = tb.texts(batch.column(1))
        starts, ends, rows, hashes = _words(data, offsets)
        first = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        out = {"item": [], "words": [], "shingles": []}
        ids = batch.column(0).to_pylist()
        for r, item in enumerate(ids):
            lo, hi = int(first[r]), int(first[r + 1])
            if hi == lo:
                continue
            size = min(WINDOW, hi - lo)
            width = min(SHINGLE, size)
            for at in range(lo, hi - size + 1):
                inner = np.arange(at, at + size - width + 1)
                out["item"].append(item)
                out["words"].append(_shown(data, starts, ends, at, size))
                out["shingles"].append(_fold(hashes, inner, np.full(len(inner), width)).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["item"], pa.string()), pa.array(out["words"], pa.binary()), pa.array(out["shingles"], pa.list_(pa.int64()))],
            ["item", "words", "shingles"],
        )


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """One row per different window: its words, shingle hashes and the items that hold it."""
    cut = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    cut = cut.mapInArrow(_cut, "item string, words binary, shingles array<long>")
    return cut.groupBy("words").agg(F.first("shingles").alias("shingles"), F.sort_array(F.collect_set("item")).alias("items"))


def _occurring(known: np.ndarray, widths: list[int]):
    """Counts of the known shingles in documents."""
    def task(frames):
        total = np.zeros(len(known), np.int64)
        for _, data, offsets in tb.batches(frames):
            _, _, rows, hashes = _words(data, offsets)
            for width in widths:
                found, _, _ = tb.shingle_hashes(hashes, rows, width, short=False)
                at = np.searchsorted(known, found)
                at[at == len(known)] = 0
                total += np.bincount(at[known[at] == found], minlength=len(known))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], ["place", "n"])
    return task


class _Index:
    """Windows of a block, found by their rarest shingle."""

    def __init__(self, rows: pd.DataFrame, known: np.ndarray, counts: np.ndarray):
        self.words = list(rows["words"])
        self.items = [list(x) for x in rows["items"]]
        self.size = np.array([w.count(b" ") + 1 for w in self.words], np.int64)
        prefix, offset = np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.int64)
        for w, shingles in enumerate(rows["shingles"]):
            own = np.asarray(shingles, np.int64).view(np.uint64)
            best = np.lexsort((own, counts[np.searchsorted(known, own)]))[0]
            prefix[w], offset[w] = own[best], best
        order = np.argsort(prefix, kind="stable")
        self.window, self.offset = order, offset[order]
        self.keys, self.begin = np.unique(prefix[order], return_index=True)
        self.begin = np.r_[self.begin, len(order)]
        self.widths = sorted({min(SHINGLE, int(s)) for s in self.size})
        joined = b"\n".join(self.words)
        bounds = np.cumsum([0] + [len(w) + 1 for w in self.words])[:-1]
        data, offs = np.frombuffer(joined, np.uint8), np.r_[bounds, len(joined)]
        starts, ends, rows_, hashes = _words(data, offs)
        self.hash = _fold(hashes, np.searchsorted(rows_, np.arange(len(self.words))), self.size)

    def occurrences(self, data, offsets):
        """Row, first word and window of every window that occurs; words per row."""
        starts, ends, rows, hashes = _words(data, offsets)
        n = len(offsets) - 1
        first = np.searchsorted(rows, np.arange(n + 1))
        hits = []
        for width in self.widths:
            found, row, at = tb.shingle_hashes(hashes, rows, width, short=False)
            key = np.searchsorted(self.keys, found)
            key[key == len(self.keys)] = 0
            match = np.flatnonzero(self.keys[key] == found)
            key, row, at = key[match], row[match], at[match]
            many = self.begin[key + 1] - self.begin[key]
            which = np.repeat(np.arange(len(key)), many)
            place = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + self.begin[key][which]
            window, begin, row = self.window[place], at[which] - self.offset[place], row[which]
            size = self.size[window]
            fits = (begin >= first[row]) & (begin + size <= first[row + 1]) & (np.minimum(size, SHINGLE) == width)
            window, begin, row, size = window[fits], begin[fits], row[fits], size[fits]
            same = _fold(hashes, begin, size) == self.hash[window]
            hits += [
                (r, b, w) for r, b, w in zip(row[same].tolist(), begin[same].tolist(), window[same].tolist())
                if _shown(data, starts, ends, b, int(self.size[w])) == self.words[w]
            ]
        return hits, first


def _probe(shared, has_before: bool):
    def task(frames):
        index = shared.value
        for batch, data, offsets in tb.batches(frames):
            hits, first = index.occurrences(data, offsets)
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            items: list[set] = [set() for _ in range(batch.num_rows)]
            if has_before:
                spans = [[(x["start"], x["end"]) for x in row or []] for row in batch.column("_hits").to_pylist()]
                items = [set(row or []) for row in batch.column("_items").to_pylist()]
            for r, b, w in hits:
                spans[r].append((b - int(first[r]), b - int(first[r]) + int(index.size[w])))
                items[r].update(index.items[w])
            merged = [_merge(s) for s in spans]
            kept = [c for c in batch.schema.names if c not in ("_words", "_hits", "_items")]
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept]
                + [pa.array(np.diff(first), pa.int64()), pa.array([[{"start": a, "end": b} for a, b in s] for s in merged], span), pa.array([sorted(i) for i in items], pa.list_(pa.string()))],
                [*kept, "_words", "_hits", "_items"],
            )
    return task


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """All columns of ``docs`` plus ``n_words``, ``hits`` (word ranges, disjoint), ``items`` (ids as text)."""
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("n_words", "hits", "items")]
    table = written(windows(benchmark), "windows")
    blocks = max(1, math.ceil(table.count() / block_windows))
    result, back = set_aside(docs.select(*names), "text")
    for k in range(blocks):
        # The hash spreads windows evenly; a block is collected because it is then broadcast.
        block = table.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k).toPandas()
        shingles = [np.asarray(s, np.int64).view(np.uint64) for s in block["shingles"]]
        known = np.unique(np.concatenate(shingles)) if shingles else np.zeros(1, np.uint64)
        widths = sorted({min(SHINGLE, w.count(b" ") + 1) for w in block["words"]})
        counts = np.zeros(len(known), np.int64)
        if shingles:
            seen = docs.select("text").mapInArrow(_occurring(known, widths), "place long, n long")
            for place, n in seen.groupBy("place").agg(F.sum("n")).collect():  # at most one row per known shingle
                counts[place] = n
        shared = spark.sparkContext.broadcast(_Index(block, known, counts))
        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in result.select(*back).schema)
        found = result.mapInArrow(_probe(shared, k > 0), f"{kind}, _words long, _hits array<struct<start:long,end:long>>, _items array<string>")
        result = written(found, "hits") if blocks > 1 else found
    return result.select(*[F.col(new).alias(old) for new, old in back.items()], F.col("_words").alias("n_words"), F.col("_hits").alias("hits"), F.col("_items").alias("items"))


def judge(found: DataFrame) -> DataFrame:
    """Adds ``n_hit`` and ``contaminated`` to what :func:`find_contamination` returns."""
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x.end - x.start)
    return found.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = judge(find_contamination(docs.select("doc_id", "text"), benchmark))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.sort_array("items")), 256).alias("items_sha256"), "contaminated",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns unchanged, whatever their names."""
    plain, names = set_aside(docs, "text")
    kept = judge(find_contamination(plain, benchmark)).where(~F.col("contaminated"))
    return kept.select(*[F.col(new).alias(old) for new, old in names.items()])
