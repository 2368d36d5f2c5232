"""Best-fit decreasing packing with certified bin counts.

Documents become token ids plus an end id; what is longer than a sequence is cut. Pieces are dealt over
partitions, each packed best-fit decreasing. Lower bounds from dual feasible functions (and the plain
volume bound) certify a partition whose bin count equals its bound. Bins of other partitions that still
have gaps are opened: their pieces are exchanged between partitions and packed again, for a few rounds.

Within a partition pieces of one length are alike, so packing works on counts by length; memory follows
the sequence length and the pieces of a partition, whose number is bounded by ``PARTITION_PIECES``.

Defined results: a NULL or empty text is one piece, the end id alone; repeated rows (even of one
id) are packed each on its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gatewise.llm import textbytes as tb
from gatewise.llm.wordcache import WordCache, spread
from gatewise.session import written

SEQUENCE = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
PARTITION_PIECES = 50_000
ROUNDS = 3

#: Blanks in every notion of white space; others stay inside a word and are left to the tokenizer.
_WORD = tb.NOT_SPACE
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_workers: dict[str, tuple] = {}


def _worker(name: str):
    if name not in _workers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        _workers[name] = Tokenizer.from_file(public_tokenizers.path(name)), WordCache()
    return _workers[name]


def token_ids(data: np.ndarray, offsets: np.ndarray, tokenizer, cache: WordCache) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows one after the other, and where each row ends.

    The tokenizer's patterns never reach over white space, so each word has ids of its own.
    """
    starts, ends, rows = tb.word_spans(data, offsets, _WORD)
    hashes, first, back = np.unique(tb.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    word_at = lambda k: data[starts[first[k]]:ends[first[k]]].tobytes().decode("utf-8", "replace")
    encode = lambda words: [e.ids for e in tokenizer.encode_batch(words, add_special_tokens=False)]
    begin, size, pool = cache.lookup(hashes, word_at, encode)
    begin, size = begin[back], size[back].astype(np.int64)
    ids = pool[spread(begin, size)].astype(np.uint32)
    return ids, np.cumsum(np.bincount(rows, size, len(offsets) - 1).astype(np.int64))


def _cut(sequence: int, end_id: int, name: str):
    def task(frames):
        tokenizer, cache = _worker(name)
        tail = np.array([end_id], np.uint32)
        for batch, data, offsets in tb.batches(frames):
            ids, ends = token_ids(data, offsets, tokenizer, cache)
            out: list[list] = [[], [], [], [], []]
            begin = 0
            for doc, end in zip(batch.column(0).to_pylist(), ends.tolist()):
                own = np.concatenate([ids[begin:end], tail]).astype("<u4")
                begin = end
                for piece, start in enumerate(range(0, len(own), sequence)):
                    part = own[start:start + sequence]
                    for column, value in zip(out, (doc, piece, start, len(part), zlib.crc32(part.tobytes()))):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])
    return task


def token_pieces(docs: DataFrame, sequence: int = SEQUENCE, end_id: int = END_ID, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_cut(sequence, end_id, tokenizer), PIECES)


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """The best of the volume bound and the bounds of two families of dual feasible functions.

    ``u_k`` rounds lengths to multiples of 1/k of a bin, exact multiples excepted; ``f_e`` drops lengths
    below ``e`` and raises those above ``capacity - e`` to a whole bin. Each maps any bin's content
    to at most one bin, so the mapped volume bounds the number of bins.
    """
    if not len(lengths):
        return 0
    best = -(-int((lengths * counts).sum()) // capacity)
    for k in range(2, 21):
        scaled = lengths * (k + 1)
        units = np.where(scaled % capacity == 0, lengths * k, (scaled // capacity) * capacity)  # in 1/(k*capacity) of a bin
        best = max(best, -(-int((units * counts).sum()) // (k * capacity)))
    for e in np.unique(np.minimum(lengths, capacity - lengths)):
        if 0 < e <= capacity // 2:
            mapped = np.where(lengths > capacity - e, capacity, np.where(lengths < e, 0, lengths))
            best = max(best, -(-int((mapped * counts).sum()) // capacity))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece: longest first, each into the fullest bin that takes it."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    gaps: list[int] = []  # gaps that some bin has, ascending
    open_bins: dict[int, list[int]] = {}
    made = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        place = bisect.bisect_left(gaps, need)
        if place < len(gaps):
            gap = gaps[place]
            stack = open_bins[gap]
            b = stack.pop()
            if not stack:
                del open_bins[gap], gaps[place]
        else:
            b, gap, made = made, capacity, made + 1
        bins[k], offsets[k] = b, capacity - gap
        if left := gap - need:
            if left not in open_bins:
                open_bins[left] = []
                bisect.insort(gaps, left)
            open_bins[left].append(b)
    return bins, offsets


def _pack(capacity: int):
    """One partition: packed pieces, their bin's fill, and whether the bin may stay.

    Full bins stay. So do all others but the emptiest if the bin count equals its lower bound.
    """
    def task(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ignore_index=True)
        lengths = part["length"].to_numpy(np.int64)
        bins, offsets = best_fit_decreasing(lengths, capacity)
        number = int(bins.max()) + 1
        certified = number == lower_bound(*np.unique(lengths, return_counts=True), capacity)
        fill = np.bincount(bins, lengths, number).astype(np.int64)
        stays = fill == capacity
        if certified:
            stays |= np.arange(number) != np.argmin(fill)
        return part.assign(_bin=bins, offset=offsets, _stays=stays[bins])
    return task


_PACKED = PIECES + ", _part bigint, _bin bigint, offset bigint, _stays boolean"


def pack(pieces: DataFrame, sequence: int = SEQUENCE, partition_pieces: int = PARTITION_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    A piece of full length is a sequence. Each round deals the other pieces over partitions and packs
    them; bins that may not stay are opened, and their pieces are dealt anew in the next round, over as
    many fewer partitions as they are fewer. In the last round all bins stay.
    """
    full = F.col("length") >= sequence
    columns = PIECES.replace(",", "").split()[::2]
    number = lambda k, value: (value * F.lit(rounds + 1) + F.lit(k)).alias("sequence_id")  # noqa: E731  rounds never share a number
    out = pieces.where(full).select(*columns, number(rounds, F.monotonically_increasing_id()), F.lit(0).cast("long").alias("offset"))
    left = pieces.where(~full)
    for k in range(rounds):
        n = left.count()
        parts = max(1, math.ceil(n / partition_pieces))
        # Dealt by a hash of all columns and of the task that read the row, so that repeated rows spread.
        part = F.pmod(F.xxhash64(*columns, F.spark_partition_id(), F.lit(k)), F.lit(parts)).cast("long")
        packed = written(left.withColumn("_part", part).groupBy("_part").applyInPandas(_pack(sequence), _PACKED), "packed")
        last = k == rounds - 1 or parts == 1
        stays = F.lit(True) if last else F.col("_stays")
        spot = F.shiftleft(F.col("_part"), 24) + F.col("_bin")  # a partition has far fewer than 2**24 pieces
        out = out.unionByName(packed.where(stays).select(*columns, number(k, spot), "offset"))
        if last:
            break
        left = packed.where(~stays).select(*columns)
    return out


def pack_documents(docs: DataFrame) -> DataFrame:
    """Pieces are written first: packing reads them a few times and tokenizing is the costly part."""
    return pack(written(token_pieces(docs), "pieces"))
