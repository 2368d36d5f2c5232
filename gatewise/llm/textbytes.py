"""Vectorised work on the UTF-8 bytes of Arrow string columns.

Helpers for Arrow tasks: texts are looked at as one byte array with offsets, in chunks of a few
megabytes, so that the memory of a task follows the chunk (or the longest text), not the batch.
NULL texts count as empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def _geometric(which: str, n: int) -> np.ndarray:
    """The first ``n`` powers of the base (``up``) or of its inverse (``down``)."""
    have = _powers[which]
    if len(have) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        base = _BASE if which == "up" else _BASE_INVERSE
        out = np.empty(size, _U)
        out[0] = 1
        done = 1
        while done < size:  # doubling: powers [done, 2 done) are the first ones times base**done
            take = min(done, size - done)
            out[done:done + take] = out[:take] * _U(pow(base, done, 1 << 64))
            done += take
        _powers[which] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: One 64-bit value per byte value.
BYTE_VALUES = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))


def byte_class(pattern_bytes) -> np.ndarray:
    """A table of 256 booleans, true for the given byte values."""
    table = np.zeros(256, bool)
    table[list(pattern_bytes)] = True
    return table


#: ``[^\x20\x09-\x0D]``: all but ASCII white space.
NOT_SPACE = ~byte_class([0x20, *range(0x09, 0x0E)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing: digits, letters, everything beyond ASCII.
ALNUM = byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: A-Z to a-z, every other byte as it is.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
SAME = np.arange(256, dtype=np.uint8)


def texts(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of an Arrow string column; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    column = pc.fill_null(column, "").cast(pa.large_string())
    n, first = len(column), column.offset
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[first:first + n + 1]
    return np.frombuffer(data, np.uint8)[offs[0]:offs[-1]], offs - offs[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer row is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def batches(frames, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each Arrow batch in slices of a few megabytes: slice, bytes, offsets."""
    for batch in frames:
        data, offsets = texts(batch.column(batch.schema.get_field_index(column)))
        for lo, hi in chunks(offsets):
            yield batch.slice(lo, hi - lo), data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of word bytes; runs end with their row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a row begins here
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = SAME) -> np.ndarray:
    """64-bit hashes of byte ranges, the same for the same (folded) bytes wherever they stand.

    Ranges are ascending and do not overlap. Sums run over blocks of the data, so that the powers
    needed stay few for a very long text.
    """
    if not len(starts):
        return np.zeros(0, _U)
    out = np.empty(len(starts), _U)
    lo = 0
    while lo < len(starts):
        hi = int(np.searchsorted(starts, starts[lo] + CHUNK_BYTES))
        hi = max(hi, lo + 1)
        first, last = int(starts[lo]), int(ends[hi - 1])
        sums = np.empty(last - first + 1, _U)
        sums[0] = 0
        np.cumsum(BYTE_VALUES[fold[data[first:last]]] * _geometric("up", last - first), out=sums[1:])
        s, e = starts[lo:hi] - first, ends[lo:hi] - first
        out[lo:hi] = mix((sums[e] - sums[s]) * _geometric("down", last - first)[s] + (e - s).astype(_U))
        lo = hi
    return out


def shingle_hashes(hashes: np.ndarray, rows: np.ndarray, width: int, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word of every run of ``width`` words of one row.

    ``short``: a row of fewer words, but not none, has one shingle of all its words.
    """
    n = len(hashes)
    none = np.zeros(0, np.int64)
    if n == 0:
        return np.zeros(0, _U), none, none
    total = np.zeros(max(n - width + 1, 0), _U)
    if n >= width:
        for k in range(width):
            total = total * _U(0xC2B2AE3D27D4EB4F) + hashes[k:n - width + 1 + k]
        first = np.flatnonzero(rows[:n - width + 1] == rows[width - 1:])
        out, at = mix(total[first] + _U(width)), first
    else:
        out, at = np.zeros(0, _U), none
    if short:
        begin = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        size = np.diff(np.r_[begin, n])
        few, fewer = begin[size < width], size[size < width]
        extra = np.zeros(len(few), _U)
        for k in range(width - 1):
            has = fewer > k
            extra[has] = extra[has] * _U(0xC2B2AE3D27D4EB4F) + hashes[few[has] + k]
        extra = mix(extra + fewer.astype(_U))
        out, at = np.r_[out, extra], np.r_[at, few]
        order = np.argsort(at, kind="stable")
        out, at = out[order], at[order]
    return out, rows[at], at
