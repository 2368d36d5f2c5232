"""Removal of repeated 100-byte strings with suffix arrays.

Every 100-byte window has an anchor, its least 28-byte hash (the first of equals); equal windows have
equal anchors. Consecutive windows of one anchor form a run. Runs are dealt by anchor: a run whose
bytes occur in only one form needs no comparison, all its occurrences but the first are copies. Where an
anchor has several forms, the bytes of the first occurrence of each form are fetched and
suffix-sorted (see :mod:`gatewise.llm.suffixes`); windows that share 100 bytes stand together in the order.

Sorting works on phrases (a word and the blank behind it): phrases are ranked by their bytes, no phrase
is a prefix of another, so the order of phrase suffixes is the order of the bytes. Runs without
blanks are sorted byte by byte. An anchor with very many forms is split: its windows are dealt by their
whole bytes instead, and equal ones meet.

Skew: copies inside a task are combined before the shuffle, so an anchor sends at most one row per form, text of one id and
task; a partition of the sort holds about ``SORT_BYTES``. Anchors, forms, windows and the texts of one id or
without id are told apart by 64-bit hashes (windows of a split anchor by 128 bits).

Defined results: NULL is an empty text; a text under 100 bytes keeps all; equal windows at equal
places of rows of one id keep their bytes, for none starts earlier; a missing id comes before all others; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from gatewise.llm import textbytes as tb
from gatewise.llm.suffixes import suffix_order
from gatewise.session import written

LENGTH = 100
ANCHOR = 28
LONGEST_PHRASE = 64
FORMS = 20_000
SORT_BYTES = 1 << 21
HELD_ROWS = 1 << 18
NO_ID = -(1 << 63)

_U = np.uint64
#: After these bytes a phrase ends.
_BREAK = tb.byte_class([0x20, 0x0A])


def _sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(tb.BYTE_VALUES[data] * tb._geometric("up", len(data)), out=out[1:])
    return out


def _ranges(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return tb.mix((sums[end] - sums[begin]) * tb._geometric("down", len(sums))[begin] + (end - begin).astype(_U))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the first least value of every ``width`` consecutive ones, by doubling."""
    at, value, size = np.arange(len(h)), h, 1
    while size < width:
        step = min(size, width - size)
        take = value[step:] < value[:-step]
        at, value = np.where(take, at[step:], at[:-step]), np.where(take, value[step:], value[:-step])
        size += step
    return at


def runs(data: np.ndarray, offsets: np.ndarray):
    """anchor hash, form hash, row, first window, number of windows, anchor's place behind the first window."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none.astype(_U), none.astype(_U), none, none, none, none
    sums = _sums(data)
    h = _ranges(sums, np.arange(n - ANCHOR + 1), np.arange(ANCHOR, n + 1))
    at = _least(h, LENGTH - ANCHOR + 1)
    window = np.arange(len(at))
    row = np.searchsorted(offsets, window, "right") - 1
    inside = offsets[row + 1] - window >= LENGTH
    window, at, row = window[inside], at[inside], row[inside]
    if not len(window):
        return none.astype(_U), none.astype(_U), none, none, none, none
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)])
    count = np.diff(np.r_[first, len(window)])
    begin, anchor = window[first], at[first]
    form = tb.mix(_ranges(sums, begin, begin + count + LENGTH - 1) + (anchor - begin).astype(_U) * _U(0x9FB21C651E98DF25))
    return h[anchor], form, row[first], begin - offsets[row[first]], count, anchor - begin


def _place(start, count, behind):
    """A run's place in its document as one number, ordered by its start."""
    return (start << 14) | (count << 7) | behind


def _unplace(place):
    return place >> 14, (place >> 7) & 127, place & 127


def text_tags(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text, which tells rows of one id, or without id, apart."""
    out = np.zeros(len(offsets) - 1, np.int64)
    full = np.flatnonzero(np.diff(offsets))
    out[full] = tb.word_hashes(data, offsets[full], offsets[full + 1]).view(np.int64)
    return out


def _repeated_rows(doc, place, tag) -> np.ndarray:
    """Whether a run is that of the row before: the same place of the same text under one id."""
    return np.r_[False, (doc[1:] == doc[:-1]) & (place[1:] == place[:-1]) & (tag[1:] == tag[:-1])]


_RUN = "key long, form long, doc long, place long, tag long, copy boolean"


def _find(frames):
    """Runs of documents; of equal runs held at once all but the first are marked as copies."""
    held: list[list] = []
    rows = 0

    def flush():
        anchor, form, doc, place, tag = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((tag, place, doc, form, anchor))
        anchor, form, doc, place, tag = anchor[order], form[order], doc[order], place[order], tag[order]
        lead = np.r_[True, (anchor[1:] != anchor[:-1]) | (form[1:] != form[:-1])]
        head = np.flatnonzero(lead)[np.cumsum(lead) - 1]
        copy = (doc != doc[head]) | (place != place[head])
        same = ~lead & ~copy & _repeated_rows(doc, place, tag)  # of a repeated row one is enough
        anchor = np.where(copy, tb.mix(place.astype(_U) + doc.astype(_U)), anchor)  # copies are done: spread them
        keep = ~same
        for lo in range(0, int(keep.sum()), 100_000):
            part = [c[keep][lo:lo + 100_000] for c in (anchor.view(np.int64), form.view(np.int64), doc, place, tag, copy)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in part], ["key", "form", "doc", "place", "tag", "copy"])

    for batch, data, offsets in tb.batches(frames):
        anchor, form, row, start, count, behind = runs(data, offsets)
        doc = batch.column(0).to_numpy(zero_copy_only=False)[row].astype(np.int64)
        held.append([anchor, form, doc, _place(start, count, behind), text_tags(data, offsets)[row]])
        rows += len(row)
        if rows >= HELD_ROWS:
            yield from flush()
            held, rows = [], 0
    if rows:
        yield from flush()


_SPLIT = "kind int, key long, form long, doc long, place long, tag long"
COPY, FORM = 0, 1


def _split(frames):
    """Runs sorted by key, form and place: copies, and the first run of each form of keys with several.

    Different texts of one id, or without id, may hold a form at one place: each of them is first.
    """
    open_group: list = []  # parts of the last key, whose rows may go on in the next batch

    def emit(parts):
        key, form, doc, place, tag, copy = (np.concatenate(c) for c in zip(*parts))
        lead = np.r_[True, (key[1:] != key[:-1]) | (form[1:] != form[:-1])] & ~copy
        head = np.maximum.accumulate(np.where(lead, np.arange(len(key)), -1))
        again = copy | (~lead & ((doc != doc[head]) | (place != place[head])))
        group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
        forms = np.bincount(group, lead)
        several = ~again & (lead | ~_repeated_rows(doc, place, tag)) & (forms[group] > 1)
        pick = again | several
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.where(again[pick], COPY, FORM).astype(np.int32)), *(pa.array(c[pick]) for c in (key, form, doc, place, tag))],
            ["kind", "key", "form", "doc", "place", "tag"])

    for batch in frames:
        part = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
        if not len(part[0]):
            continue
        cut = int(np.searchsorted(part[0], part[0][-1]))  # where the last key begins
        if cut:
            yield from emit([*open_group, [c[:cut] for c in part]])
            open_group = []
        open_group.append([c[cut:] for c in part])
    if open_group:
        yield from emit(open_group)


def _packed(frames):
    """doc, tag, compressed text."""
    press = zstandard.ZstdCompressor(level=3)
    for batch, data, offsets in tb.batches(frames):
        tags = text_tags(data, offsets)
        packed = [press.compress(data[offsets[r]:offsets[r + 1]].tobytes()) for r in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tags), pa.array(packed, pa.binary())], ["doc", "tag", "packed"])


def _fetch(frames):
    """The bytes of asked runs; of split keys, each window with 128 bits of hash."""
    press = zstandard.ZstdDecompressor()
    for batch in frames:
        out: list[list] = [[] for _ in range(7)]
        docs, tags = batch.column("doc").to_pylist(), batch.column("tag").to_pylist()
        for r in range(batch.num_rows):
            text = press.decompress(batch.column("packed")[r].as_py())
            asked = batch.column("asked")[r].values
            for key, place, split in zip(asked.field("key").to_pylist(), asked.field("place").to_pylist(), asked.field("split").to_pylist()):
                start, count, _ = _unplace(place)
                pieces = [(start + k, 1) for k in range(count)] if split else [(start, count)]
                for begin, number in pieces:
                    bytes_ = text[begin:begin + number + LENGTH - 1]
                    digest = hashlib.blake2b(bytes_, digest_size=16).digest() if split else None
                    for column, value in zip(out, (key, docs[r], tags[r], begin, number, None if split else bytes_, digest)):
                        column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["key", "doc", "tag", "start", "n", "bytes", "digest"])


def repeated_windows(pieces: list[bytes], doc: np.ndarray, start: np.ndarray, bytewise: bool) -> tuple[np.ndarray, np.ndarray]:
    """Piece and offset of every window that an earlier one (smaller doc, start) equals.

    All pieces are suffix-sorted at once. A window is looked up by the first phrase that begins in
    it: equal windows have equal bytes before it and at least the rest of the window in common behind it.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    first = np.r_[0, np.cumsum(sizes)]
    piece_end = np.repeat(first[1:], sizes)
    last = np.ones(len(data), bool) if bytewise else _BREAK[data].copy()  # last byte of a phrase
    begins_after = last.copy()
    last[first[1:] - 1] = True
    ends = np.flatnonzero(last) + 1
    begins = np.r_[0, ends[:-1]]
    sums = _sums(data)
    hashes = _ranges(sums, begins, ends)
    _, where, back = np.unique(hashes, return_index=True, return_inverse=True)
    shown = [data[begins[k]:ends[k]].tobytes() for k in where]
    rank = np.empty(len(where), np.int64)
    rank[sorted(range(len(where)), key=shown.__getitem__)] = np.arange(len(where))
    # Ranks from 2, a 1 behind each piece, a 0 at the end.
    phrase_piece = np.searchsorted(first, begins, "right") - 1
    symbols = np.zeros(len(begins) + len(pieces) + 1, np.int64)
    at = np.arange(len(begins)) + phrase_piece
    symbols[at] = rank[back] + 2
    closing = np.ones(len(symbols) - 1, bool)
    closing[at] = False
    symbols[:-1][closing] = 1
    order = suffix_order(symbols)
    phrase = np.full(len(symbols), -1)
    phrase[at] = np.arange(len(begins))
    sorted_phrase = phrase[order]
    sorted_phrase = sorted_phrase[sorted_phrase >= 0]
    place = np.empty(len(begins), np.int64)
    place[sorted_phrase] = np.arange(len(begins))
    # Common bytes of neighbours in the order, up to a window, within their pieces.
    position = begins[sorted_phrase]
    room = np.minimum(piece_end[position] - position, LENGTH)
    padded = np.r_[data, np.zeros(LENGTH, np.uint8)]
    common = np.zeros(len(position), np.int64)
    for lo in range(1, len(position), 20_000):
        hi = min(lo + 20_000, len(position))
        reach = np.arange(LENGTH)
        differ = padded[position[lo:hi, None] + reach] != padded[position[lo - 1:hi - 1, None] + reach]
        same = np.where(differ.any(1), differ.argmax(1), LENGTH)
        common[lo:hi] = np.minimum(same, np.minimum(room[lo:hi], room[lo - 1:hi - 1]))
    # Windows: the first phrase that begins inside, as a matter of the window's own bytes.
    number = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(pieces)), number)
    offset = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
    window = first[owner] + offset
    breaks = np.flatnonzero(begins_after)
    inner = breaks[np.searchsorted(breaks, window)] + 1
    ahead = inner - window
    of_begin = np.searchsorted(begins, inner)
    found_piece, found_offset = [], []
    for p in np.unique(ahead):
        mine = np.flatnonzero(ahead == p)
        run = np.cumsum(common < LENGTH - p)
        group = run[place[of_begin[mine]]]
        left = _ranges(sums, window[mine], inner[mine])
        d, s = doc[owner[mine]], start[owner[mine]] + offset[mine]
        sort = np.lexsort((s, d, left, group))
        lead = np.r_[True, (group[sort][1:] != group[sort][:-1]) | (left[sort][1:] != left[sort][:-1])]
        head = np.flatnonzero(lead)[np.cumsum(lead) - 1]
        later = (d[sort] != d[sort][head]) | (s[sort] != s[sort][head])
        again = mine[sort[later]]
        found_piece.append(owner[again])
        found_offset.append(offset[again])
    return np.concatenate(found_piece), np.concatenate(found_offset)


def _phrases_short(piece: bytes) -> bool:
    return max(map(len, piece.replace(b"\n", b" ").split(b" "))) < LONGEST_PHRASE


def _sort_partition(frames):
    """Spans of a partition's repeated windows."""
    cols: list[list] = [[], [], [], [], []]
    for batch in frames:
        for column, name in zip(cols, ("key", "doc", "tag", "start", "bytes")):
            column.append(batch.column(name))
    key, doc, tag, start = (np.concatenate([c.to_numpy(zero_copy_only=False) for c in col]) if col else np.zeros(0, np.int64) for col in cols[:4])
    pieces = [b for c in cols[4] for b in c.to_pylist()]
    long_keys = {int(k) for k, p in zip(key, pieces) if not _phrases_short(p)}
    bytewise = np.array([int(k) in long_keys for k in key], bool)
    for mode in (False, True):
        mine = np.flatnonzero(bytewise == mode)
        if not len(mine):
            continue
        owner, offset = repeated_windows([pieces[k] for k in mine], doc[mine], start[mine], mode)
        order = np.lexsort((offset, owner))
        owner, offset = mine[owner[order]], offset[order]
        # Neighbouring windows of one piece are one span.
        lead = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)]) if len(owner) else np.zeros(0, np.int64)
        tail = np.r_[lead[1:], len(owner)] - 1 if len(owner) else lead
        o = owner[lead]
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[o]), pa.array(tag[o]), pa.array(start[o] + offset[lead]), pa.array(start[o] + offset[tail] + LENGTH)],
            ["doc", "tag", "begin", "end"])


def _result(frames):
    press = zstandard.ZstdDecompressor()
    for batch in frames:
        out: list[list] = [[] for _ in range(4)]
        for r in range(batch.num_rows):
            text = press.decompress(batch.column("packed")[r].as_py())
            spans = batch.column("spans")[r].values
            removed = number = at = 0
            digest = hashlib.sha256()
            if spans is not None and len(spans):
                begin, end = spans.field("begin").to_numpy(), spans.field("end").to_numpy()
                order = np.argsort(begin, kind="stable")
                begin, end = begin[order], np.maximum.accumulate(end[order])
                lead = np.flatnonzero(np.r_[True, begin[1:] > end[:-1]])
                for a, b in zip(begin[lead].tolist(), end[np.r_[lead[1:], len(end)] - 1].tolist()):
                    digest.update(text[at:a])
                    removed, number, at = removed + b - a, number + 1, b
            digest.update(text[at:])
            for column, value in zip(out, (len(text), removed, number, digest.hexdigest())):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array(c, k) for c, k in zip(out, kinds))], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


_SPAN = "doc long, tag long, begin long, end long"


def repeated_spans(docs: DataFrame, packed: DataFrame, forms: int = FORMS, sort_bytes: int = SORT_BYTES) -> DataFrame:
    """doc, tag, begin, end: byte spans, maybe overlapping, that cover every byte to be removed."""
    found = docs.mapInArrow(_find, _RUN)
    split = found.repartition("key").sortWithinPartitions("key", "form", "doc", "place", "tag").mapInArrow(_split, _SPLIT)
    split = written(split, "runs", partition_by="kind")
    start, count = F.shiftright("place", 14), F.shiftright("place", 7).bitwiseAND(127)
    copies = split.where(F.col("kind") == COPY).select("doc", "tag", start.alias("begin"), (start + count + LENGTH - 1).alias("end"))
    several = split.where(F.col("kind") == FORM)
    hot = several.groupBy("key").agg(F.count(F.lit(1)).alias("forms")).where(F.col("forms") > forms).select("key", F.lit(True).alias("split"))
    asked = several.join(hot, "key", "left").select("doc", "tag", F.struct("key", "place", F.coalesce("split", F.lit(False)).alias("split")).alias("ask"))
    asked = asked.groupBy("doc", "tag").agg(F.collect_list("ask").alias("asked"))  # bounded by the document's own length
    texts = packed.join(asked, ["doc", "tag"]).select("doc", "tag", "packed", "asked")
    pieces = written(texts.mapInArrow(_fetch, "key long, doc long, tag long, start long, n long, bytes binary, digest binary"), "pieces")
    total = pieces.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    sort = pieces.where("bytes is not null").select("key", "doc", "tag", "start", "bytes")
    sort = sort.repartition(max(1, -(-total // sort_bytes)), "key").sortWithinPartitions("key", "doc", "start", "tag")
    sorted_ = sort.mapInArrow(_sort_partition, _SPAN)
    # Windows of split anchors: equal ones share a digest; the first stays.
    windows = pieces.where("digest is not null").select("digest", "doc", "tag", "start")
    least = windows.groupBy("digest").agg(F.min(F.struct("doc", "start")).alias("least"))
    later = windows.join(least, "digest").where(~((F.col("doc") == F.col("least.doc")) & (F.col("start") == F.col("least.start"))))
    later = later.select("doc", "tag", F.col("start").alias("begin"), (F.col("start") + LENGTH).alias("end"))
    return copies.unionByName(sorted_).unionByName(later)


def repeat_report(docs: DataFrame, forms: int = FORMS, sort_bytes: int = SORT_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")
    packed = docs.mapInArrow(_packed, "doc long, tag long, packed binary")
    spans = repeated_spans(docs, packed, forms, sort_bytes)
    spans = spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    joined = packed.join(spans, ["doc", "tag"], "left").select("doc", "packed", "spans")
    out = joined.mapInArrow(_result, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
