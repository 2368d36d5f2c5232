"""N-gram Jaccard join with rare-first prefix filtering.

A document is the set of its shingles of ``width`` words, as 64-bit hashes. Documents of equal sets are one
class, stood for by the least id. Shingles are ordered by how often they occur in all documents, rarest
first; the counts are kept in a table of hashed cells of fixed size (equal counts fall back to the
hash, any total order is a right one). Two sets with a Jaccard share of ``percent`` agree in one of the first
n - ceil(n percent / 100) + 1 shingles of each, so only these prefixes are joined. A candidate pair must pass

* the length filter, the smaller set has at least ``percent`` of the larger one's size,
* the positional filter, what may still follow after the matching place is enough,
* the suffix filter, a histogram of both sets over ranges of the hash bounds the overlap,

and is then verified once on the whole sets. In a group of many documents around one prefix shingle a
pair is compared only if the two are not yet known to be connected; see :func:`class_components`.

Defined results: NULL and wordless texts have no shingles and link with nothing; a text of fewer than
``width`` words has one shingle; repeated rows link with their copies; a row without id gives its copies no id and
has no component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from gatewise.llm import textbytes as tb
from gatewise.llm.components import components
from gatewise.session import written

#: Words of a shingle and the least Jaccard share of a link, unless a caller asks for others.
WIDTH = 3
PERCENT = 90
CELL_BITS = 18
SUFFIX_RANGES = 32


def required(n, percent: int = PERCENT):
    """The least overlap with any set that a set of ``n`` may link with: ceil(n percent / 100)."""
    return -(-n * percent // 100)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of every row."""
    starts, ends, rows = tb.word_spans(data, offsets, tb.NOT_SPACE)
    hashes = tb.word_hashes(data, starts, ends, tb.LOWER)
    found, row, _ = tb.shingle_hashes(hashes, rows, width, short=True)
    order = np.lexsort((found, row))
    found, row = found[order], row[order]
    if len(found):
        new = np.r_[True, (found[1:] != found[:-1]) | (row[1:] != row[:-1])]
        found, row = found[new], row[new]
    return np.split(found, np.searchsorted(row, np.arange(1, len(offsets) - 1)))


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def set_id(own: np.ndarray) -> int:
    """A 64-bit digest of a set, for its class; empty sets have none."""
    return int(np.bitwise_xor.reduce(tb.mix(own ^ np.uint64(0x5DEECE66D1234567))).astype(np.int64) + len(own))


def _survey(width: int):
    """Per document its set's size and id; per hashed cell its occurrences. Told apart by the second column."""
    def task(frames):
        total = np.zeros(1 << CELL_BITS, np.int64)
        names = ["doc_id", "cell", "n", "cls"]
        for batch, data, offsets in tb.batches(frames):
            sets = shingle_sets(data, offsets, width)
            total += np.bincount(_cells(np.concatenate(sets)), minlength=len(total))
            none = pa.nulls(len(sets), pa.int64())
            ids = [set_id(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), none, pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.int64())], names)
        seen = np.flatnonzero(total)
        none = pa.nulls(len(seen), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(seen, pa.int64()), pa.array(total[seen]), none], names)
    return task


def survey(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, np.ndarray]:
    """doc_id, n, cls of every document, and occurrences by hashed cell, a table of fixed size (2 MB)."""
    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_survey(width), "doc_id long, cell long, n long, cls long")
    found = written(found, "sets")
    counts = np.zeros(1 << CELL_BITS, np.int64)
    rows = found.where("cell is not null").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts[rows["cell"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return found.where("cell is null").select("doc_id", "n", "cls"), counts


def _prefixes(shared, width: int, percent: int):
    def task(frames):
        counts, seen = shared.value, set()
        for _, data, offsets in tb.batches(frames):
            out: list[list] = [[], [], [], []]
            for own in shingle_sets(data, offsets, width):
                n = len(own)
                if n == 0 or (cls := set_id(own)) in seen:  # copies are combined before the shuffle
                    continue
                seen.add(cls)
                length = n - required(n, percent) + 1
                out[0].append(own[np.lexsort((own, counts[_cells(own)]))[:length]].astype(np.int64))
                out[1].append(np.full(length, cls))
                out[2].append(np.full(length, n))
                out[3].append(np.arange(length))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], ["token", "cls", "n", "place"])
    return task


def _pack_texts(width: int):
    def task(frames):
        press, seen = zstandard.ZstdCompressor(level=3), set()
        for _, data, offsets in tb.batches(frames):
            ids, packed = [], []
            for r, own in enumerate(shingle_sets(data, offsets, width)):
                if len(own) and (cls := set_id(own)) not in seen:
                    seen.add(cls)
                    ids.append(cls)
                    packed.append(press.compress(data[offsets[r]:offsets[r + 1]].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], ["cls", "packed"])
    return task


def _histogram(own: np.ndarray) -> np.ndarray:
    return np.bincount((own >> np.uint64(59)).astype(np.int64), minlength=SUFFIX_RANGES)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """100 * overlap >= percent * union, after the suffix filter's bound."""
    n = len(a) + len(b)
    # 100 i >= percent (n - i)  <=>  (100 + percent) i >= percent n
    if (100 + percent) * int(np.minimum(_histogram(a), _histogram(b)).sum()) < percent * n:
        return False
    return (100 + percent) * len(np.intersect1d(a, b, assume_unique=True)) >= percent * n


def _verify(width: int, percent: int):
    def task(frames):
        press = zstandard.ZstdDecompressor()
        kept: list[tuple] = [(None, None), (None, None)]  # the last set of either side

        def own(side: int, packed: bytes) -> np.ndarray:
            if packed != kept[side][0]:
                text = press.decompress(packed)
                kept[side] = packed, shingle_sets(np.frombuffer(text, np.uint8), np.array([0, len(text)]), width)[0]
            return kept[side][1]

        for batch in frames:
            left, right = batch.column(2), batch.column(3)
            good = [linked(own(0, left[k].as_py()), own(1, right[k].as_py()), percent) for k in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
    return task


def verified(pairs: DataFrame, texts: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of classes that link."""
    left = texts.select(F.col("cls").alias("a"), F.col("packed").alias("left"))
    right = texts.select(F.col("cls").alias("b"), F.col("packed").alias("right"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return joined.mapInArrow(_verify(width, percent), "a long, b long")


def _may_link(x: str, y: str, percent: int):
    """Length and positional filter for two prefix rows of one token."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    follows = F.least(n - F.col(f"{x}.place"), m - F.col(f"{y}.place"))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * follows >= percent * (n + m))


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.least(f"{x}.cls", f"{y}.cls").alias("a"), F.greatest(f"{x}.cls", f"{y}.cls").alias("b")).distinct()


def star_candidates(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs of each prefix row with the hub of its token.

    The hub is the class that meets most others over all its prefix tokens: what copies were made from
    shares its tokens with all of them, while each copy's own changes are shared with none.
    """
    meets = rows.groupBy("cls").agg(F.sum("many").alias("meets"))
    rows = rows.join(meets, "cls")
    hubs = rows.groupBy("token").agg(F.max(F.struct("meets", "cls", "n", "place")).alias("h"))
    met = rows.alias("r").join(hubs, "token").where((F.col("r.cls") != F.col("h.cls")) & _may_link("r", "h", percent))
    return _ordered(met, "r", "h")


def cross_candidates(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """All remaining pairs of one token: between different components only."""
    mixed = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    live = rows.join(mixed, "token", "left_semi")
    x, y = live.alias("x"), live.alias("y")
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.comp") != F.col("y.comp")) & _may_link("x", "y", percent))
    return _ordered(met, "x", "y")


def class_components(docs: DataFrame, counts: np.ndarray, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """cls and comp for classes that are not the least of their component.

    Documents around one prefix shingle are mostly copies of each other. They are linked through hubs
    first; pairs then left are those between components, each compared once.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(counts)
    prefix = docs.select("text").mapInArrow(_prefixes(shared, width, percent), "token long, cls long, n long, place long")
    prefix = prefix.repartition("token").groupBy("token", "cls").agg(F.min("n").alias("n"), F.min("place").alias("place"))
    prefix = written(prefix.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("many > 1"), "prefix")
    involved = prefix.select("cls").distinct()
    texts = docs.select("text").mapInArrow(_pack_texts(width), "cls long, packed binary").join(involved, "cls", "left_semi")
    texts = written(texts.groupBy("cls").agg(F.first("packed").alias("packed")), "texts")
    stars = written(star_candidates(prefix, percent), "pairs")
    links = written(verified(stars, texts, width, percent), "links")
    named = components(links).select(F.col("id").alias("cls"), F.col("component").alias("comp"))
    rows = prefix.drop("many").join(named, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    crossing = cross_candidates(written(rows, "rows"), percent).join(stars, ["a", "b"], "left_anti")
    more = written(verified(crossing, texts, width, percent), "links")
    return components(links.unionByName(more)).select(F.col("id").alias("cls"), F.col("component").alias("comp"))


def near_copies(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    sets, counts = survey(docs, width)
    comps = class_components(docs, counts, width, percent)
    # Copies share a class: the least id per class first, then per component, then back.
    classes = sets.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
    classes = classes.join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = classes.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = written(classes.join(least, "comp").select("cls", "component_id"), "classes")
    out = sets.join(named, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document, the least id, of each component; all columns are kept.

    Rows without id stay; rows of one id stay or go together.
    """
    gone = near_copies(docs, width, percent).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
