"""Merkle manifest of a dataset, with every row's proof by octopus multiproofs.

Each row is a leaf. The leaves of a group (a source) ascend by id and are hashed three at a time, level by
level, to the group's subroot; the subroots, in the order of their groups, are hashed likewise to the root.
A proof of a leaf is the list of its siblings on the way to the root.

No task sees a whole tree. Leaves are ranked by a range partitioning and dealt into *leaf partitions* of
consecutive ranks, which may hold the end of one group and the beginning of the next. A leaf partition

1. publishes its frontier: the nodes it can derive whose parents need leaves of another partition;
2. asks for the minimal union of missing coordinates (level, place) that its leaves' proofs need together,
   which for neighbours is a few nodes on either side, and fetches each once;
3. derives the interiors that its proofs share from its leaves and what it fetched, and expands the proof of
   each leaf locally.

Nodes above the frontiers are derived in aligned subtrees of seven levels, so a tree of n leaves takes
log3(n) / 7 rounds over few rows.

Defined results: a NULL field is hashed as ``-``; rows of one id are ordered by their leaves (rows equal in
every field are interchangeable); rows without id come first in their group and are never tampered with; a
NULL group is a group of its own, the first; an empty table gives an empty result; texts are hashed whole;
columns that are not fields are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gatewise.session import written

ARITY = 3
#: Levels derived by one task above the frontiers, and leaves of a leaf partition.
LEVELS = 7
LEAVES = ARITY**LEVELS
#: The tree over the subroots; trees of groups are numbered from 0.
TOP = -1

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: Sequence[str]) -> str:
    """Lowercase hex SHA-256 of the parts, concatenated."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for NULL, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def counts(n: int) -> list[int]:
    """Nodes per level of a tree of ``n`` leaves, up to its root."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


def missing(lo: int, hi: int, n: int) -> list[tuple[int, int]]:
    """The least set of nodes (level, place) that proofs of the leaves ``lo`` to ``hi - 1`` of ``n`` need besides those leaves.

    On each level, what completes the first and the last run; all between follows from below.
    """
    out = []
    for level, width in enumerate(counts(n)[:-1]):
        first, last = lo - lo % ARITY, min(hi + -hi % ARITY, width)
        out += [(level, k) for k in (*range(first, lo), *range(hi, last))]
        lo, hi = lo // ARITY, (hi - 1) // ARITY + 1
    return out


def frontier(lo: int, hi: int, n: int) -> Iterator[tuple[int, int]]:
    """Nodes derivable from the leaves ``lo`` to ``hi - 1`` alone whose parents are not, and the root if it is."""
    sizes = counts(n)
    for level, width in enumerate(sizes):
        if level == len(sizes) - 1:
            yield from ((level, k) for k in range(lo, hi))
            return
        up_lo = -(-lo // ARITY)
        up_hi = sizes[level + 1] if hi == width else hi // ARITY
        yield from ((level, k) for k in range(lo, hi) if not up_lo <= k // ARITY < up_hi)
        if up_lo >= up_hi:
            return
        lo, hi = up_lo, up_hi


def derive(nodes: dict[tuple[int, int], str], n: int, upto: int | None = None) -> dict[tuple[int, int], str]:
    """Adds every node that follows from ``nodes``, up to level ``upto``; returns those added."""
    sizes, added = counts(n), {}
    top = len(sizes) - 1 if upto is None else min(upto, len(sizes) - 1)
    places: dict[int, set[int]] = {}
    for level, k in nodes:
        places.setdefault(level, set()).add(k)
    for level in range(top):
        for parent in sorted({k // ARITY for k in places.get(level, ())}):
            run = [nodes.get((level, k)) for k in range(parent * ARITY, min((parent + 1) * ARITY, sizes[level]))]
            if (level + 1, parent) not in nodes and None not in run:
                added[level + 1, parent] = nodes[level + 1, parent] = digest(run)
                places.setdefault(level + 1, set()).add(parent)
    return added


def path(nodes: dict[tuple[int, int], str], place: int, n: int) -> list[tuple[list[str], list[str]]]:
    """Siblings to the left and to the right, level by level, from leaf ``place`` to the root."""
    out = []
    for level, width in enumerate(counts(n)[:-1]):
        first = place - place % ARITY
        out.append(([nodes[level, k] for k in range(first, place)],
                    [nodes[level, k] for k in range(place + 1, min(first + ARITY, width))]))
        place //= ARITY
    return out


def fold(leaf: str, siblings: Sequence[tuple[list[str], list[str]]]) -> str:
    """The root that a leaf and its siblings lead to."""
    for left, right in siblings:
        leaf = digest([*left, leaf, *right])
    return leaf


# ---- Spark -----------------------------------------------------------------------------------------------


def ranked(df: DataFrame, label: str, *keys: str) -> DataFrame:
    """``df`` with ``_rank``, the place of each row by ``keys`` from 0, without a task that sees all rows.

    Range partitions are sorted and numbered inside and written, so that the numbers hold; where each begins follows from
    one count per partition.
    """
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    table = written(ordered, label)
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = table.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows")).collect()  # a row per range partition
    begins, total = [], 0
    for r in sorted(sizes, key=lambda r: r._part):
        begins.append((int(r._part), total))
        total += r._rows
    starts = df.sparkSession.createDataFrame(begins, "_part long, _begin long")
    placed = table.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return placed.withColumn("_rank", F.col("_begin") + row).drop("_part", "_begin", "_at")


_NODE = "tree long, n long, level int, place long, digest string"
_SAID = f"part long, asked boolean, {_NODE}"


def _publish(leaves: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Frontier nodes of one leaf partition, and the coordinates it asks for."""
    part, rows = int(groups["part"].iloc[0]), []
    lows, highs = [], []
    digests = leaves.sort_values("rank")["leaf"].tolist()
    base = int(leaves["rank"].min())
    for g in groups.itertuples():
        lo, hi = max(base - g.begin, 0), min(base + len(digests) - g.begin, g.n)
        nodes = {(0, k): digests[k + g.begin - base] for k in range(lo, hi)}
        derive(nodes, g.n)
        rows += [(part, False, g.tree, g.n, level, k, nodes[level, k]) for level, k in frontier(lo, hi, g.n)]
        rows += [(part, True, g.tree, g.n, level, k, None) for level, k in missing(lo, hi, g.n)]
        lows.append(g.tree), highs.append(g.tree + 1)
    trees = int(groups["trees"].iloc[0])
    rows += [(part, True, TOP, trees, level, k, None) for level, k in missing(min(lows), max(highs), trees)]
    return pd.DataFrame(rows, columns=["part", "asked", "tree", "n", "level", "place", "digest"])


def _complete(upto: int):
    """A function deriving the nodes of one aligned subtree up to level ``upto``."""
    def work(nodes: pd.DataFrame) -> pd.DataFrame:
        tree, n = int(nodes["tree"].iloc[0]), int(nodes["n"].iloc[0])
        known = {(int(r.level), int(r.place)): r.digest for r in nodes.itertuples()}
        rows = [(tree, n, level, k, d) for (level, k), d in derive(known, n, upto).items()]
        return pd.DataFrame(rows, columns=["tree", "n", "level", "place", "digest"])

    return work


def _completed(nodes: DataFrame, label: str) -> DataFrame:
    """All nodes of trees whose leaves are covered by ``nodes``, a written table."""
    largest = nodes.agg(F.max("n")).first()[0] or 0
    height, upto, tables = len(counts(largest)) - 1, LEVELS, [nodes]
    while upto - LEVELS < height:
        known = reduce(DataFrame.unionByName, tables)
        below = known.where(F.col("level").between(upto - LEVELS, upto - 1))
        # the place of the ancestor on level ``upto``
        widths = ", ".join(str(ARITY ** (LEVELS - k)) for k in range(LEVELS))
        subtree = F.expr(f"place div element_at(array({widths}), level - {upto - LEVELS} + 1)")
        work = below.groupBy("tree", subtree.alias("subtree")).applyInPandas(_complete(upto), _NODE)
        tables.append(written(work, label))
        upto += LEVELS
    return reduce(DataFrame.unionByName, tables)


_PROOF = "doc_id {id}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _expand(leaves: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    """Proofs of one leaf partition from its leaves, its groups and the nodes it fetched."""
    groups, fetched = told[told["begin"].notna()], told[told["begin"].isna()]
    by_tree: dict[int, dict[tuple[int, int], str]] = {}
    for r in fetched.itertuples():
        by_tree.setdefault(int(r.tree), {})[int(r.level), int(r.place)] = r.digest
    leaves = leaves.sort_values("rank")
    base, digests = int(leaves["rank"].min()), leaves["leaf"].tolist()
    top, trees, known = by_tree.get(TOP, {}), int(groups["trees"].iloc[0]), []
    for g in groups.itertuples():
        tree, begin, n = int(g.tree), int(g.begin), int(g.n)
        lo, hi = max(base - begin, 0), min(base + len(digests) - begin, n)
        nodes = by_tree.get(tree, {})
        nodes.update({(0, k): digests[k + begin - base] for k in range(lo, hi)})
        derive(nodes, n)
        subroot = nodes[len(counts(n)) - 1, 0]
        top[0, tree] = subroot
        known.append((tree, begin, n, lo, hi, nodes, subroot))
    derive(top, trees)
    root = top[len(counts(trees)) - 1, 0]
    shown = leaves["shown"].tolist()
    subroots, proofs, folded = [""] * len(digests), [""] * len(digests), [""] * len(digests)
    for tree, begin, n, lo, hi, nodes, subroot in known:
        above = path(top, tree, trees)
        for k in range(lo, hi):
            at = k + begin - base
            siblings = path(nodes, k, n) + above
            subroots[at] = subroot
            proofs[at] = digest([d for left, right in siblings for d in (*left, *right)])
            folded[at] = fold(shown[at], siblings)
    out = pd.DataFrame({"doc_id": leaves["id"].to_numpy(), "leaf": digests, "subroot": subroots})
    return out.assign(root=root, proof_sha256=proofs, folded_root=folded, verified=[f == root for f in folded])


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "source", row_id: str = "doc_id",
             shown: Sequence[Column] | None = None) -> DataFrame:
    """Leaf, subroot, root and proof of every row; ``folded_root`` is what the proof makes of the leaf of the ``shown``
    fields (the row's own unless given), ``verified`` whether that is the root."""
    own = [F.col(f) for f in fields]
    leaves = docs.select(
        F.col(row_id).alias("id"), F.col(group).alias("grp"), leaf_digest(own).alias("leaf"),
        leaf_digest(shown or own).alias("shown"), F.monotonically_increasing_id().alias("tie"))
    # Texts are read once; from here on a row is two digests.
    leaves = ranked(written(leaves, "merkle-leaves"), "merkle-ranked", "grp", "id", "leaf", "tie")
    leaves = leaves.select(
        F.expr(f"_rank div {LEAVES}").alias("part"), F.col("_rank").alias("rank"), "grp",
        # Arrow would hand a long id with NULLs to pandas as a float
        F.col("id").cast("string").alias("id"), "leaf", "shown")
    held = written(leaves.groupBy("part", "grp").agg(F.min("rank").alias("low"), F.count(F.lit(1)).alias("rows")), "merkle-held")
    groups = held.groupBy("grp").agg(F.min("low").alias("begin"), F.sum("rows").alias("n"))
    groups = ranked(groups, "merkle-groups", "begin").withColumnRenamed("_rank", "tree").select(
        F.col("grp").alias("_grp"), "begin", "n", "tree")
    trees = groups.count()
    context = held.join(groups, F.col("grp").eqNullSafe(F.col("_grp"))).select(
        "part", "tree", "begin", "n", F.lit(trees).cast("long").alias("trees"))
    context = written(context, "merkle-context")
    leaves = leaves.drop("grp")
    said = written(leaves.groupBy("part").cogroup(context.groupBy("part")).applyInPandas(_publish, _SAID), "merkle-frontiers")
    nodes = _completed(said.where("not asked").drop("part", "asked"), "merkle-nodes")
    height = F.size(F.filter(F.array(*[F.lit(ARITY**k) for k in range(39)]), lambda leaves: leaves < F.col("n")))
    subroots = nodes.where((F.col("place") == 0) & (F.col("level") == height)).select(
        F.lit(TOP).cast("long").alias("tree"), F.lit(trees).cast("long").alias("n"), F.lit(0).alias("level"),
        F.col("tree").alias("place"), "digest")
    everything = nodes.unionByName(_completed(written(subroots, "merkle-subroots"), "merkle-top"))
    asked = said.where("asked").select("part", "tree", "level", "place")
    fetched = asked.join(everything.drop("n"), ["tree", "level", "place"])
    told = context.unionByName(fetched, allowMissingColumns=True)
    id_type = docs.schema[row_id].dataType.simpleString()
    proofs = leaves.groupBy("part").cogroup(told.groupBy("part")).applyInPandas(_expand, _PROOF.format(id="string"))
    return proofs.withColumn("doc_id", F.col("doc_id").cast(id_type))


def without_newlines(doc_id: str = "doc_id", text: str = "text", fields: Sequence[str] = FIELDS) -> list[Column]:
    """The fields as tampering leaves them: every second row, by the CRC-32 of its id, loses the newlines of its text."""
    even = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 2 == 0
    cut = F.when(F.coalesce(even, F.lit(False)), F.translate(text, "\n", "")).otherwise(F.col(text))
    return [cut if f == text else F.col(f) for f in fields]


def manifest_report(docs: DataFrame) -> DataFrame:
    return manifest(docs, shown=without_newlines())
