"""Running aggregates per key when one key may hold any share of the rows.

Keys above a row limit get their timeline cut into slots of about equal row counts, at quantiles of a mergeable
sketch, so a burst inside one second is cut as well as a quiet year. Windows run inside (key, slot); what the
slots before a row's own contribute is added from a small table of slot totals. Rows of one key and one time
see the same past and stay together.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Slots of a key at most; a key of more than so many times the row limit gets longer slots.
MOST_SLOTS = 512


def even_cuts(rows: DataFrame, key: str, at: str, slot_rows: int, max_heavy_share: float = 1 / 50_000) -> DataFrame:
    """Keys above ``slot_rows`` and the ascending times at which their second and later slots begin: (key, cuts).

    Only keys that also hold ``max_heavy_share`` of all rows are cut, so there are at most ``1 / max_heavy_share`` of them,
    and as many cuts again at most, whatever the size of the data.
    """
    timed = rows.where(F.col(at).isNotNull() & F.col(key).isNotNull())
    total = timed.agg(F.count(F.lit(1)).alias("n"))
    limit = F.greatest(F.lit(float(slot_rows)), total.scalar() * F.lit(max_heavy_share))
    marks = [k / MOST_SLOTS for k in range(1, MOST_SLOTS)]
    heavy = timed.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    heavy = heavy.select(F.col(key).alias("_cut_key"), F.least(F.ceil(F.col("_n") / limit), F.lit(MOST_SLOTS)).alias("_slots"))
    own = timed.select(key, at).join(F.broadcast(heavy), F.col(key) == F.col("_cut_key"))
    sized = own.groupBy(key, "_slots").agg(F.percentile_approx(at, marks).alias("_marks"))
    # the quantiles nearest below each even share
    share = lambda i: F.floor(i * F.col("_slots") / MOST_SLOTS)
    chosen = F.filter("_marks", lambda mark, i: share(i + 1) > share(i))
    return sized.select(key, F.array_sort(F.array_distinct(chosen)).alias("cuts"))


def slotted(rows: DataFrame, cuts: DataFrame | None, key: str, at: str, slot: str = "_slot") -> DataFrame:
    """``rows`` with the number of the slot each lies in; NULL for keys that are not cut, and for all without ``cuts``."""
    if cuts is None:
        return rows.withColumn(slot, F.lit(None).cast("int"))
    marks = cuts.select(F.col(key).alias("_cut_key"), "cuts")
    joined = rows.join(F.broadcast(marks), F.col(key) == F.col("_cut_key"), "left")
    # binary search: a row looks at ten of its key's cuts, not at all of them
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(MOST_SLOTS.bit_length()))])
    number = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get("cuts", n + step - 1) <= F.col(at), n + step).otherwise(n))
    return joined.withColumn(slot, F.when(F.col("cuts").isNotNull(), number)).drop("_cut_key", "cuts")


def running_before(
    rows: DataFrame, keys: Sequence[str], at: str, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None,
    slot: str = "_slot", cut: bool = True,
) -> DataFrame:
    """``rows`` with sums and maxima over the strictly earlier rows of the same keys; NULL where there are none.

    ``cut``: whether any key may lie in more than one slot.
    """
    sums, maxima = sums or {}, maxima or {}
    inside = W.partitionBy(*keys, slot).orderBy(at).rangeBetween(W.unboundedPreceding, -1)
    out = rows.withColumns(
        {n: F.sum(c).over(inside) for n, c in sums.items()} | {n: F.max(c).over(inside) for n, c in maxima.items()})
    if not cut:
        return out
    # one row per slot of keys that are cut, combined before the shuffle
    made = [F.sum(c).alias(n) for n, c in sums.items()] + [F.max(c).alias(n) for n, c in maxima.items()]
    totals = rows.where(F.col(slot).isNotNull()).groupBy(*keys, slot).agg(*made)
    earlier = W.partitionBy(*keys).orderBy(slot).rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        *[F.col(k).alias(f"_c_{k}") for k in (*keys, slot)],
        *[F.sum(n).over(earlier).alias(f"_c_{n}") for n in sums], *[F.max(n).over(earlier).alias(f"_c_{n}") for n in maxima])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in (*keys, slot)])
    joined = out.join(F.broadcast(carried), same, "left")
    both = {n: F.coalesce(F.col(n) + F.col(f"_c_{n}"), n, f"_c_{n}") for n in sums} | {n: F.greatest(n, f"_c_{n}") for n in maxima}
    return joined.withColumns(both).drop(*[f"_c_{k}" for k in (*keys, slot, *sums, *maxima)])
