"""Running totals over an order of any length, in two passes instead of one window over all rows.

Rows are dealt into ranges of the order and written, which fixes the ranges; totals run inside each range, and what the
ranges before it hold is added from one row per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gatewise.session import written


def running_totals(rows: DataFrame, by: Sequence[str], order: Sequence[Column], sums: dict[str, str], own: bool = True) -> DataFrame:
    """``rows`` plus, per entry of ``sums``, the sum of its column over the rows of the same ``by`` up to each row.

    ``own``: whether a row counts for itself. ``order`` must tell the rows of one ``by`` apart. No task holds more than
    a range of the order; the ranges' totals are a row per range and value of ``by``.
    """
    c = F.col
    dealt = rows.repartitionByRange(*[c(b) for b in by], *order).withColumn("_range", F.spark_partition_id())
    table = written(dealt, "ranges")
    inside = W.partitionBy(*by, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if own else -1)
    local = table.withColumns({n: F.coalesce(F.sum(col).over(inside), F.lit(0)) for n, col in sums.items()})
    totals = table.groupBy(*by, "_range").agg(*[F.sum(col).alias(f"_t_{n}") for n, col in sums.items()])
    earlier = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(
        *[c(b).alias(f"_b_{b}") for b in by], c("_range").alias("_of"),
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_e_{n}") for n in sums])
    same = c("_range") == c("_of")
    for b in by:
        same &= c(b).eqNullSafe(c(f"_b_{b}"))
    joined = local.join(before, same)
    return joined.select(*rows.columns, *[(c(n) + c(f"_e_{n}")).alias(n) for n in sums])
