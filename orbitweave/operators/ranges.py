"""Long ordered series in many tasks: rows are cut into ranges of equal counts, each range is one
window, and what crosses its edge (a running count, the last or next record) comes from a small table
with a row for each range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitweave.storage import written

#: Rows of a range, about.
RANGE_ROWS = 1_000_000


def ranged(rows: DataFrame, by: Sequence[str], order: Sequence[str], spread: str | None = None, range_rows: int | None = None) -> DataFrame:
    """rows, written, with _range: ranges ascend with order inside each group of by. Rows equal in order may
    stand in two ranges only if spread names a column that tells them apart; by default they meet in one."""
    count = rows.count()
    n = 1 + count // (range_rows or RANGE_ROWS)
    if n == 1:
        return rows.withColumn("_range", F.lit(0))
    keys = [*by, *order, *([spread] if spread else [])]
    return written(rows.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id()), "ranges")


def numbered(rows: DataFrame, order: Sequence[str], by: Sequence[str] = (), into: str = "number", range_rows: int | None = None) -> DataFrame:
    """rows with numbers from 1 in order inside each group of by; order must tell rows of a group apart
    for the numbers to be the same in every run."""
    cut = ranged(rows, by, order[:-1], order[-1], range_rows) if len(order) > 1 else ranged(rows, by, (), order[0], range_rows)
    counts = cut.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_range").orderBy(*order)
    placed = cut.withColumn(into, F.row_number().over(inside))
    joined = placed.join(starts.select(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(by)), F.col("_range").alias("_r"), "_start"), _same(by), "inner")
    return joined.withColumn(into, (F.col(into) + F.col("_start")).cast("long")).select(*rows.columns, into)


def _same(by: Sequence[str]) -> Column:
    on = F.col("_range") == F.col("_r")
    for k, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    return on


def carried(cut: DataFrame, by: str, order: Sequence[Column | str], value: str) -> DataFrame:
    """cut (with _range) with _before and _after: the last value that is not null at or before each row,
    and the first at or after it, over all ranges of its group. Edges of ranges are one row each. What follows is
    what precedes in the reverse order: a frame that ends with the group would be gone through anew by each row."""
    back = lambda c: (F.col(c) if isinstance(c, str) else c).desc_nulls_last()
    so_far = lambda *o: Window.partitionBy(by, "_range").orderBy(*o).rowsBetween(Window.unboundedPreceding, 0)
    rows = cut.withColumns({
        "_before": F.last(value, ignorenulls=True).over(so_far(*order)),
        "_after": F.last(value, ignorenulls=True).over(so_far(*map(back, order)))})
    # the ends of a range are its extreme values; the ranges of a group are as many as its rows allow
    ends = cut.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("_b"), F.col("_range").alias("_r")).agg(F.min(value).alias("_first"), F.max(value).alias("_last"))
    every = cut.select(F.col(by).alias("_b"), F.col("_range").alias("_r")).distinct().join(ends, ["_b", "_r"], "left")
    across = lambda o: Window.partitionBy("_b").orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
    every = every.select(
        "_b", "_r", F.last("_last", ignorenulls=True).over(across(F.asc("_r"))).alias("_from"),
        F.last("_first", ignorenulls=True).over(across(F.desc("_r"))).alias("_to"))
    joined = rows.join(every, F.col(by).eqNullSafe(F.col("_b")) & (F.col("_range") == F.col("_r")))
    return joined.withColumns({"_before": F.coalesce("_before", "_from"), "_after": F.coalesce("_after", "_to")}).drop("_b", "_r", "_from", "_to")
