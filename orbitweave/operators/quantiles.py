"""Exact quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitweave.storage import written

#: Groups up to this size are sorted as they are; the rest goes by bins, so many in each round.
WHOLE, BINS = 100_000, 4096
#: Rows of a table that goes to all executors at most.
BROADCAST_ROWS = 10_000


def beside(rows: DataFrame, table: DataFrame, by: str) -> DataFrame:
    """rows joined with a written table of few rows for each by: broadcast while it is short, so that a hot
    group's rows stay where they are, else by a merge join, which splits them."""
    return rows.join(F.broadcast(table) if table.count() <= BROADCAST_ROWS else table.hint("merge"), by)


def quantiles(rows: DataFrame, by: str, value: Column, shares: Sequence[float]) -> DataFrame:
    """(by, n, q): the number of values that are numbers and their quantiles by linear interpolation. The two
    neighbours of each quantile of a large group are closed in by counts of equal bins between bounds,
    which then become those of the bin that holds the rank; each round leaves one bin in BINS or
    equal values only. No group is held or sorted in one task."""
    rows = rows.select(by, value.cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    sizes = written(rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "sizes")
    large = sizes.where(F.col("n") > WHOLE)
    if large.isEmpty():
        return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.percentile("_v", [float(p) for p in shares]).alias("q"))
    small = beside(rows, written(sizes.where(F.col("n") <= WHOLE).select(by), "small"), by)
    out = small.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.percentile("_v", [float(p) for p in shares]).alias("q"))
    place = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("p")) for k, p in enumerate(shares))))
    wanted = large.select(by, "n", "_lo", "_hi", place.alias("_s")).withColumn("_at", F.col("_s")["p"] * (F.col("n") - 1))
    ranks = F.array(F.floor("_at"), F.ceil("_at"))
    todo = written(wanted.select(by, F.explode(ranks).alias("rank"), "_lo", "_hi").distinct().withColumn("_skip", F.col("rank")), "ranks")
    found = todo.where("_lo = _hi").select(by, "rank", F.col("_lo").alias("_v"))
    todo = todo.where("_lo < _hi")
    while not todo.isEmpty():
        inside = beside(rows, todo, by).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        bin_ = F.least(F.lit(BINS - 1), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BINS))
        counts = inside.groupBy(by, "rank", "_skip", bin_.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.sum("_c").over(Window.partitionBy(by, "rank").orderBy("_bin"))
        hit = counts.withColumn("_upto", upto).where((F.col("_upto") > F.col("_skip")) & (F.col("_upto") - F.col("_c") <= F.col("_skip")))
        step = written(hit.select(by, "rank", "_lo", "_hi", (F.col("_skip") - F.col("_upto") + F.col("_c")).alias("_skip")), "ranks")
        found = found.unionByName(step.where("_lo = _hi").select(by, "rank", F.col("_lo").alias("_v")))
        todo = step.where("_lo < _hi")
    values = found.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "_v"))).alias("_m"))  # 2 x len(shares) at most
    joined = large.select(by, "n").join(values, by)

    def at(p: float) -> Column:
        x = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.element_at("_m", F.floor(x)), F.element_at("_m", F.ceil(x))
        return lo + (hi - lo) * (x - F.floor(x))

    return out.unionByName(joined.select(by, "n", F.array(*(at(p) for p in shares)).alias("q")))
