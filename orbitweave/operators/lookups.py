"""Lookups: keys in several columns, provider cascades, nearest neighbours in time, space and
descriptor space, overlapping regions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitweave.functions import geometry as g
from orbitweave.operators import metric_join, place_index, ranges
from orbitweave.storage import written


def any_key_lookup(probe: DataFrame, key: str, catalog: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """probe left-joined with the catalog row of lowest ordinal of which any of keys equals key. The
    OR is turned into one equi-join: a catalog row stands once for each of its keys."""
    rows = catalog.select(F.explode(F.array_distinct(F.array(*(F.col(k).cast("string") for k in keys)))).alias("_key"), F.struct(F.col(ordinal).alias("_ordinal"), *(F.col(c) for c in catalog.columns)).alias("_row"))
    first = rows.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.min("_row").alias("_row"))
    joined = probe.join(first, F.col(key).cast("string") == F.col("_key"), "left")
    return joined.select(*probe.columns, *(F.col("_row")[c].alias(f"catalog_{c}") for c in catalog.columns))


def last_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last in order, as a dictionary keeps it."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, *(F.col("_r")[c].alias(c) for c in rest))


def cascade(probe: DataFrame, steps: Sequence[tuple[str, DataFrame, Column, str]], into: str = "provider") -> DataFrame:
    """The first step that finds a provider wins. steps: (name, table with one provider column and
    join columns, join condition, provider column); a table that holds several rows for a probe row
    must be reduced before. Adds into and its origin, 'unavailable' without any."""
    out, found = probe, []
    for k, (name, table, on, column) in enumerate(steps):
        out = out.join(table.withColumnRenamed(column, f"_p{k}"), on, "left")
        found.append((name, F.col(f"_p{k}")))
    origin = F.coalesce(*(F.when(c.isNotNull(), F.lit(n)) for n, c in found), F.lit("unavailable"))
    return out.select(*probe.columns, F.coalesce(*(c for _, c in found)).alias(into), origin.alias(f"{into}_origin"))


def overlaps(lo: Column, hi: Column, other_lo: Column, other_hi: Column) -> Column:
    return (lo <= other_hi) & (other_lo <= hi)


def _spans(level: int) -> Column:
    """The nodes (level, node) of a binary tree over places 0, 1, ... that make up _lo to _hi: two of a level at most."""
    a, b = "(-shiftright(-_lo, k))", "shiftright(_hi + 1, k)"
    two = ", ".join(f"struct(k AS level, IF({x} % 2 = 1 AND {a} < {b}, {n}, NULL) AS node)" for x, n in ((a, a), (b, f"{b} - 1")))
    return F.expr(f"filter(flatten(transform(sequence(0, {level}), k -> array({two}))), n -> n.node IS NOT NULL)")


def _above(level: int) -> Column:
    """The nodes that hold the place _lo."""
    return F.expr(f"transform(sequence(0, {level}), k -> struct(k AS level, shiftright(_lo, k) AS node))")


def first_overlapping(regions: DataFrame, providers: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """regions (region_id, lat_lo, lat_hi) with the provider of lowest ordinal whose latitudes
    overlap (longitudes are not looked at), null without one. providers: ordinal, provider, p_lo,
    p_hi.

    No pairs are formed. Equal ranges are one, with the first of their providers. All bounds are numbered in their
    order, and these places are the leaves of a binary tree. A provider overlaps if it holds a region's lower
    bound - its range is a few nodes, the bound stands under one of each level - or begins in the region, which is
    the same with the sides changed. A node keeps its first provider only, so both are an equi-join of regions with
    one row. Ranges whose ends are the wrong way round are compared with the others in each whole degree."""
    asked = regions.select("lat_lo", "lat_hi").where("lat_lo IS NOT NULL AND lat_hi IS NOT NULL").distinct()
    first = F.min(F.struct(ordinal, "provider")).alias("_b")
    held = written(providers.where("p_lo IS NOT NULL AND p_hi IS NOT NULL").groupBy("p_lo", "p_hi").agg(first), "providers")
    asked = written(asked, "regions")
    values = [t.select(F.col(c).cast("double").alias("_v")) for t, cs in ((asked, ("lat_lo", "lat_hi")), (held, ("p_lo", "p_hi"))) for c in cs]
    places = written(ranges.numbered(values[0].unionByName(values[1]).unionByName(values[2]).unionByName(values[3]).distinct(), ["_v"], into="_place"), "bounds")
    level = max(0, places.count().bit_length())

    def placed(table: DataFrame, lo: str, hi: str) -> DataFrame:
        for c, name in ((lo, "_lo"), (hi, "_hi")):
            own = places.select(F.col("_v").alias(f"_v{name}"), F.col("_place").alias(name))
            table = table.join(own.hint("merge"), F.col(c).cast("double") == F.col(f"_v{name}")).drop(f"_v{name}")
        return written(table, "placed")

    a, b = placed(asked, "lat_lo", "lat_hi"), placed(held, "p_lo", "p_hi")
    right = F.col("_lo") <= F.col("_hi")
    nodes = lambda table, begins, kind, *more: table.where(right).select(*more, F.lit(kind).alias("kind"), F.explode((_above if begins else _spans)(level)).alias("_n")).select(*more, "kind", "_n.*")
    of = nodes(b, False, "holds", "_b").unionByName(nodes(b, True, "begins", "_b")).groupBy("kind", "level", "node").agg(F.min("_b").alias("_b"))
    hit = nodes(a, True, "holds", "lat_lo", "lat_hi").unionByName(nodes(a, False, "begins", "lat_lo", "lat_hi")).join(of.hint("merge"), ["kind", "level", "node"]).select("lat_lo", "lat_hi", "_b")
    for own, other in ((a.where(~right), b.where(right)), (a.where(right), b.where(~right))):
        own = own.withColumn("_deg", F.explode(F.sequence(F.floor("lat_lo"), F.floor("lat_hi"))))
        other = other.select("p_lo", "p_hi", "_b", F.explode(F.sequence(F.floor("p_lo"), F.floor("p_hi"))).alias("_d"))
        met = own.join(other, (F.col("_deg") == F.col("_d")) & overlaps(F.col("lat_lo"), F.col("lat_hi"), F.col("p_lo"), F.col("p_hi")))
        hit = hit.unionByName(met.select("lat_lo", "lat_hi", "_b"))
    best = hit.groupBy(F.col("lat_lo").alias("_a"), F.col("lat_hi").alias("_z")).agg(F.min("_b").alias("_b"))
    out = regions.join(best.hint("merge"), (F.col("lat_lo") == F.col("_a")) & (F.col("lat_hi") == F.col("_z")), "left")
    return out.select(*regions.columns, F.col("_b")["provider"].alias("provider"))


def nearest_in_time(probes: DataFrame, records: DataFrame, by: str, time: str = "time", record: str = "record_number", probe: str = "probe_id", range_rows: int | None = None) -> DataFrame:
    """probes with the nearest record of the same series, before or after; ties to the earlier one,
    then to the lowest record. Both sides are sorted together: the last record at or before and the
    first after each probe. A long series is cut into ranges of time, each a window of its own, and
    the records at their edges are carried across (ranges.carried). A probe without a time has no record."""
    of = dict(records.dtypes)
    kind = f"struct<t:{of[time]},r:{of[record]}>"
    held = F.struct(F.col(time).alias("t"), F.col(record).alias("r"))
    rows = probes.select(by, F.col(time).alias("_t"), F.lit(1).alias("_kind"), F.col(probe).alias("_probe"), F.lit(None).cast(kind).alias("_rec"))
    firsts = records.where(F.col(time).isNotNull()).groupBy(by, time).agg(F.min(record).alias(record))
    rows = rows.unionByName(firsts.select(by, F.col(time).alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast(dict(probes.dtypes)[probe]).alias("_probe"), held.alias("_rec")))
    cut = ranges.ranged(rows, [by], ["_t", "_kind"], "_probe", range_rows)
    near = ranges.carried(cut, by, ["_t", "_kind"], "_rec").where("_kind = 1")
    gap = lambda a, b: F.abs(F.unix_micros(F.to_timestamp(a)) - F.unix_micros(F.to_timestamp(b)))
    d0, d1 = gap(F.col("_t"), F.col("_before")["t"]), gap(F.col("_after")["t"], F.col("_t"))
    earlier = F.col("_after").isNull() | (d0 <= d1)
    pick = F.when(F.col("_t").isNotNull(), F.when(earlier, F.col("_before")).otherwise(F.col("_after")))
    return near.select(by, F.col("_probe").alias(probe), F.col("_t").alias(time), pick["r"].alias(record), (F.when(earlier, d0).otherwise(d1) / 1e6).alias("gap_seconds"))


def nearest_grid_point(points: DataFrame, grid: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """points with longitude and latitude of the nearest grid point (pixel, scan), ties to the
    lowest idx: a descent through a tree of cells (place_index)."""
    return place_index.nearest_place(points, grid, x, y)


def descriptor_neighbours(source: DataFrame, reference: DataFrame, k: int = 2) -> DataFrame:
    """(source_id, reference_id, distance, rank): the k nearest descriptors by Euclidean distance,
    ties to the lowest id. Both sides: (id, embedding). A metric join (metric_join)."""
    return metric_join.nearest(source, reference, k)


def ratio_test(neighbours: DataFrame, ratio: float = 0.75, by: Sequence[str] = ()) -> DataFrame:
    """Source descriptors (of each group of by) whose nearest neighbour is nearer than ratio times the
    second (both must exist); with confidence 1 / (1 + distance)."""
    both = neighbours.groupBy(*by, "source_id").agg(F.max(F.when(F.col("rank") == 1, F.col("reference_id"))).alias("reference_id"), F.max(F.when(F.col("rank") == 1, F.col("distance"))).alias("distance"), F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("second_distance"))
    return both.where(F.col("distance") < F.lit(ratio) * F.col("second_distance")).withColumn("confidence", g.confidence_of(F.col("distance")))


def series_summary(records: DataFrame, by: str, time: str = "time", record: str = "record_number") -> DataFrame:
    """Per series: count, times of the first and last record by position, smallest and largest norms
    of position (km) and quaternion. records: px, py, pz, qx, qy, qz, qw."""
    p = F.sqrt(F.col("px") * F.col("px") + F.col("py") * F.col("py") + F.col("pz") * F.col("pz"))
    q = F.sqrt(F.col("qx") * F.col("qx") + F.col("qy") * F.col("qy") + F.col("qz") * F.col("qz") + F.col("qw") * F.col("qw"))
    return records.groupBy(by).agg(F.count(F.lit(1)).alias("records"), F.min_by(time, record).alias("start_time"), F.max_by(time, record).alias("end_time"), F.min(p).alias("position_min_km"), F.max(p).alias("position_max_km"), F.min(q).alias("quaternion_min"), F.max(q).alias("quaternion_max"))
