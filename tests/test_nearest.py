"""Nearest vectors, places and records, and numbers of long series, against comparisons of all pairs."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitweave.operators import documents, lookups, metric_join, place_index, ranges

DATA = "/root/testdata/sf0.1"


def vectors(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row] if row is not None else None) for i, row in enumerate(x)], "id long, embedding array<float>")


def nearest_by_hand(x, y, k, first=0):
    x, y = (np.array(v, np.float32).astype(float) for v in (x, y))
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    return {(i, rank, int(first + j)) for i in range(len(x)) for rank, j in enumerate(np.lexsort((np.broadcast_to(np.arange(len(y)), d.shape), d), axis=1)[i, :k], 1)} if len(y) else set()


def found(df):
    return {(r["source_id"], r["rank"], r["reference_id"]) for r in df.collect()}


def clusters(seed, n, d, centres=12, spread=0.05):
    r = np.random.default_rng(seed)
    at = np.random.default_rng(1).random((centres, d))
    return at[r.integers(0, centres, n)] + r.normal(0, spread, (n, d))


@pytest.mark.parametrize(("part", "bins"), [(4096, 256), (40, 4), (7, 1)])
def test_metric_join(spark, monkeypatch, part, bins):
    for name, value in (("PART", part), ("BINS", bins), ("VISITS", 30)):
        monkeypatch.setattr(metric_join, name, value)
    y = np.concatenate([clusters(2, 300, 6), np.tile([0.5] * 6, (60, 1)), [[9.0] * 6]])  # many copies, one far away
    x = np.concatenate([clusters(3, 60, 6), [[0.5] * 6, [100.0] * 6]])
    assert found(lookups.descriptor_neighbours(vectors(spark, x), vectors(spark, y, 1000), 3)) == nearest_by_hand(x, y, 3, 1000)


def test_metric_join_of_few_null_and_no_vectors(spark):
    few = vectors(spark, [[1.0, 2.0], None, [1.0, 2.0]])
    assert found(metric_join.nearest(few, few, 4)) == {(0, 1, 0), (0, 2, 2), (2, 1, 0), (2, 2, 2)}
    none = few.where("id > 5")
    assert not found(metric_join.nearest(few, none)) and not found(metric_join.nearest(none, few))
    one = vectors(spark, [[3.0]])
    assert found(metric_join.nearest(vectors(spark, [[1.0], [8.0]]), one, 2)) == {(0, 1, 0), (1, 1, 0)}


def test_rings_that_cannot_win_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "PART", 50)
    y, x = clusters(4, 1500, 8, spread=0.01), clusters(5, 200, 8, spread=0.01)
    seen = metric_join.visited(vectors(spark, x), vectors(spark, y), 2).agg(F.sum("compared"), F.count(F.lit(1))).first()
    assert seen[0] < 0.1 * len(x) * len(y) and seen[1] < 5 * len(x)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_given_embeddings_are_compared_in_part(spark):
    # they have no structure, so that no ring can be left out; most pairs end with the first axes
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    source, reference = e.where("id % 2 = 0"), e.where("id % 2 = 1")
    compared = metric_join.visited(source, reference, 2).agg(F.sum("compared")).first()[0]
    assert compared < 0.35 * source.count() * reference.count()


def places(spark, grid):
    return spark.createDataFrame([(i, float(x), float(y), float(i), -float(i)) for i, (x, y) in enumerate(grid)], "idx long, pixel double, scan double, longitude double, latitude double")


R = np.random.default_rng(7)
GRIDS = {
    "even": R.random((3000, 2)) * 1000,
    "crowded": np.concatenate([R.normal(500, 0.5, (1500, 2)), R.random((500, 2)) * 5000]),
    "ties": R.integers(0, 30, (2500, 2)).astype(float),
    "line": np.c_[np.arange(500.0), np.zeros(500)],
    "one": np.array([[3.0, 4.0], [3.0, 4.0]]),
}


@pytest.mark.parametrize("name", GRIDS)
def test_nearest_place(spark, name):
    grid = GRIDS[name]
    x = np.concatenate([R.random((200, 2)) * 1200 - 100, R.normal(500, 1, (100, 2)), R.random((20, 2)) * 1e7, R.integers(0, 30, (60, 2)).astype(float)])
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(-1, None, 1.0), (-2, float("nan"), 1.0)], "match_id long, x double, y double")
    got = {r["match_id"]: r["longitude"] for r in lookups.nearest_grid_point(points, places(spark, grid)).collect()}
    d = (x[:, None, 0] - grid[None, :, 0]) ** 2 + (x[:, None, 1] - grid[None, :, 1]) ** 2
    assert got == {i: float(j) for i, j in enumerate(d.argmin(1))} | {-1: None, -2: None}


def test_few_places_are_looked_at(spark):
    grid = places(spark, GRIDS["even"]).select("idx", F.col("pixel").alias("px"), F.col("scan").alias("py"))
    cells, held, first, deepest = place_index.tree(grid)
    points = spark.range(500).select(F.col("id").alias("_row"), (F.col("id") * 2.0).alias("_x"), (F.col("id") * 37 % 1000 * 1.0).alias("_y"))
    asked = place_index.candidates(points, cells, first, deepest)
    n = asked.join(held, ["level", "cx", "cy"]).count()
    assert held.count() == 3000 and n < 500 * 60


def test_nearest_place_of_no_grid(spark):
    points = spark.createDataFrame([(1, 2.0, 3.0)], "match_id long, x double, y double")
    assert [tuple(r) for r in place_index.nearest_place(points, places(spark, [])).collect()] == [(1, 2.0, 3.0, None, None)]


@pytest.mark.parametrize("range_rows", [None, 37])
def test_nearest_in_time_over_ranges(spark, range_rows):
    r = np.random.default_rng(3)
    records = [("a" if i % 3 else "b", i, float(r.integers(0, 300))) for i in range(400)] + [("a", 900 + i, 77.0) for i in range(200)]
    probes = [("a" if i % 4 else "b", i, float(r.integers(-20, 330))) for i in range(300)] + [("c", 700, 5.0), ("a", 701, None)]
    stamp = F.timestamp_micros((F.col("s") * 1_000_000).cast("long"))
    table = lambda rows, key: spark.createDataFrame(rows, f"series_id string, {key} long, s double").withColumn("time", stamp).drop("s")
    got = lookups.nearest_in_time(table(probes, "probe_id"), table(records, "record_number"), "series_id", range_rows=range_rows)
    want = set()
    for series, probe, t in probes:
        of = [] if t is None else [(abs(t - s), s, n) for x, n, s in records if x == series]
        best = min(of, default=(None, None, None))
        want.add((series, probe, best[2], best[0]))
    assert {(x["series_id"], x["probe_id"], x["record_number"], x["gap_seconds"]) for x in got.collect()} == want


def test_a_long_series_is_many_windows(spark):
    rows = spark.range(5000).select(F.lit("a").alias("s"), (F.col("id") * 7919 % 5000).alias("k"))
    cut = ranges.ranged(rows, ["s"], ["k"], range_rows=500)
    sizes = [r["count"] for r in cut.groupBy("_range").count().collect()]
    assert len(sizes) > 5 and max(sizes) < 2000
    # a time that half of all rows have does not keep them together
    same = ranges.ranged(rows.withColumn("t", F.lit(1)), ["s"], ["t"], "k", 500)
    assert same.groupBy("_range").count().agg(F.max("count")).first()[0] < 2000


@pytest.mark.parametrize("range_rows", [None, 100])
def test_numbers_of_ranges(spark, range_rows):
    rows = spark.range(1000).select((F.col("id") % 3 * F.when(F.col("id") % 7 > 0, 1)).alias("run_id"), (F.col("id") * 37 % 1009).alias("match_id"))
    got = ranges.numbered(rows, ["match_id"], ["run_id"], "point_id", range_rows)
    by = {}
    for r in sorted(rows.collect(), key=lambda r: r["match_id"]):
        by.setdefault(r["run_id"], []).append(r["match_id"])
    assert {tuple(r) for r in got.collect()} == {(run, m, k) for run, ms in by.items() for k, m in enumerate(ms, 1)}
    assert documents.numbered(rows).where("point_id = 1").count() == 4
    assert [tuple(r) for r in ranges.numbered(spark.range(3).toDF("m"), ["m"], range_rows=2).orderBy("m").collect()] == [(0, 1), (1, 2), (2, 3)]
