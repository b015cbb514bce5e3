"""Operators whose work must grow no faster than their rows, against brute force, and what must not stand in their plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from orbitweave.operators import candidates, lookups, place_index, ranges, robust


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def most_rows(df):
    """Rows that the busiest operator of a plan gives out."""
    plan, most = df._jdf.queryExecution().executedPlan(), [0]

    def walk(p):
        if p.metrics().contains("numOutputRows"):
            most[0] = max(most[0], p.metrics().apply("numOutputRows").value())
        name, children = p.nodeName(), p.children()
        below = [p.executedPlan()] if name == "AdaptiveSparkPlan" else [p.plan()] if "QueryStage" in name else []
        for k in [*below, *(children.apply(i) for i in range(children.size()))]:
            walk(k)

    plan.execute().count()
    walk(plan)
    return most[0]


def test_points_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(place_index, "BROADCAST_PLACES", 10, raising=False)
    grid = spark.range(900).select(F.col("id").alias("idx"), (F.col("id") % 30 * 1.0).alias("pixel"), F.floor(F.col("id") / 30).cast("double").alias("scan"), (F.col("id") * 1.0).alias("longitude"), (F.col("id") * -1.0).alias("latitude"))
    points = spark.range(3000).select(F.col("id").alias("match_id"), (F.col("id") % 31 * 1.0 - 0.25).alias("x"), (F.col("id") % 7 * 1.0).alias("y"))
    got = lookups.nearest_grid_point(points, grid)
    assert "BroadcastExchange" not in plan_of(got)
    want = [(i, (min(29.0, max(0.0, float(i % 31)))) + 30.0 * (i % 7)) for i in range(3000)]
    assert sorted((r["match_id"], r["longitude"]) for r in got.collect()) == want


def test_frames_of_a_series_only_look_back(spark):
    cut = spark.range(1000).select(F.lit("a").alias("s"), F.col("id").alias("t"), F.when(F.col("id") % 10 == 3, F.col("id")).alias("v"), F.floor(F.col("id") / 300).cast("int").alias("_range"))
    got = ranges.carried(cut, "s", ["t"], "v")
    assert "unboundedfollowing" not in plan_of(got)
    down, up = lambda t: t - (t - 3) % 10, lambda t: t + (3 - t) % 10
    assert {tuple(r) for r in got.select("t", "_before", "_after").collect()} == {(t, down(t) if down(t) >= 0 else None, up(t) if up(t) < 1000 else None) for t in range(1000)}


def overlap_tables(spark, a, b):
    f = lambda v: None if v is None else float(v)
    return (spark.createDataFrame([(i, f(x), f(y)) for i, (x, y) in enumerate(a)], "region_id long, lat_lo double, lat_hi double"),
            spark.createDataFrame([(i, f"p{i}", f(x), f(y)) for i, (x, y) in enumerate(b)], "ordinal long, provider string, p_lo double, p_hi double"))


def test_first_overlapping_against_all_pairs(spark):
    r = np.random.default_rng(5)
    spans = lambda n, w: [(x, x + y) for x, y in zip(r.uniform(-90, 90, n).round(1), (r.random(n) * w).round(1), strict=True)]
    a, b = spans(300, 20.0) + [(5, 5), (7, 3), (None, 1)], spans(60, 3.0)[::-1] + [(5, 5), (40, 38), (1, None), (6.5, 6.5), (-0.0, 0.0)]
    got = {x["region_id"]: x["provider"] for x in lookups.first_overlapping(*overlap_tables(spark, a, b)).collect()}
    over = lambda s, t: None not in (*s, *t) and s[0] <= t[1] and t[0] <= s[1]
    assert got == {i: next((f"p{j}" for j, t in enumerate(b) if over(s, t)), None) for i, s in enumerate(a)}


def test_many_ranges_of_one_degree_form_no_pairs(spark):
    n = 3000
    a = spark.range(n).select(F.col("id").alias("region_id"), (F.col("id") / n * 0.5).alias("lat_lo"), (F.col("id") / n * 0.5 + 0.4).alias("lat_hi"))
    b = spark.range(n).select((F.lit(n) - F.col("id")).alias("ordinal"), F.col("id").cast("string").alias("provider"), (F.col("id") / n * 0.9).alias("p_lo"), (F.col("id") / n * 0.9 + 0.01).alias("p_hi"))
    got = lookups.first_overlapping(a, b)
    assert got.where("provider IS NULL").isEmpty() and got.count() == n
    assert most_rows(got) < 100 * n


@pytest.mark.parametrize("radius", [2.0, 3.0])
def test_without_weaker_against_all_pairs(spark, radius):
    r = np.random.default_rng(8)
    data = [(1, i, *map(float, p), float(c)) for i, (p, c) in enumerate(zip(np.r_[r.uniform(0, 9, (250, 4)), np.tile([4.0, 4, 4, 4], (50, 1))], r.integers(0, 40, 300) / 40, strict=True))]
    data += [(2, 1, 0.0, 0.0, 0.0, 0.0, 0.9), (2, 2, 1.5, 0.0, 1.5, 0.0, 0.8), (2, 3, 3.0, 0.0, 3.0, 0.0, 0.7), (2, 4, float("nan"), 0.0, 0.0, 0.0, 0.1), (2, 5, None, 0.0, 0.0, 0.0, 0.1)]
    table = spark.createDataFrame(data, "pair_id long, match_id long, source_x double, source_y double, reference_x double, reference_y double, confidence double")
    ok = lambda m: all(v is not None and v == v for v in m[2:])
    near = lambda a, b: ok(a) and ok(b) and all(np.hypot(a[k] - b[k], a[k + 1] - b[k + 1]) <= radius for k in (2, 4))
    want = [m[:2] for m in data if not any(o[0] == m[0] and (-o[6], o[1]) < (-m[6], m[1]) and near(o, m) for o in data)]
    assert rows(candidates.merge([table], radius, chains=False).select("pair_id", "match_id")) == sorted(want, key=repr)


def test_chains_differ_in_the_two_forms(spark):
    table = spark.createDataFrame([(2, i, 1.5 * i, 0.0, 1.5 * i, 0.0, 1.0 - i / 10) for i in range(3)], "pair_id long, match_id long, source_x double, source_y double, reference_x double, reference_y double, confidence double")
    assert rows(candidates.merge([table], 2.0).select("match_id")) == [(0,), (2,)]
    assert rows(candidates.merge([table], 2.0, chains=False).select("match_id")) == [(0,)]


def test_mutual_against_all_pairs_in_little_shuffle(spark):
    r = np.random.default_rng(4)
    p = lambda n: r.uniform(-15, 25, (n, 4)).round(0)
    f, b = [(1, i, *map(float, x), 0.5) for i, x in enumerate(p(400))], [(1, i, *map(float, x), 0.25) for i, x in enumerate(p(300))]
    schema = "pair_id long, {} long, source_x double, source_y double, reference_x double, reference_y double, confidence double"
    forward, reverse = spark.createDataFrame(f, schema.format("match_id")), spark.createDataFrame(b, schema.format("rev_id"))
    got = candidates.mutual(forward, reverse)
    want = []
    for m in f:
        d, _, o = min((np.hypot(m[4] - o[2], m[5] - o[3]), o[1], o) for o in b)
        if d <= 3.0 and np.hypot(m[2] - o[4], m[3] - o[5]) <= 3.0:
            want.append((m[1], o[1], 0.25))
    assert rows(got.select("match_id", "rev_id", "confidence")) == sorted(want, key=repr) and want


def test_mutual_of_copies_forms_no_pairs(spark):
    n = 1500
    at = {c: F.lit(4.0) for c in candidates.POINTS} | {"pair_id": F.lit(1), "confidence": F.lit(0.5)}
    got = candidates.mutual(spark.range(n).withColumnRenamed("id", "match_id").withColumns(at), spark.range(n).withColumnRenamed("id", "rev_id").withColumns(at))
    assert most_rows(got) < 10 * n
    assert got.count() == n and got.where("rev_id <> 0").isEmpty()


def planted(spark, n, seed=6):
    """Two pairs under one homography, with every fifth row wrong; those of the second pair share a few ids."""
    r = np.random.default_rng(seed)
    a = r.uniform(0, 1000, (2 * n, 2))
    b = a @ np.array([[1.02, -0.01], [0.01, 0.98]]) + [5, -3] + r.normal(0, 0.2, (2 * n, 2)) + np.where(np.arange(2 * n) % 5 == 0, 60.0, 0.0)[:, None]
    data = [(i % 2, i if i % 2 == 0 else i % 7, *map(float, a[i]), *map(float, b[i])) for i in range(2 * n)]
    return spark.createDataFrame(data, "pair_id long, match_id long, source_x double, source_y double, reference_x double, reference_y double"), a, b


def test_sample_is_that_of_the_lowest_hashes(spark):
    table, _, _ = planted(spark, 3000)
    got = robust.sampled(table.withColumn("n_fit", F.lit(3000)), 200)
    hashed = sorted((r[0], r[1], r[2]) for r in table.select("pair_id", F.xxhash64("match_id"), "match_id").collect())
    want = [x for pair in (0, 1) for x in [h for h in hashed if h[0] == pair][:200]]
    assert rows(got.select("pair_id", F.xxhash64("match_id"), "match_id")) == sorted(want, key=repr)


def test_least_squares_from_sums(spark):
    table, a, b = planted(spark, 500)
    got = {r["pair_id"]: r["h"] for r in robust.least_squares_of(table).collect()}
    for pair in (0, 1):
        assert np.allclose(np.array(got[pair]).reshape(3, 3), robust.least_squares(a[pair::2], b[pair::2]), rtol=1e-7, atol=1e-9)


def test_a_refit_that_changes_no_inlier_is_the_last(spark, monkeypatch):
    table, a, b = planted(spark, 1500)
    passes = []
    ranked = robust.ranked
    monkeypatch.setattr(robust, "ranked", lambda *x: passes.append(1) or ranked(*x))
    got = {r["pair_id"]: np.array(r["h"]).reshape(3, 3) for r in robust.fit_models(table, 3.0, sample=300).collect()}
    assert len(passes) <= 3
    for pair in (0, 1):
        right = np.arange(1500) * 2 % 5 != 0 if pair == 0 else (np.arange(1500) * 2 + 1) % 5 != 0
        assert ((robust.errors(got[pair], a[pair::2], b[pair::2]) <= 3.0) == right).all()
        assert np.allclose(got[pair], robust.least_squares(a[pair::2][right], b[pair::2][right]), rtol=1e-6, atol=1e-8)
