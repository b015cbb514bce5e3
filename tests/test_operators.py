"""Correspondence operators: small literal tables, and random ones against plain versions."""

import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from orbitweave.operators import candidates as c, metric_join
from orbitweave.operators import contrast, documents, lookups, metrics, rasters, refinement, robust
from orbitweave.plans import registration

MATCH = "match_id long, pair_id long, source_x double, source_y double, reference_x double, reference_y double, confidence double"
H = np.array([[1.02, 0.01, 5], [-0.01, 0.98, -3], [1e-5, 2e-5, 1]])


def random_matches(seed, n=150, size=60.0, pairs=2):
    r = random.Random(seed)
    return [(i, r.randrange(pairs), r.uniform(0, size), r.uniform(0, size), r.uniform(0, size), r.uniform(0, size), round(r.random(), 1)) for i in range(n)]


def greedy(matches, radius):
    kept = []
    for m in sorted(matches, key=lambda m: (-m[6], m[0])):
        if not any(k[1] == m[1] and math.dist(k[2:4], m[2:4]) <= radius and math.dist(k[4:6], m[4:6]) <= radius for k in kept):
            kept.append(m)
    return {m[0] for m in kept}


def test_filter(spark):
    nan = float("nan")
    data = [(1, 0, 1.0, 1.0, 1.0, 1.0, 0.2), (2, 0, 1.0, 1.0, 1.0, 1.0, 0.19), (3, 0, nan, 1.0, 1.0, 1.0, 0.9), (4, 0, 10.0, 1.0, 1.0, 1.0, 0.9), (5, 0, None, 1.0, 1.0, 1.0, 0.9), (6, 0, 0.0, 9.99, 0.0, 0.0, 1.0), (7, 0, 1.0, 1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(data, MATCH)
    assert [r["match_id"] for r in c.filter_candidates(df, (10, 10), (10, 10)).orderBy("match_id").collect()] == [1, 6]
    assert rows(c.bounds_report(df, (10, 10), (10, 10)).select("n", "kept", "removed")) == [(7, 4, 3)]
    assert c.filter_candidates(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_dedup(spark, seed):
    # chains of neighbours, where an anti-join on stronger neighbours would drop too many
    data = random_matches(seed, 120, 12.0)
    got = {r["match_id"] for r in c.deduplicate(spark.createDataFrame(data, MATCH), 4.0).collect()}
    assert got == greedy(data, 4.0)
    chain = [(i, 0, float(i) * 2, 0.0, float(i) * 2, 0.0, 1 - i / 10) for i in range(6)]
    df = spark.createDataFrame(chain, MATCH)
    once = c.deduplicate(df, 3.0)
    assert {r["match_id"] for r in once.collect()} == {0, 2, 4} and c.deduplicate(once, 3.0).count() == 3
    assert c.deduplicate(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [4, 5])
def test_mutual_against_all_pairs(spark, seed):
    f = random_matches(seed, 120, 20.0)
    b = [(m[0], m[1], m[4] + 0.7, m[5] - 0.4, m[2] + 0.5, m[3], m[6] * 0.9) for m in random_matches(seed, 120, 20.0)[::2]]
    want = set()
    for m in f:
        near = sorted((math.dist(m[4:6], x[2:4]), x[0], x) for x in b if x[1] == m[1])
        if near and near[0][0] <= 3 and math.dist(m[2:4], near[0][2][4:6]) <= 3:
            want.add((m[0], near[0][1], round(min(m[6], near[0][2][6]), 9)))
    rev = spark.createDataFrame(b, MATCH.replace("match_id", "rev_id"))
    got = {(r["match_id"], r["rev_id"], round(r["confidence"], 9)) for r in c.mutual(spark.createDataFrame(f, MATCH), rev, 3.0).collect()}
    assert got == want and want


def test_grid(spark):
    data = random_matches(6, 200, 80.0)
    df = spark.createDataFrame(data, MATCH)
    got = c.grid_select(df, (80, 80), (4, 4), 2)
    counts = {(r["pair_id"], r["grid_row"], r["grid_col"]): r["n"] for r in c.grid_histogram(got, (4, 4)).collect()}
    assert len(counts) == 32 and max(counts.values()) <= 2 and sum(counts.values()) == got.count()
    assert c.grid_select(df, (80, 80), (4, 4), 0).count() == 200
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_tiles_and_box(spark):
    t = rows(c.tiles(spark, 100, 100))
    assert t == [(0, 0, 0, 0, 56, 0, 56), (1, 0, 1, 0, 56, 44, 100), (2, 1, 0, 44, 100, 0, 56), (3, 1, 1, 44, 100, 44, 100)]
    assert c.tiles(spark, 40, 40).count() == 0
    shift = [1.0, 0.0, 10.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    assert spark.range(1).select(c.overlap_box(shift, (100, 300), (80, 200))).first()[0] == [10.0, 0.0, 200.0, 80.0]
    # padding: 12, or 0.15 of the tile's longer side; rounded outwards; at the image's edge cut
    assert rows(c.search_boxes(c.tiles(spark, 100, 100), (100, 100), (200, 120), shift).select("tile", "rx0", "ry0", "rx1", "ry1")) == [(0, 0, 0, 78, 68), (1, 42, 0, 120, 68), (2, 0, 32, 78, 112), (3, 42, 32, 120, 112)]
    assert c.search_boxes(c.tiles(spark, 100, 100), (100, 100), (20, 20)).count() == 0


def truth_matches(seed, n=80, bad=0.25, noise=0.3):
    r = np.random.default_rng(seed)
    a = r.uniform(0, 900, (n, 2))
    p = np.c_[a, np.ones(n)] @ H.T
    b = p[:, :2] / p[:, 2:] + r.normal(0, noise, (n, 2))
    outlier = np.arange(n) < n * bad
    b[outlier] += r.uniform(30, 80, (outlier.sum(), 2))
    return [(i, seed, *map(float, a[i]), *map(float, b[i]), 0.9) for i in range(n)], outlier


@pytest.mark.parametrize("iterate", [False, True])
def test_robust_models(spark, iterate):
    data, truth = [], {}
    for seed in (1, 2, 3):
        m, outlier = truth_matches(seed)
        data += [(seed * 1000 + x[0], *x[1:]) for x in m]
        truth |= {seed * 1000 + i: not o for i, o in enumerate(outlier)}
    few = [(9000 + i, 9, float(i), 0.0, float(i), 0.0, 0.5) for i in range(3)]
    line = [(9100 + i, 10, float(i), float(i), float(i), float(i), 0.5) for i in range(9)]
    df = spark.createDataFrame(data + few + line, MATCH)
    models = robust.fit_models(df, 3.0, iterate).cache()
    got = {r["match_id"]: r["inlier"] for r in robust.scored(df, models).collect()}
    assert {k: got[k] for k in truth} == truth and not any(got[9000 + i] for i in range(3))
    assert rows(models) == rows(robust.fit_models(df.repartition(3), 3.0, iterate))
    assert all(r["threshold"] <= 3.0 for r in models.collect())


def test_refit_takes_the_better_of_two_new_models(spark):
    m, outlier = truth_matches(4)
    good = [x for x, o in zip(m, outlier, strict=True) if not o]
    other = [(7000 + x[0], 5, *x[2:]) for x in m]
    few = [(8000 + x[0], 6, *x[2:]) for x in good[:3]]
    df = spark.createDataFrame(m + other + few, MATCH)
    keep = {x[0] for x in good} | {x[0] for x in other} | {x[0] for x in few}
    refined = df.withColumn("inlier", F.col("match_id").isin(*keep))
    got = {r["pair_id"]: r for r in robust.refit(refined).collect()}
    # right inliers give the refit; with outliers among them only the second pass holds
    assert got[4]["model"] == "refit" and got[4]["n_fit"] == len(good) and got[5]["model"] == "second_pass" and got[6]["h"] is None
    models = spark.createDataFrame([(p, r["h"], r["threshold"], r["n_fit"]) for p, r in got.items()], robust.MODEL)
    n = {r["pair_id"]: r["n"] for r in robust.scored(refined, models).where("inlier").groupBy("pair_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n == {4: len(good), 5: len(good)}


def test_tightening_never_loosens():
    r = np.random.default_rng(0)
    for k in range(20):
        e = np.abs(r.normal(0, 1 + k / 5, 50))
        assert robust.tightened(e, 3.0) <= 3.0
    assert robust.tightened(np.array([0.1, 0.2]), 3.0) == 3.0 and robust.tightened(np.full(9, 0.5), 3.0) == 2.0


def test_metrics(spark):
    data = [(1, 1, 0.0, 0.0, 0.0, 0.0, 0.5, 1.0, True), (2, 1, 0.0, 0.0, 100.0, 0.0, 0.7, 3.0, True), (3, 1, 0.0, 0.0, 100.0, 100.0, 0.9, 2.0, True), (4, 1, 0.0, 0.0, 0.0, 0.0, 0.1, 50.0, False), (5, 2, 0.0, 0.0, 0.0, 0.0, 0.3, None, False)]
    df = spark.createDataFrame(data, MATCH + ", reprojection_error double, inlier boolean")
    got = {r["pair_id"]: r for r in metrics.registration_metrics(df, (200, 200)).collect()}
    assert (got[1]["ransac_inliers"], got[1]["inlier_ratio"], got[1]["median_reprojection_error_px"], got[1]["occupied_grid_cells"]) == (3, 0.75, 2.0, 3)
    assert got[1]["rmse_reprojection_error_px"] == pytest.approx(math.sqrt(14 / 3)) and got[2]["rmse_reprojection_error_px"] is None and got[2]["occupied_grid_cells"] == 0
    hull = {r["pair_id"]: r["convex_hull_fraction"] for r in metrics.hull_coverage(df, "reference_x", "reference_y", (200, 200)).collect()}
    assert hull == {1: pytest.approx(5000 / 40000), 2: 0.0}
    m = metrics.registration_metrics(df, (200, 200))
    assert rows(m.select("pair_id", metrics.quality_gate(m, 3.0, least=3).alias("q"))) == [(1, True), (2, False)]


def test_lookups(spark):
    catalog = spark.createDataFrame([(1, "a", "x"), (2, "b", "a"), (3, "c", None)], "n long, image string, browse string")
    probe = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "path string")
    got = {r["path"]: r["catalog_n"] for r in lookups.any_key_lookup(probe, "path", catalog, ["image", "browse"], "n").collect()}
    assert got == {"a": 1, "b": 2, "z": None, None: None}
    assert rows(lookups.last_by_key(spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "k string, o int, v string"), "k", "o").select("v")) == [("new",)]


def test_nearest_in_time(spark):
    import datetime as dt

    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rec = spark.createDataFrame([(1, 10, t(0)), (1, 11, t(10)), (1, 9, t(10)), (1, 12, t(20))], "series_id int, record_number long, time timestamp_ntz")
    pro = spark.createDataFrame([(1, 1, t(-5)), (1, 2, t(5)), (1, 3, t(10)), (1, 4, t(16)), (1, 5, t(99)), (2, 6, t(0))], "series_id int, probe_id long, time timestamp_ntz")
    got = {r["probe_id"]: (r["record_number"], r["gap_seconds"]) for r in lookups.nearest_in_time(pro, rec, "series_id").collect()}
    assert got == {1: (10, 5.0), 2: (10, 5.0), 3: (9, 0.0), 4: (12, 4.0), 5: (12, 79.0), 6: (None, None)}


def test_descriptors_in_parts(spark, monkeypatch):
    r = np.random.default_rng(2)
    a, b = r.normal(size=(30, 8)), r.normal(size=(50, 8))
    df = lambda x: spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "id long, embedding array<double>")
    want = {(i, int(j)) for i, v in enumerate(a) for j in np.argsort(((b - v) ** 2).sum(1))[:2]}
    for part in (1000, 20):
        monkeypatch.setattr(metric_join, "PART", part)
        assert {(x["source_id"], x["reference_id"]) for x in lookups.descriptor_neighbours(df(a), df(b)).collect()} == want
    pts = spark.createDataFrame([(0.2, 0.1), (9.0, 9.0)], "x double, y double")
    grid = spark.createDataFrame([(i, float(i), float(i), float(i), -float(i)) for i in range(10)], "idx long, pixel double, scan double, longitude double, latitude double")
    assert rows(lookups.nearest_grid_point(pts, grid).select("longitude", "latitude")) == [(0.0, 0.0), (9.0, -9.0)]


def test_rasters(spark):
    px = [(1, y, x, float(y * 10 + x)) for y in range(10) for x in range(10)]
    df = spark.createDataFrame(px, "image_id long, y long, x long, v double")
    g = {(r["y"], r["x"]): (r["d_row"], r["d_col"]) for r in rasters.gradients(df, 1.0, 0, 1000, -1).collect()}
    assert len(g) == 64 and set(g.values()) == {(10.0, 1.0)}
    assert rasters.decimation_step(1000, 700, 256) == 4 and rasters.decimated(df, 5).count() == 4
    assert rows(rasters.area_resized(df, 5).select("v")) == [(22.0,), (27.0,), (72.0,), (77.0,)]
    s = {r["v"]: r["u8"] for r in rasters.percentile_stretch(df.withColumn("v", F.when(F.col("v") == 50, -1.0).otherwise(F.col("v"))), -1.0).collect()}
    assert s[-1.0] == 0 and s[0.0] == 0 and s[99.0] == 255
    same = rasters.percentile_stretch(df.withColumn("v", F.lit(7.0)))
    assert same.select(F.max("u8")).first()[0] == 0
    w = {(r["y"], r["x"]): r["v"] for r in rasters.warped(df, [1, 0, 0.5, 0, 1, 0, 0, 0, 1], 10, 10).collect()}
    assert w[2, 3] == 23.5 and w[2, 9] == 29 * 0.5
    pts = spark.createDataFrame([(0.5, 0.0), (1.5, 0.0), (99.0, 0.0), (None, 0.0)], "px double, py double")
    e = rows(rasters.elevation_at(pts, df, F.col("px"), F.col("py"), 10, 10, 0, 50, -1).select("px", "elevation_m", "reason"))
    assert e == sorted([(0.5, 0.0, "ok"), (1.5, 2.0, "ok"), (99.0, None, "outside_dem_coverage"), (None, None, "outside_dem_coverage")], key=repr)
    a, b = rasters.latlon_gradient(F.lit(2.0), F.lit(1.0), F.lit(3.0), F.lit(1.0), F.lit(90.0))
    got = spark.range(1).select(a.alias("a"), b.alias("b")).first()
    assert got["a"] > 0 and got["b"] is None


def test_refinement(spark):
    r = np.random.default_rng(3)
    image = contrast.blurred(r.uniform(0, 255, (64, 64)), 1.5)
    dx, dy, response, status = refinement.local_shift(image, np.roll(image, (1, 2), (0, 1)), 30, 30, 30, 30)
    assert status == "refined" and abs(dx - 2) < 0.5 and abs(dy - 1) < 0.5 and response > 0.2
    assert refinement.local_shift(image, image, 1, 1, 30, 30)[3] == "patch_outside_image"
    assert refinement.local_shift(np.zeros((64, 64)), image, 30, 30, 30, 30)[3] == "low_texture"


def test_contrast(spark):
    r = np.random.default_rng(4)
    image = r.integers(0, 256, (48, 40)).astype(np.uint8)
    out = contrast.local_contrast(image)
    assert out.shape == image.shape and out.dtype == np.uint8 and np.corrcoef(out.ravel(), image.ravel())[0, 1] > 0.7
    flat = contrast.local_contrast(np.full((16, 16), 9, np.uint8))
    assert flat.std() == 0
    df = spark.createDataFrame([(1, int(y), int(x), float(image[y, x])) for y in range(48) for x in range(40)], "image_id long, y long, x long, v double")
    assert sorted(x["v"] for x in contrast.enhanced(df).collect()) == sorted(out.ravel().astype(float).tolist())


def test_documents(spark, tmp_path):
    runs = spark.createDataFrame([(f"{i:032x}", i, "completed") for i in range(30)], "run_id string, created_at int, status string")
    path = str(tmp_path / "runs")
    assert documents.connect(spark, path) is None
    assert documents.append(runs.limit(20), path) == 20 and documents.append(runs, path) == 10 and documents.append(runs, path) == 0
    stored = documents.connect(spark, path)
    assert documents.by_id(stored, f"{7:032x}").count() == 1
    with pytest.raises(ValueError):
        documents.by_id(stored, "x")
    assert [r["created_at"] for r in documents.recent(stored, 3, 2).collect()] == [27, 26, 25]
    assert documents.recent(stored, 1000).count() == 30 and documents.recent(stored, 0).count() == 1
    assert [r["display"] for r in documents.search(stored, "COMPL", "created_at", page=2).collect()] == [6, 7, 8, 9, 10]
    with pytest.raises(ValueError):
        documents.page_arguments(0, 0)
    got = spark.range(1).select(documents.artifact(F.array(F.lit("inliers.png")), "final_tie_points.png").alias("a"), documents.normal_status(F.lit("success")).alias("b")).first()
    assert tuple(got) == ("inliers.png", "completed")


def test_registration_end_to_end(spark):
    m, outlier = truth_matches(5, 200, bad=0.1)
    forward = spark.createDataFrame(m, MATCH)
    reverse = forward.select(F.col("match_id").alias("rev_id"), "pair_id", F.col("reference_x").alias("source_x"), F.col("reference_y").alias("source_y"), F.col("source_x").alias("reference_x"), F.col("source_y").alias("reference_y"), "confidence")
    s = registration.Settings((1024, 1024), (1100, 1100), dedup_radius=0.5)
    got = registration.register(forward, reverse, s)
    row = got.metrics.first()
    assert row["registration_quality"] == "image_based_ransac_only" and got.tie_points.count() == row["ransac_inliers"] <= (~outlier).sum()
    one = registration.register_one_way([(forward, 1.0), (forward.withColumns({x: F.col(x) * 0.5 for x in c.POINTS}).withColumn("match_id", F.col("match_id") + 1000), 0.5)], s)
    assert one.metrics.first()["ransac_inliers"] > 50 and one.histogram.count() == 64
    with pytest.raises(NotImplementedError):
        registration.unavailable_matcher("network")(forward, 1.0)


@pytest.mark.parametrize("iterate", [False, True])
def test_large_pairs_are_fitted_over_all_rows(spark, iterate):
    data = [(seed * 10_000 + x[0], seed, *x[2:]) for seed in (0, 1) for x in truth_matches(seed, 3000, bad=0.3)[0]]
    few = spark.createDataFrame([*data, *((i + 50_000, 5, *x[2:]) for i, x in enumerate(data[900:960])), *((i + 60_000, 6, *x[2:]) for i, x in enumerate(data[:3]))], MATCH)
    whole = {r["pair_id"]: r for r in robust.fit_models(few, 3.0, iterate).collect()}
    got = {r["pair_id"]: r for r in robust.fit_models(few, 3.0, iterate, sample=150).collect()}
    assert got.keys() == whole.keys() and got[0]["n_fit"] == 3000 and got[5]["h"] == whole[5]["h"] and got[6]["h"] is None
    for k in (0, 1):
        assert got[k]["threshold"] == pytest.approx(whole[k]["threshold"], rel=0.02)
        a, b = ({r["match_id"] for r in robust.scored(few.where(F.col("pair_id") == k), spark.createDataFrame([x[k]], robust.MODEL)).where("inlier").collect()} for x in (whole, got))
        assert len(a ^ b) <= 0.002 * len(a)


def test_exact_quantiles(spark, monkeypatch):
    from orbitweave.operators import quantiles as qu

    r = np.random.default_rng(4)
    rows = [(int(k), float(v)) for k, n in ((0, 5000), (1, 1), (2, 2), (3, 700)) for v in (r.normal(size=n) ** 3 if k else np.round(r.normal(size=n), 1))] + [(4, 1e300), (4, -1e300), (4, 5.0), (0, float("nan"))] + [(0, None)]
    df = spark.createDataFrame(rows, "g long, v double")
    want = {k: np.percentile([v for x, v in rows if x == k and v is not None and v == v], [0, 1, 25, 50, 99, 100]) for k in range(5)}
    for whole in (100_000, 1, 0):
        monkeypatch.setattr(qu, "WHOLE", whole)
        got = {x["g"]: x["q"] for x in qu.quantiles(df, "g", F.col("v"), [0, 0.01, 0.25, 0.5, 0.99, 1]).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in got)
