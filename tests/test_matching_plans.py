"""Matching inside tiles and the search for a working scale, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitweave.operators import candidates as c
from orbitweave.operators import metric_join, tiled
from orbitweave.operators import refinement as rf
from orbitweave.plans import registration as rg

R = np.random.default_rng(21)


def keypoints(n, pairs=2):
    places = R.uniform(0, 200, (n, 2))
    vectors = R.normal(0, 1, (n, 16))
    return [(int(i % pairs), i, float(x), float(y), [float(v) for v in e]) for i, ((x, y), e) in enumerate(zip(places, vectors, strict=True))]


FIELDS = "pair_id long, id long, x double, y double, embedding array<double>"


def passing(a, b, ratio):
    out = {}
    for i, _, e in a:
        d = sorted((float(np.linalg.norm(np.array(e) - np.array(f))), j) for j, _, f in b)
        if len(d) > 1 and d[0][0] < ratio * d[1][0]:
            out[i] = (d[0][1], 1 / (1 + d[0][0]))
    return out


def tiles_by_hand(source, reference, boxes, base, radius, dedup):
    found = []
    place_s, place_r = {(p, i): (x, y) for p, i, x, y, _ in source}, {(p, i): (x, y) for p, i, x, y, _ in reference}
    for pair in {r[0] for r in source}:
        for b in boxes:
            s = [(i, (x, y), e) for p, i, x, y, e in source if p == pair and b["x0"] <= x < b["x1"] and b["y0"] <= y < b["y1"]]
            r = [(i, (x, y), e) for p, i, x, y, e in reference if p == pair and b["rx0"] <= x < b["rx1"] and b["ry0"] <= y < b["ry1"]]
            there, back = passing(s, r, 0.75), passing(r, s, 0.75)
            for i, (j, conf) in there.items():
                near = sorted((float(np.hypot(*np.subtract(place_r[pair, j], place_r[pair, m]))), m) for m in back)
                if near and near[0][0] <= radius:
                    m = near[0][1]
                    if np.hypot(*np.subtract(place_s[pair, i], place_s[pair, back[m][0]])) <= radius:
                        found.append((pair, i * (len(boxes) + 1) + b["tile"], b["tile"], i, j, min(conf, back[m][1])))
    found += [(p, i * (len(boxes) + 1) + len(boxes), len(boxes), i, j, conf) for p, i, j, conf in base]
    kept = []
    for m in sorted(found, key=lambda m: (-m[5], m[1])):
        if not any(k[0] == m[0] and np.hypot(*np.subtract(place_s[m[0], m[3]], place_s[m[0], k[3]])) <= dedup and np.hypot(*np.subtract(place_r[m[0], m[4]], place_r[m[0], k[4]])) <= dedup for k in kept):
            kept.append(m)
    return sorted((*m[:5], round(m[5], 9)) for m in kept)


@pytest.mark.parametrize("part", [4096, 20])
def test_tiled_matches(spark, monkeypatch, part):
    monkeypatch.setattr(metric_join, "PART", part)
    source = keypoints(160)
    reference = [(p, i, 0.9 * x + 2, 0.8 * y + 1, [v + float(R.normal(0, 0.1 if i % 6 else 0.9)) for v in e]) for p, i, x, y, e in source]
    s, r = spark.createDataFrame(source, FIELDS), spark.createDataFrame(reference, FIELDS)
    boxes = c.search_boxes(c.tiles(spark, 200, 200, (2, 2)), (200, 200), (170, 190), [0.9, 0, 2, 0, 0.8, 1, 0, 0, 1])
    base = [(0, 2, 2, 0.99), (1, 3, 3, 0.01)]
    at = {(x[0], x[1]): x[2:4] for x in source}, {(x[0], x[1]): x[2:4] for x in reference}
    based = spark.createDataFrame([(p, i, j, *at[0][p, i], *at[1][p, j], conf) for p, i, j, conf in base], "pair_id long, source_id long, reference_id long, source_x double, source_y double, reference_x double, reference_y double, confidence double")
    got = tiled.tiled_matches(s, r, tiled.boxes_of_pairs(s, boxes), 4, based)
    want = tiles_by_hand(source, reference, [b.asDict() for b in boxes.collect()], base, 8.0, 3.0)
    assert sorted((x["pair_id"], x["match_id"], x["tile"], x["source_id"], x["reference_id"], round(x["confidence"], 9)) for x in got.collect()) == want and len(want) > 80
    counts = {x["pair_id"]: x for x in tiled.tile_counts(got, 4).collect()}
    assert sum(x["matches"] for x in counts.values()) == len(want) and counts[0]["full_frame_matches"] >= 1
    assert tiled.tiled_matches(s, r.where("id < 0"), tiled.boxes_of_pairs(s, boxes), 4).count() == 0


def test_scale_search(spark):
    rows = []

    def attempt(pair, k, good, bad, scale):
        for i in range(good + bad):
            x, y = R.uniform(0, 900, 2)
            u, v = (x + 7, 0.9 * y + 5) if i < good else R.uniform(0, 900, 2)
            rows.append((pair, k, i, float(x * scale), float(y * scale), float(u * scale), float(v * scale), float(R.random()), scale, scale))

    attempt(1, 1, 40, 4, 0.5)  # good enough at once: later ones are not made
    attempt(1, 2, 90, 4, 1.0)
    attempt(2, 1, 30, 40, 0.5)  # never good enough: the best of all
    attempt(2, 2, 45, 60, 0.75)
    attempt(2, 3, 20, 30, 1.0)
    attempt(3, 1, 9, 0, 0.5)  # too few, then enough
    attempt(3, 2, 30, 2, 1.0)
    attempt(3, 3, 80, 1, 1.0)
    attempt(4, 1, 2, 0, 1.0)  # no model
    df = spark.createDataFrame(rows, "pair_id long, attempt int, match_id long, source_x double, source_y double, reference_x double, reference_y double, confidence double, source_scale double, reference_scale double")
    found = rg.search_scales(df, rg.Settings(noise=0.5))
    got = {r["pair_id"]: r for r in found.chosen.collect()}
    assert {p: (r["attempt"], r["sufficient"], r["attempts_made"]) for p, r in got.items()} == {1: (1, True, 1), 2: (2, False, 3), 3: (2, True, 2), 4: (1, False, 1)}
    assert got[1]["inliers"] == 40 and 45 <= got[2]["inliers"] <= 50 and got[4]["inliers"] == 0 and got[4]["rmse"] is None
    assert {(r["pair_id"], r["attempt"]) for r in found.attempts.collect()} == {(1, 1), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2), (4, 1)}
    h = {r["pair_id"]: r["h"] for r in found.models.collect()}
    assert set(h) == {1, 2, 3, 4} and h[4] is None and h[1] == pytest.approx([1, 0, 7, 0, 0.9, 5, 0, 0, 1], abs=1e-6)
    assert found.selected.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n")).where("pair_id = 1").first()["n"] == 44


INPUT = "pair_id long, match_id long, source_x double, source_y double, reference_x double, reference_y double, confidence double, elevation_m double, dem_valid boolean, physical boolean"


def test_one_bad_row_degrades_alone(spark):
    def projector(x, y, e):  # here, as workers can't import a test
        if e < 0:
            raise KeyError("below")
        return (float("nan"), 1.0) if e == 7 else (x + e, y)

    row = lambda i, conf, e, dem=True, phys=True: (1, i, 10.0, 12.0, 11.0, 12.0, conf, e, dem, phys)
    df = spark.createDataFrame([row(1, 0.9, 5.0), row(2, 0.5, 5.0), row(3, 0.5, -5.0), row(4, 0.5, 7.0), row(5, 0.5, 5.0, False), row(6, None, None, None, None), row(7, 0.5, None)], INPUT)
    got = {r["match_id"]: r for r in rf.refine_points(df, projector=projector).collect()}
    said = {i: (r["refinement_method"], r["reason"], r["status"]) for i, r in got.items()}
    assert said[1] == ("classical", "image_patches_not_supplied", "available") and said[2] == ("physical_dem", "physical_dem_projection_used", "available")
    assert said[3] == ("classical_fallback", "physical_projection_failed:KeyError", "retained") and said[4][1] == "physical_projection_failed:ValueError"
    assert said[5] == said[6] == ("classical_fallback", "image_patches_not_supplied", "retained") and said[7][1].startswith("physical_projection_failed:")
    assert (got[2]["refined_reference_x"], got[2]["physical_residual"]) == (15.0, 4.0) and got[3]["refined_reference_x"] == 11.0 and got[3]["physical_residual"] is None
    none = {r["match_id"]: r["reason"] for r in rf.refine_points(df).collect()}
    assert none[2] == "physical_projector_not_supplied" and none[1] == none[5] == "image_patches_not_supplied"


def test_images_and_acceptance(spark):
    image = R.uniform(0, 255, (48, 48))
    image = (image + np.roll(image, 1, 0) + np.roll(image, 1, 1)) / 3
    pixels = lambda a: spark.createDataFrame([(1, y, x, float(a[y, x])) for y in range(48) for x in range(48)], "pair_id long, y long, x long, v double")
    df = spark.createDataFrame([(1, 1, 24.0, 24.0, 24.0, 24.0, 0.9, None, False, False), (1, 2, 24.0, 24.0, 2.0, 24.0, 0.9, None, False, False), (1, 3, 24.0, 24.0, 24.0, 24.0, 0.1, 1.0, True, True)], INPUT)
    got = rf.refine_points(df, pixels(image), pixels(np.roll(image, (1, 2), (0, 1))), lambda x, y, e: (x + 2, y + 1))
    r = {x["match_id"]: x for x in got.collect()}
    assert r[1]["refinement_method"] == "classical_subpixel" and r[1]["reason"] == "phase_correlation_subpixel" and abs(r[1]["refined_reference_x"] - 26) < 0.5
    assert r[2]["reason"] == "boundary_or_invalid_patch" and r[2]["refined_reference_x"] == 2.0
    assert r[3]["refinement_method"] == "physics_dem_then_classical_subpixel" and abs(r[3]["refined_reference_x"] - 26) < 0.5 and r[3]["reference_x"] == 24.0
    models = spark.createDataFrame([(1, [1.0, 0.0, 2.0, 0.0, 1.0, 1.0, 0.0, 0.0, 1.0])], "pair_id long, h array<double>")
    moved = {x["match_id"]: x for x in rf.accepted(got, models, (48, 48), (48, 48)).collect()}
    assert moved[1]["accepted"] and moved[1]["reference_x"] == moved[1]["refined_reference_x"] != 24.0
    away = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])], "pair_id long, h array<double>")
    back = {x["match_id"]: x for x in rf.accepted(got, away, (48, 48), (48, 48)).collect()}
    assert not back[1]["accepted"] and back[1]["reference_x"] == 24.0
