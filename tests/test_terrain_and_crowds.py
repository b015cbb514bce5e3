"""Terrain tables (elevations, slopes, rays) and de-duplication of crowds, against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitweave.functions.projection import PolarStereographic
from orbitweave.operators import candidates as c
from orbitweave.operators import terrain as te

RADIUS = 1_737_400.0
WIDTH, HEIGHT, TIE, SCALE = 24, 18, (0.0, 0.0, 350.0, 10.0), (1.0, 0.5)
R = np.random.default_rng(11)
V = R.integers(-3000, 4000, (HEIGHT, WIDTH)).astype(float)
HOLES = {(3, 4), (9, 20), (17, 23)}


@pytest.fixture(scope="module")
def ground(spark):
    rows = [(y, x, float("nan") if (y, x) == (9, 20) else -1.0 if (y, x) in HOLES else float(RADIUS + V[y, x])) for y in range(HEIGHT) for x in range(WIDTH) if (y, x) != (17, 23)]
    return te.DegreeTerrain(spark.createDataFrame(rows, "y long, x long, v double"), TIE, SCALE, HEIGHT, WIDTH)


def looked_up(lat, lon):
    lon -= 360 * math.ceil((lon - TIE[2] - 180) / 360) if lon - TIE[2] > 180 else -360 * math.ceil((TIE[2] - lon - 180) / 360) if lon - TIE[2] < -180 else 0
    x, y = round((lon - TIE[2]) / SCALE[0]), round((TIE[3] - lat) / SCALE[1])
    if not (0 <= x < WIDTH and 0 <= y < HEIGHT):
        return None, "outside_dem_coverage", (y, x)
    return (None, "invalid_dem_value", (y, x)) if (y, x) in HOLES else (V[y, x], "ok", (y, x))


def sphere(o, d, radius):
    b, n = 2 * float(o @ d), float(o @ o) - radius * radius
    if b * b - 4 * n < 0:
        return None
    ts = [t for t in ((-b - math.sqrt(b * b - 4 * n)) / 2, (-b + math.sqrt(b * b - 4 * n)) / 2) if t > 0]
    return o + min(ts) * d if ts else None


def met(o, d):
    p = sphere(o, d, RADIUS)
    if p is None:
        return "unavailable", te.MISSES_SPHERE, None, 0
    for k in range(1, 13):
        lat, lon = math.degrees(math.asin(p[2] / np.linalg.norm(p))), math.degrees(math.atan2(p[1], p[0])) % 360
        e, why, _ = looked_up(lat, lon)
        if e is None:
            return "unavailable", why, None, k
        new = sphere(o, d, RADIUS + e)
        if new is None:
            return "unavailable", te.MISSES_SURFACE, None, k
        p, old = new, p
        if np.linalg.norm(p - old) < 1e-4:
            break
    return "valid", te.MEETS, p, k


def test_rays_meet_the_terrain(spark, ground):
    rays = []
    for i in range(300):
        la, lo, tilt = math.radians(R.uniform(0, 12)), math.radians(R.uniform(348, 376)), math.radians(R.uniform(0, 40) if i % 4 else 0)
        up, east = np.array([math.cos(la) * math.cos(lo), math.cos(la) * math.sin(lo), math.sin(la)]), np.array([-math.sin(lo), math.cos(lo), 0.0])
        rays.append((i, (RADIUS + 50_000) * up, -math.cos(tilt) * up + math.sin(tilt) * east))
    # along a tangent that low ground lets pass, and away from the sphere
    o = np.array([RADIUS - 0.5, -500_000.0, 50_000.0])
    rays += [(300, o, np.array([0.0, 1.0, 0.0])), (301, np.array([2e6, 0, 0]), np.array([1.0, 0, 0])), (302, np.array([2e6, 0, 0]), np.array([0, 1.0, 0]))]
    df = spark.createDataFrame([(i, *map(float, o), *map(float, d)) for i, o, d in rays] + [(303, None, 0.0, 0.0, 1.0, 0.0, 0.0)], "event_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    got = {r["event_id"]: r for r in te.ray_hits(df, ground).collect()}
    assert len(got) == 304 and got[303]["hit_status"] == "unavailable"
    statuses = set()
    for i, o, d in rays:
        status, reason, p, k = met(o, d)
        statuses.add(reason)
        g = got[i]
        assert (g["hit_status"], g["hit_reason"], g["hit_rounds"]) == (status, reason, k)
        assert (g["hit_x"] is None) == (p is None)
        if p is not None:
            assert (g["hit_x"], g["hit_y"], g["hit_z"]) == pytest.approx(p, abs=1e-3) and g["hit_elevation_m"] == pytest.approx(np.linalg.norm(p) - RADIUS, abs=1e-3)
    assert {te.MEETS, te.MISSES_SPHERE, "outside_dem_coverage"} <= statuses


def test_slopes(spark, ground):
    places = [(i, float(R.uniform(-1, 11)), float(R.uniform(348, 376))) for i in range(150)] + [(200 + i, 10 - 0.5 * (i % 18) + 0.25 + (i % 3 - 1) * 4e-5, 350.5 + i % 24 + (i % 5 - 2) * 3e-5) for i in range(150)] + [(500, None, 3.0), (501, float("nan"), 3.0)]
    df = spark.createDataFrame(places, "event_id long, lat double, lon double")
    near = {r["event_id"]: (r["north_slope"], r["east_slope"]) for r in te.Terrain.slopes(ground, df, "lat", "lon").collect()}
    around = {r["event_id"]: (r["north_slope"], r["east_slope"]) for r in ground.slopes(df, "lat", "lon").collect()}
    assert len(near) == len(around) == len(places) and near[500] == around[500] == near[501] == around[501] == (None, None)
    metre = RADIUS * math.pi / 180
    filled = 0
    for i, lat, lon in places[:-2]:
        s, n, w, e = (looked_up(*p)[0] for p in ((lat - 1e-4, lon), (lat + 1e-4, lon), (lat, lon - 1e-4), (lat, lon + 1e-4)))
        want = (None, None) if None in (s, n, w, e) else ((n - s) / (2e-4 * metre), (e - w) / (2e-4 * metre * math.cos(math.radians(lat))))
        assert near[i] == pytest.approx(want) if want[0] is not None else near[i] == want
        y, x = looked_up(lat, lon)[2]
        inner = 1 <= x < WIDTH - 1 and 1 <= y < HEIGHT - 1 and not any((y + a, x + b) in HOLES - {(3, 4)} for a in (-1, 0, 1) for b in (-1, 0, 1))
        z = lambda a, b: -1.0 - RADIUS if (a, b) == (3, 4) else V[a, b]  # noqa: E731  a value that is no elevation is still a number
        want = ((z(y + 1, x) - z(y - 1, x)) / (2 * metre * SCALE[1]), (z(y, x + 1) - z(y, x - 1)) / (2 * metre * math.cos(math.radians(lat)) * SCALE[0])) if inner else (None, None)
        assert around[i] == pytest.approx(want) if inner else around[i] == want
        filled += inner and near[i][0] is not None
    assert filled > 80


def test_a_map_is_a_terrain_too(spark):
    polar = PolarStereographic(1737.4, 0.5, 20.0, 20.0, 41, 41)
    dem = spark.range(41 * 41).select(F.floor(F.col("id") / 41).alias("y"), (F.col("id") % 41).alias("x"), F.lit(120.0).alias("v"))
    ground = te.MapTerrain(dem, polar, -1e4, 1e4, -9999.0)
    rays = spark.createDataFrame([(0.0, 0.0, 2e6, 0.0, 0.0, -1.0), (2e6, 0.0, 0.0, -1.0, 0.0, 0.0)], "ox double, oy double, oz double, dx double, dy double, dz double")
    got = {r["ox"]: r for r in te.ray_hits(rays, ground).collect()}
    assert got[0.0]["hit_z"] == pytest.approx(RADIUS + 120) and got[2e6]["hit_reason"] == "outside_dem_coverage"


def greedy(rows, radius):
    kept = np.zeros((0, 4))
    out = set()
    for r in sorted(rows, key=lambda r: (-r[6], r[1])):
        p = np.array(r[2:6])
        d = kept - p
        if not ((np.hypot(d[:, 0], d[:, 1]) <= radius) & (np.hypot(d[:, 2], d[:, 3]) <= radius)).any():
            kept = np.vstack([kept, p])
            out.add(r[1])
    return out


FIELDS = "pair_id long, match_id long, source_x double, source_y double, reference_x double, reference_y double, confidence double"


@pytest.mark.parametrize(("spread", "radius", "levels"), [(40.0, 3.0, 1000), (6.0, 3.0, 7), (100.0, 1.0, 3)])
def test_crowds_lose_all_but_the_greedy_choice(spark, spread, radius, levels):
    p = R.uniform(0, spread, (1200, 2))
    rows = [(1, i, float(a), float(b), float(1.1 * a + R.normal(0, 1)), float(b), float(R.integers(0, levels)) / levels) for i, (a, b) in enumerate(p)]
    got = {r["match_id"] for r in c.deduplicate(spark.createDataFrame(rows, FIELDS), radius).collect()}
    assert got == greedy(rows, radius)


def test_a_hundred_thousand_rows_of_one_cell_do_not_meet(spark):
    n = 100_000
    at = lambda k: F.lit(500.0) + (F.col("id") * k % 1009) / 1009.0
    rows = spark.range(n).select(F.lit(1).alias("pair_id"), F.col("id").alias("match_id"), at(7).alias("source_x"), at(11).alias("source_y"), at(13).alias("reference_x"), at(17).alias("reference_y"), (F.col("id") * 7919 % n / n).alias("confidence"))
    got = [r["match_id"] for r in c.deduplicate(rows, 3.0).collect()]
    assert got == [next(i for i in range(n) if i * 7919 % n == n - 1)]


def test_rows_without_a_place_match_nothing(spark):
    rows = [(1, 1, 1.0, 1.0, 1.0, 1.0, 0.9), (1, 2, 1.0, 1.0, 1.0, 1.0, 0.8), (1, 3, None, 1.0, 1.0, 1.0, 0.7), (1, 4, 1.0, float("nan"), 1.0, 1.0, 0.7), (1, 5, 1.0, 1.0, 1.0, 1.0, None), (2, 2, 1.0, 1.0, 1.0, 1.0, 0.8)]
    got = {(r["pair_id"], r["match_id"]) for r in c.deduplicate(spark.createDataFrame(rows, FIELDS)).collect()}
    assert got == {(1, 1), (1, 3), (1, 4), (1, 5), (2, 2)}
    assert c.deduplicate(spark.createDataFrame([], FIELDS)).count() == 0
