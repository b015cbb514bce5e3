"""Queries on the terrain: elevations, slopes and ray intersections on one raster made of all pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitweave.operators.terrain import DegreeTerrain, Terrain
from orbitweave.plans.catalogue import q, query, r
from orbitweave.plans.views import ctes, view

#: Pixel (0, 0) is at 30 east, 20 north; 0.125 degrees a pixel, 256 pixels wide, as many rows as there are images for.
TIE, SCALE, WIDTH, HEIGHT = (0.0, 0.0, 30.0, 20.0), (0.125, 0.125), 256, 1_000_000
RADIUS = "1737400.0E0"


def terrain(spark, sf_dir) -> DegreeTerrain:
    return DegreeTerrain(view(spark, sf_dir, "terrain"), TIE, SCALE, HEIGHT, WIDTH)


def pixel(lat: str, lon: str) -> tuple[str, str]:
    """Nearest pixel of a place, and whether it is on the raster."""
    px, py = f"round_even((({lon}) - 30.0E0) / 0.125E0 + 0.0E0, 0)::BIGINT", f"round_even((20.0E0 - ({lat})) / 0.125E0 + 0.0E0, 0)::BIGINT"
    return px, py


def sphere(radius: str) -> str:
    """How far along a ray a sphere is met."""
    b, disc = "(2.0E0 * (ox * dx + oy * dy + oz * dz))", "(b * b - 4.0E0 * (ox * ox + oy * oy + oz * oz - ({r}) * ({r})))"
    disc = disc.replace("b * b", f"{b} * {b}").format(r=radius)
    near, far = f"((-{b} - sqrt({disc})) / 2.0E0)", f"((-{b} + sqrt({disc})) / 2.0E0)"
    return f"CASE WHEN {disc} >= 0 THEN CASE WHEN {near} > 0 THEN {near} WHEN {far} > 0 THEN {far} END END"


PLACE = "degrees(asin(greatest(-1.0E0, least(1.0E0, z / sqrt(x * x + y * y + z * z))))) AS lat, CASE WHEN degrees(atan2(y, x)) < 0 THEN degrees(atan2(y, x)) + 360.0E0 ELSE degrees(atan2(y, x)) END AS lon"
MOVED = "ox + t * dx AS x, oy + t * dy AS y, oz + t * dz AS z"
RAY = "event_id, ox, oy, oz, dx, dy, dz"


@query(f"""{ctes('rays', 'terrain').replace('WITH', 'WITH RECURSIVE', 1)},
s AS (SELECT {RAY}, 0 AS k, x, y, z, CASE WHEN t IS NULL THEN 'camera_ray_misses_lunar_reference_sphere' ELSE 'open' END AS state FROM (SELECT *, {MOVED} FROM (SELECT *, {sphere(RADIUS)} AS t FROM rays))
 UNION ALL
 SELECT {RAY}, k + 1, CASE WHEN ok THEN nx END, CASE WHEN ok THEN ny END, CASE WHEN ok THEN nz END,
  CASE WHEN NOT ok THEN why WHEN nx IS NULL THEN 'ray_misses_dem_surface' WHEN sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y) + (nz - z) * (nz - z)) < 1e-4 OR k = 11 THEN 'dem_intersection' ELSE 'open' END
 FROM (SELECT *, ox + t * dx AS nx, oy + t * dy AS ny, oz + t * dz AS nz FROM (SELECT *, {sphere(RADIUS + ' + (v - ' + RADIUS + ')')} AS t
  FROM (SELECT p.*, m.v, coalesce(m.v > 0, false) AS ok, CASE WHEN px >= 0 AND px < {WIDTH} AND py >= 0 AND py < {HEIGHT} THEN 'invalid_dem_value' ELSE 'outside_dem_coverage' END AS why
   FROM (SELECT *, {pixel('lat', 'lon')[0]} AS px, {pixel('lat', 'lon')[1]} AS py FROM (SELECT *, {PLACE} FROM s WHERE state = 'open')) p LEFT JOIN terrain m ON m.x = p.px AND m.y = p.py))))
SELECT event_id, {q('x', 3)} AS hit_x, {q('z', 3)} AS hit_z, CASE WHEN state = 'dem_intersection' THEN {q('sqrt(x * x + y * y + z * z) - ' + RADIUS, 3)} END AS hit_elevation_m, k AS hit_rounds, CASE WHEN state = 'dem_intersection' THEN 'valid' ELSE 'unavailable' END AS hit_status, state AS hit_reason
FROM (SELECT * EXCLUDE (x, y, z), CASE WHEN state = 'dem_intersection' THEN x END AS x, CASE WHEN state = 'dem_intersection' THEN y END AS y, CASE WHEN state = 'dem_intersection' THEN z END AS z FROM s) WHERE state <> 'open'""")
def q_ray_dem(spark, sf_dir):
    from orbitweave.operators.terrain import ray_hits

    got = ray_hits(view(spark, sf_dir, "rays"), terrain(spark, sf_dir))
    return got.select("event_id", r("hit_x", 3).alias("hit_x"), r("hit_z", 3).alias("hit_z"), r("hit_elevation_m", 3).alias("hit_elevation_m"), "hit_rounds", "hit_status", "hit_reason")


#: Places a little beside the edges of pixels, some of them off the raster.
PLACES = "SELECT event_id, 19.9375E0 - CAST(event_id % 70 AS DOUBLE) * 0.125E0 + CAST(event_id % 3 - 1 AS DOUBLE) * 0.00005E0 AS lat, 29.9375E0 + CAST((event_id * 7919) % 263 AS DOUBLE) * 0.125E0 + CAST(event_id % 5 - 2 AS DOUBLE) * 0.00003E0 AS lon FROM events"
METRES = "(2.0E0 * {step} * pi() / 180 * 1737400)"


def places(spark, sf_dir):
    return spark.sql(PLACES.replace("FROM events", "FROM {e}"), e=view(spark, sf_dir, "events"))


@query(f"""{ctes('terrain')}, p AS ({PLACES}), n AS (SELECT event_id, lat, {pixel('lat', 'lon')[0]} AS px, {pixel('lat', 'lon')[1]} AS py FROM p),
w AS (SELECT n.event_id, count(*) AS n, max(v) FILTER (y = py + 1 AND x = px) AS below, max(v) FILTER (y = py - 1 AND x = px) AS above, max(v) FILTER (y = py AND x = px + 1) AS east, max(v) FILTER (y = py AND x = px - 1) AS west
 FROM n JOIN terrain ON x BETWEEN px - 1 AND px + 1 AND y BETWEEN py - 1 AND py + 1 WHERE px >= 1 AND py >= 1 AND px < {WIDTH - 1} AND py < {HEIGHT - 1} GROUP BY n.event_id)
SELECT event_id, CASE WHEN w.n = 9 THEN {q('(below - above) / ' + METRES.format(step='0.125E0'))} END AS north_slope, CASE WHEN w.n = 9 THEN {q('(east - west) / (' + METRES.format(step='0.125E0') + ' * cos(radians(lat)))')} END AS east_slope FROM n LEFT JOIN w USING (event_id)""")
def q_dem_slopes(spark, sf_dir):
    got = terrain(spark, sf_dir).slopes(places(spark, sf_dir), "lat", "lon")
    return got.select("event_id", r("north_slope").alias("north_slope"), r("east_slope").alias("east_slope"))


def probe(name: str, lat: str, lon: str) -> str:
    px, py = pixel(lat, lon)
    return f"LEFT JOIN (SELECT y, x, v FROM terrain WHERE v > 0) {name} ON {name}.x = {px} AND {name}.y = {py}"


@query(f"""{ctes('terrain')}, p AS ({PLACES}), f AS (SELECT event_id, lat, s.v AS s, n.v AS n, w.v AS w, e.v AS e FROM p {probe('s', 'lat + -0.0001E0', 'lon')} {probe('n', 'lat + 0.0001E0', 'lon')} {probe('w', 'lat', 'lon + -0.0001E0')} {probe('e', 'lat', 'lon + 0.0001E0')})
SELECT event_id, CASE WHEN s + n + w + e IS NOT NULL THEN {q('(n - s) / ' + METRES.format(step='0.0001E0'))} END AS north_slope, CASE WHEN s + n + w + e IS NOT NULL THEN {q('(e - w) / (' + METRES.format(step='0.0001E0') + ' * cos(radians(lat)))')} END AS east_slope FROM f""")
def q_point_slopes(spark, sf_dir):
    got = Terrain.slopes(terrain(spark, sf_dir), places(spark, sf_dir), "lat", "lon")
    return got.select("event_id", r("north_slope").alias("north_slope"), r("east_slope").alias("east_slope"))
