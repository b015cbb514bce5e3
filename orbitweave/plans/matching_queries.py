"""Queries that match: tiles of images, the search for a working scale, refinement; and the store of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitweave.operators import candidates as c
from orbitweave.operators import refinement as rf
from orbitweave.operators import robust as rb
from orbitweave.operators import run_store
from orbitweave.operators import tiled
from orbitweave.plans import registration as rg
from orbitweave.plans.catalogue import BOUNDS, TILES, known_scored, q, query, r
from orbitweave.plans.views import ctes, view
from orbitweave.storage import fresh_folder

#: Descriptors with places: the reference image shows the same ones, shrunk, with noise that hides every fifth.
KEYPOINTS = """
SELECT vec_id AS id, vec_id % 3 AS pair_id, CAST((vec_id * 7919) % 1021 AS DOUBLE) AS x, CAST((vec_id * 104729) % 1000 AS DOUBLE) AS y, embedding,
       0.85E0 * CAST((vec_id * 7919) % 1021 AS DOUBLE) + 5.0E0 + CAST(vec_id % 3 - 1 AS DOUBLE) * 0.5E0 AS rx, 0.78E0 * CAST((vec_id * 104729) % 1000 AS DOUBLE) + 3.0E0 AS ry,
       CASE WHEN vec_id % 5 = 0 THEN 0.05E0 ELSE 0.01E0 END AS noise
FROM embeddings"""
TO_REFERENCE = [0.85, 0.0, 5.0, 0.0, 0.78, 3.0, 0.0, 0.0, 1.0]
DISTANCE = "sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
SQUARE = lambda a, b, x, y: f"(({a}{x} - {b}{x}) * ({a}{x} - {b}{x}) + ({a}{y} - {b}{y}) * ({a}{y} - {b}{y}))"


def passing(name: str, a: str, b: str) -> str:
    """Descriptors of a whose nearest of b passes the ratio test, in each tile."""
    return f"""{name} AS (SELECT pair_id, tile, id, max(other) FILTER (k = 1) AS other, 1 / (1 + max(d) FILTER (k = 1)) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, tile, id ORDER BY d, other) AS k
  FROM (SELECT a.pair_id, a.tile, a.id, b.id AS other, {DISTANCE} AS d FROM {a} a JOIN {b} b ON a.pair_id = b.pair_id AND a.tile = b.tile)) WHERE k <= 2
 GROUP BY pair_id, tile, id HAVING max(d) FILTER (k = 1) < 0.75 * max(d) FILTER (k = 2))"""


GREEDY = f"""o AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY confidence DESC, match_id) AS n FROM m),
g AS (SELECT DISTINCT pair_id, 0::BIGINT AS n, CAST([] AS STRUCT(x DOUBLE, y DOUBLE, rx DOUBLE, ry DOUBLE)[]) AS kept, NULL::BIGINT AS match_id FROM m
 UNION ALL SELECT pair_id, n, CASE WHEN fits THEN list_append(kept, spot) ELSE kept END, CASE WHEN fits THEN id END FROM (
  SELECT g.pair_id, o.n, g.kept, {{'x': o.x, 'y': o.y, 'rx': o.rx, 'ry': o.ry}} AS spot, o.match_id AS id,
   len(list_filter(g.kept, lambda p: sqrt({SQUARE('p.', 'o.', 'x', 'y')}) <= 3.0E0 AND sqrt({SQUARE('p.', 'o.', 'rx', 'ry')}) <= 3.0E0)) = 0 AS fits
  FROM g JOIN o ON o.pair_id = g.pair_id AND o.n = g.n + 1))"""


@query(f"""WITH RECURSIVE {TILES}, kp AS ({KEYPOINTS}),
box AS (SELECT *, greatest(0, floor(0.85E0 * x0 + 5.0E0 - pad))::INT AS rx0, greatest(0, floor(0.78E0 * y0 + 3.0E0 - pad))::INT AS ry0, least(900, ceil(0.85E0 * (x1 - 1) + 5.0E0 + pad)::INT + 1) AS rx1, least(800, ceil(0.78E0 * (y1 - 1) + 3.0E0 + pad)::INT + 1) AS ry1
 FROM (SELECT *, greatest(12.0E0, 0.15E0 * greatest(x1 - x0, y1 - y0)) AS pad FROM tiles)),
s AS (SELECT pair_id, tile, id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM kp JOIN box ON x >= x0 AND x < x1 AND y >= y0 AND y < y1),
t AS (SELECT pair_id, tile, id, list_transform(list_zip(embedding, range(len(embedding))), lambda z: z[1]::DOUBLE + ((id * 31 + z[2] * 17) % 13 - 6)::DOUBLE * noise) AS e FROM kp JOIN box ON rx >= rx0 AND rx < rx1 AND ry >= ry0 AND ry < ry1),
{passing('f', 's', 't')}, {passing('b', 't', 's')},
near AS (SELECT f.pair_id, f.tile, f.id, f.other, least(f.confidence, b.confidence) AS confidence, p.x, p.y, h.rx, h.ry, back.x AS bx, back.y AS by_,
  row_number() OVER (PARTITION BY f.pair_id, f.tile, f.id ORDER BY sqrt({SQUARE('h.', 'k.', 'rx', 'ry')}), b.id) AS n
 FROM f JOIN kp p ON p.id = f.id JOIN kp h ON h.id = f.other JOIN b ON b.pair_id = f.pair_id AND b.tile = f.tile JOIN kp k ON k.id = b.id JOIN kp back ON back.id = b.other WHERE sqrt({SQUARE('h.', 'k.', 'rx', 'ry')}) <= 8.0E0),
m AS (SELECT pair_id, tile, id AS source_id, other AS reference_id, confidence, x, y, rx, ry, id * 7 + tile AS match_id FROM near WHERE n = 1 AND sqrt((x - bx) * (x - bx) + (y - by_) * (y - by_)) <= 8.0E0),
{GREEDY}
SELECT m.pair_id, m.match_id, m.tile, m.source_id, m.reference_id, {q('m.x')} AS source_x, {q('m.rx')} AS reference_x, {q('m.confidence')} AS confidence FROM g JOIN m ON m.pair_id = g.pair_id AND m.match_id = g.match_id""")
def q_tiled_matches(spark, sf_dir):
    kp = spark.sql(KEYPOINTS.replace("FROM embeddings", "FROM {e}"), e=view(spark, sf_dir, "embeddings"))
    moved = F.transform("embedding", lambda v, i: v.cast("double") + ((F.col("id") * 31 + i * 17) % 13 - 6).cast("double") * F.col("noise"))
    reference = kp.select("pair_id", "id", F.col("rx").alias("x"), F.col("ry").alias("y"), moved.alias("embedding"))
    boxes = c.search_boxes(c.tiles(spark, 1000, 1021, (2, 3)), (1000, 1021), (800, 900), TO_REFERENCE)
    got = tiled.tiled_matches(kp.select("pair_id", "id", "x", "y", "embedding"), reference, tiled.boxes_of_pairs(kp, boxes), 6)
    return got.select("pair_id", "match_id", "tile", "source_id", "reference_id", r("source_x").alias("source_x"), r("reference_x").alias("reference_x"), r("confidence").alias("confidence"))


#: Attempts 1 to 3 of each pair: later ones lose fewer of the right matches, by as much as the pair decides.
ATTEMPTS = """
SELECT pair_id, attempt, match_id, event_type, source_x, source_y, reference_x, reference_y, confidence
FROM {corr} CROSS JOIN (SELECT explode(array(1, 2, 3)) AS attempt)
WHERE event_type = 'error' OR (match_id + pair_id) % 8 < 2 * attempt + pair_id % 4 - 1"""


@query(f"""{ctes('corr')}, rows AS ({ATTEMPTS.format(corr='corr').replace('SELECT explode(array(1, 2, 3))', 'SELECT unnest([1, 2, 3])')}),
a AS (SELECT pair_id, attempt, count(*) AS candidates, count(*) FILTER (event_type <> 'error') AS inliers FROM rows WHERE {BOUNDS.format(2048)} GROUP BY ALL),
u AS (SELECT *, inliers >= 12 AND inliers / candidates >= 0.75 AS sufficient FROM a),
e AS (SELECT *, coalesce(min(attempt) FILTER (sufficient) OVER (PARTITION BY pair_id), 3) AS last FROM u)
SELECT pair_id, attempt, candidates, inliers, {q('inliers / candidates')} AS inlier_ratio, sufficient, last AS attempts_made FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY inliers DESC, inliers / candidates DESC, attempt) AS k FROM e WHERE attempt <= last) WHERE k = 1""")
def q_scale_search(spark, sf_dir):
    rows = spark.sql(ATTEMPTS, corr=view(spark, sf_dir, "corr")).drop("event_type")
    scale = lambda attempt: F.lit(0.25) * F.col(attempt)  # noqa: E731  working scales 0.25, 0.5, 0.75 of both images
    working = rows.withColumns({x: F.col(x) * scale("attempt") for x in c.POINTS}).withColumns({"source_scale": scale("attempt"), "reference_scale": scale("attempt")})
    found = rg.search_scales(working, rg.Settings((2048, 2048), (2048, 2048), noise=0.5))
    return found.chosen.select("pair_id", "attempt", "candidates", "inliers", r("inlier_ratio").alias("inlier_ratio"), "sufficient", "attempts_made")


def predicted(x: float, y: float, elevation: float) -> tuple[float, float]:
    """Where a point is by terrain and camera; for some places there is no answer."""
    if elevation > 1500:
        raise ArithmeticError("too high")
    return (x * 1.02 + 0.01 * y + 5.0 + 100.0 / (elevation // 100 - 3), 0.98 * y - 0.01 * x - 3.0)  # a pole at 300 m


WHY = "CASE WHEN branch <> 'dem_physical' THEN 'image_patches_not_supplied' WHEN elevation > 1500 THEN 'physical_projection_failed:ArithmeticError' WHEN elevation // 100 = 3 THEN 'physical_projection_failed:ZeroDivisionError' ELSE 'physical_dem_projection_used' END"
RIGHT = "1.02E0 * source_x + 0.01E0 * source_y + 5.0E0", "0.98E0 * source_y - 0.01E0 * source_x - 3.0E0"


@query(f"""{ctes('corr')}, b AS (SELECT *, match_id * 37 % 2000 AS elevation, CASE WHEN confidence >= 0.75 THEN 'classical' WHEN match_id % 3 <> 0 AND match_id % 7 <> 0 THEN 'dem_physical' ELSE 'classical_fallback' END AS branch FROM corr),
w AS (SELECT *, {WHY} AS reason FROM b), p AS (SELECT *, reason = 'physical_dem_projection_used' AS used, {RIGHT[0]} + CASE WHEN reason = 'physical_dem_projection_used' THEN 100.0E0 / (elevation // 100 - 3) END AS px, {RIGHT[1]} AS py FROM w)
SELECT match_id, {q('CASE WHEN used THEN px ELSE reference_x END')} AS refined_reference_x, {q('CASE WHEN used THEN py ELSE reference_y END')} AS refined_reference_y, {q('CASE WHEN used THEN sqrt((px - reference_x) * (px - reference_x) + (py - reference_y) * (py - reference_y)) END')} AS physical_residual,
 CASE WHEN used THEN 'physical_dem' WHEN branch = 'classical' THEN 'classical' ELSE 'classical_fallback' END AS refinement_method, used AS physical_geometry_used, CASE WHEN used OR branch = 'classical' THEN 'available' ELSE 'retained' END AS status, reason FROM p""")
def q_refine_points(spark, sf_dir):
    i = F.col("match_id")
    rows = view(spark, sf_dir, "corr").withColumns({"elevation_m": (i * 37 % 2000).cast("double"), "dem_valid": i % 3 != 0, "physical": i % 7 != 0})
    got = rf.refine_points(rows, projector=predicted)
    return got.select("match_id", *(r(x).alias(x) for x in ("refined_reference_x", "refined_reference_y", "physical_residual")), "refinement_method", "physical_geometry_used", "status", "reason")


# inliers are moved to where another model has them, which both new models must find
@query(f"""{ctes('corr')}, e AS (SELECT *, sqrt(({RIGHT[0]} - reference_x) * ({RIGHT[0]} - reference_x) + ({RIGHT[1]} - reference_y) * ({RIGHT[1]} - reference_y)) <= 3.0 AS inlier FROM corr)
SELECT pair_id, count(*) FILTER (inlier) AS n_fit, 1.02E0 AS h0, 5.25E0 AS h2, 0.98E0 AS h4, -3.5E0 AS h5 FROM e GROUP BY pair_id HAVING count(*) FILTER (inlier) >= 4""")
def q_refit(spark, sf_dir):
    rows = known_scored(spark, sf_dir)
    moved = rows.withColumns({"reference_x": F.lit(1.02) * F.col("source_x") + F.lit(0.01) * F.col("source_y") + F.lit(5.25), "reference_y": F.lit(0.98) * F.col("source_y") - F.lit(0.01) * F.col("source_x") - F.lit(3.5)})
    got = rb.refit(moved.drop("reprojection_error", "threshold")).where(F.col("h").isNotNull())
    return got.select("pair_id", "n_fit", *(r(F.col("h")[k], 4).alias(f"h{k}") for k in (0, 2, 4, 5)))


@query(f"""{ctes('runs')} SELECT run_id, status, {q('total_seconds')} AS total_seconds, strftime(created_at, '%Y-%m') AS month FROM runs""")
def q_run_store(spark, sf_dir):
    # all runs, in two appends that overlap, and once more: each is stored once
    runs = view(spark, sf_dir, "runs")
    path = fresh_folder(spark, "store")
    for part in (runs.where("status <> 'failed'"), runs, runs):
        run_store.append(part, path)
    return run_store.read(spark, path, runs.schema).select("run_id", "status", r("total_seconds").alias("total_seconds"), F.date_format("month", "yyyy-MM").alias("month"))
