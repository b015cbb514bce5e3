"""Further registered queries: operators of the inventory that the catalogue's views do not reach by
themselves, each over a whole table, with SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitweave.functions import camera as cam
from orbitweave.functions import geometry as g
from orbitweave.functions import projection as pr
from orbitweave.functions import text as t
from orbitweave.operators import candidates as c
from orbitweave.operators import lookups as lk
from orbitweave.operators import rasters as ra
from orbitweave.plans.catalogue import CAMERA, MAP, q, query, r
from orbitweave.plans.registration import physical_validation
from orbitweave.plans.views import TRUE_H, ctes, view
from orbitweave.sources import orbit

SCALES = "SELECT event_id, CAST(event_id % 5 - 1 AS DOUBLE) * 0.25E0 AS s, CAST(event_id % 3 AS DOUBLE) * 0.4E0 AS t FROM events"


@query(f"WITH x AS ({SCALES}) SELECT event_id, {q('greatest(2.0E0, 2.5E0 * coalesce(greatest(CASE WHEN s > 0 THEN 1 / s END, CASE WHEN t > 0 THEN 1 / t END), 1.0E0))')} AS threshold FROM x")
def q_native_threshold(spark, sf_dir):
    i = F.col("event_id")
    s, other = (i % 5 - 1).cast("double") * F.lit(0.25), (i % 3).cast("double") * F.lit(0.4)
    return view(spark, sf_dir, "events").select("event_id", r(g.native_threshold(s, other)).alias("threshold"))


@query(f"""WITH u AS (SELECT DISTINCT user_id, 0.25E0 + (user_id % 4) * 0.25E0 AS s, 0.5E0 + (user_id % 3) * 0.25E0 AS t FROM events)
SELECT user_id, {q('1.02E0 / s * t')} AS h0, {q('5.0E0 * t')} AS h2, {q('-0.01E0 / s * t')} AS h3, {q('-3.0E0 * t')} AS h5, true AS inverse FROM u""")
def q_working_homography(spark, sf_dir):
    u = view(spark, sf_dir, "events").select("user_id").distinct()
    s, ref = F.lit(0.25) + (F.col("user_id") % 4) * F.lit(0.25), F.lit(0.5) + (F.col("user_id") % 3) * F.lit(0.25)
    u = u.withColumn("h", g.working_homography(TRUE_H, (s, s), (ref, ref)))
    back = g.compose_scales(F.col("h"), (s, s), (ref, ref))
    same = F.forall(F.arrays_zip(back.alias("a"), F.array(*map(F.lit, TRUE_H)).alias("b")), lambda x: F.abs(x["a"] - x["b"]) < 1e-9)
    return u.select("user_id", *(r(F.col("h")[k]).alias(f"h{k}") for k in (0, 2, 3, 5)), same.alias("inverse"))


@query(f"""{ctes('corr')} SELECT match_id, {q('source_x / 0.4E0 * 0.5E0')} AS native_x, {q('reference_y / 0.25E0 * 1.5E0')} AS native_y, {q('source_x')} AS back_x, {q('source_x + match_id % 7')} AS shifted_x FROM corr""")
def q_native_working(spark, sf_dir):
    rows = view(spark, sf_dir, "corr")
    native = g.to_native(F.col("source_x"), 0.4, 0.5)
    moved = c.shifted(rows.select("match_id", "source_x", "source_y"), F.col("match_id") % 7, F.lit(0)).select(F.col("match_id").alias("_id"), F.col("source_x").alias("shifted_x"))
    return rows.join(moved, F.col("match_id") == F.col("_id")).select("match_id", r(native).alias("native_x"), r(g.to_native(F.col("reference_y"), 0.25, 1.5)).alias("native_y"), r(g.to_working(native, 0.4, 0.5)).alias("back_x"), r("shifted_x").alias("shifted_x"))


@query("""WITH x AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN NULL WHEN 3 THEN '-inf'::DOUBLE ELSE value END AS v FROM events) SELECT event_id, coalesce(isfinite(v), false) AS finite FROM x""")
def q_finite(spark, sf_dir):
    i = F.col("event_id") % 6
    v = F.when(i == 0, float("nan")).when(i == 1, float("inf")).when(i == 2, None).when(i == 3, float("-inf")).otherwise(F.col("value"))
    return view(spark, sf_dir, "events").select("event_id", F.coalesce(g.finite(v), F.lit(False)).alias("finite"))


# the ray through the pixel of known undistorted coordinates has their direction, turned as the camera is
UV = "SELECT match_id, (source_x - 512) / 1200 AS u, (source_y - 500) / 1190 AS v FROM corr"


@query(f"""{ctes('corr')}, n AS ({UV}) SELECT match_id, {q('u / sqrt(u * u + v * v + 1)')} AS dx, {q('-v / sqrt(u * u + v * v + 1)')} AS dy, {q('-1 / sqrt(u * u + v * v + 1)')} AS dz FROM n""")
def q_pixel_ray(spark, sf_dir):
    down = F.array(*(F.lit(float(x)) for x in (1, 0, 0, 0, -1, 0, 0, 0, -1)))
    rows = view(spark, sf_dir, "corr").withColumns({"u": (F.col("source_x") - 512) / 1200, "v": (F.col("source_y") - 500) / 1190})
    px, py = cam.distort(F.col("u"), F.col("v"), CAMERA.distortion)
    rows = rows.withColumns({"px": px * F.lit(CAMERA.fx) + F.lit(CAMERA.cx), "py": py * F.lit(CAMERA.fy) + F.lit(CAMERA.cy)})
    ray = cam.pixel_ray(F.col("px"), F.col("py"), down, CAMERA)
    return rows.withColumns({f"_d{k}": x for k, x in enumerate(ray)}).select("match_id", *(r(f"_d{k}").alias(n) for k, n in enumerate(("dx", "dy", "dz"))))


@query("""WITH x AS (SELECT event_id, event_id % 4 AS k, CAST(event_id % 360 AS DOUBLE) AS a FROM events) SELECT event_id, k < 2 AS rotation FROM x""")
def q_is_rotation(spark, sf_dir):
    k, a = F.col("event_id") % 4, F.radians((F.col("event_id") % 360).cast("double"))
    one, none = F.lit(1.0), F.lit(0.0)
    turn = F.array(F.cos(a), -F.sin(a), none, F.sin(a), F.cos(a), none, none, none, one)
    tilt = F.array(one, none, none, none, F.cos(a), F.sin(a), none, -F.sin(a), F.cos(a))
    mirror = F.array(F.cos(a), F.sin(a), none, F.sin(a), -F.cos(a), none, none, none, one)
    return view(spark, sf_dir, "events").select("event_id", cam.is_rotation(F.when(k == 0, turn).when(k == 1, tilt).when(k == 2, mirror).otherwise(F.transform(turn, lambda x: x * 1.01))).alias("rotation"))


@query(f"""{ctes('corr')}, p AS (SELECT match_id, source_x * 5 - 500 AS x, source_y * 5 - 500 AS y FROM corr) SELECT match_id, x >= 0 AND x < 4001 AND y >= 0 AND y < 4001 AS inside, true AS returns FROM p""")
def q_map_contains(spark, sf_dir):
    x, y = F.col("source_x") * 5 - 500, F.col("source_y") * 5 - 500
    rows = view(spark, sf_dir, "corr")
    return rows.select("match_id", MAP.contains(x, y).alias("inside"), (MAP.pixel_residual(x, y) < 1e-6).alias("returns"))


@query(f"""{ctes('angles')}, e AS (SELECT event_id, lat, lon, CASE WHEN event_id % 4 <> 0 THEN elevation END AS e FROM angles)
SELECT event_id, e IS NOT NULL AS valid, CASE WHEN e IS NULL THEN CASE WHEN event_id % 8 = 0 THEN 'dem_out_of_bounds' ELSE 'elevation_unavailable' END END AS reason, {q('(1737400.0E0 + e) * cos(radians(lat)) * cos(radians(lon))', 3)} AS x, {q('(1737400.0E0 + e) * sin(radians(lat))', 3)} AS z FROM e""")
def q_terrain_point(spark, sf_dir):
    i = F.col("event_id")
    p = pr.terrain_point(F.col("lat"), F.col("lon"), F.when(i % 4 != 0, F.col("elevation")), F.when(i % 8 == 0, "dem_out_of_bounds").otherwise("elevation_unavailable"))
    return view(spark, sf_dir, "angles").withColumn("p", p).select("event_id", "p.valid", "p.reason", r(F.col("p")["x"], 3).alias("x"), r(F.col("p")["z"], 3).alias("z"))


@query(f"""{ctes('angles')} SELECT event_id, {q('(elevation - ref) / (2 * 0.0001E0 * pi() / 180 * 1737400)')} AS north, {q('(ref - elevation) / (2 * 0.0001E0 * pi() / 180 * 1737400 * cos(radians(lat)))')} AS east FROM angles""")
def q_latlon_gradient(spark, sf_dir):
    north, east = ra.latlon_gradient(F.col("elevation"), F.col("ref"), F.col("ref"), F.col("elevation"), F.col("lat"))
    return view(spark, sf_dir, "angles").select("event_id", r(north).alias("north"), r(east).alias("east"))


#: Where each field stands (first character from 1, length), whole lines being digits that tell their place.
FIELDS = {"lunar_x_km": (47, 20), "vz": (191, 12), "body_qx": (203, 14), "earth_qw": (301, 14), "moon_qz": (343, 14), "sub_latitude": (371, 14), "altitude_km": (455, 12), "emission_angle": (480, 9), "slant_range_km": (507, 10), "yaw": (540, 16), "pitch": (572, 16)}
WHOLE = "concat('ORBTATTD', lpad(CAST(event_id AS {text}), 6, ' '), '    ', '2024', '   2', lpad(CAST(1 + event_id % 28 AS {text}), 4, ' '), '   3   4   5 678', {rest})"
REST = "repeat(concat(' ', lpad(CAST(event_id % 90 AS {text}), 2, '0'), '.5', ' 7 1.25 -3'), 40)"


@query("WITH l AS (SELECT event_id, rpad(substring(" + WHOLE.format(text="VARCHAR", rest=REST.format(text="VARCHAR")) + ", 1, CASE WHEN event_id % 9 = 0 THEN 500 ELSE 587 END), CASE WHEN event_id % 9 = 0 THEN 500 ELSE 587 END, ' ') AS line FROM events) SELECT event_id, length(line) = 587 AS valid, CASE WHEN length(line) = 587 THEN trim(substring(line, 9, 6))::INT END AS record_number, "
       + ", ".join(f"CASE WHEN length(line) = 587 THEN try_cast(trim(substring(line, {a}, {n})) AS DOUBLE) END AS {x}" for x, (a, n) in FIELDS.items()) + " FROM l")
def q_orbit_record(spark, sf_dir):
    line = F.expr("rpad(substring(" + WHOLE.format(text="STRING", rest=REST.format(text="STRING")) + ", 1, CASE WHEN event_id % 9 = 0 THEN 500 ELSE 587 END), CASE WHEN event_id % 9 = 0 THEN 500 ELSE 587 END, ' ')")
    rows = view(spark, sf_dir, "events").select("event_id", line.alias("line"))
    return orbit.parse(rows, "line").select("event_id", "valid", "record_number", *FIELDS)


@query("SELECT user_id, arg_max(event_id, event_id) AS last_event, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def q_last_by_key(spark, sf_dir):
    rows = view(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return lk.last_by_key(rows, "user_id", "event_id").select("user_id", F.col("event_id").alias("last_event"), "event_type")


@query("""WITH p AS (SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN '/m/data/c/data/x_d_img_' || p_partkey || '.png' WHEN 1 THEN '/a.b/data/y_d_img_d18.IMG' WHEN 2 THEN '/x/y.png' WHEN 3 THEN 'c:\\u\\photo.TIFF' WHEN 4 THEN 'noext' ELSE '/d/e.tar.gz' END AS path, CASE p_partkey % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'IMAGE/JPEG' WHEN 2 THEN 'text/x' END AS kind FROM part)
SELECT k, CASE k % 6 WHEN 0 THEN '/m/data/c/geometry/x_g_grd_' || k || '.csv' WHEN 1 THEN '/a.b/geometry/y_g_grd_d18.csv' END AS grid, CASE k % 6 WHEN 0 THEN '/m/data/c/data/x_d_img_' || k || '.xml' WHEN 1 THEN '/a.b/data/y_d_img_d18.xml' WHEN 2 THEN '/x/y.xml' WHEN 3 THEN 'c:\\u\\photo.xml' WHEN 4 THEN 'noext' ELSE '/d/e.tar.xml' END AS label,
 CASE WHEN k % 6 IN (0, 2) THEN '.png' WHEN k % 6 = 1 THEN '.img' WHEN k % 6 = 3 THEN '.tiff' WHEN kind = 'image/png' THEN '.png' WHEN kind = 'IMAGE/JPEG' THEN '.jpg' ELSE '.bin' END AS suffix,
 CASE k % 6 WHEN 0 THEN 'x_d_img_' || k WHEN 1 THEN 'y_d_img_d18' WHEN 2 THEN 'y' WHEN 3 THEN 'photo' WHEN 4 THEN 'noext' ELSE 'e.tar' END AS stem FROM p""")
def q_paths(spark, sf_dir):
    k = F.col("p_partkey")
    path = F.when(k % 6 == 0, F.concat(F.lit("/m/data/c/data/x_d_img_"), k.cast("string"), F.lit(".png"))).when(k % 6 == 1, "/a.b/data/y_d_img_d18.IMG").when(k % 6 == 2, "/x/y.png").when(k % 6 == 3, "c:\\u\\photo.TIFF").when(k % 6 == 4, "noext").otherwise("/d/e.tar.gz")
    kind = F.when(k % 4 == 0, "image/png").when(k % 4 == 1, "IMAGE/JPEG").when(k % 4 == 2, "text/x")
    return view(spark, sf_dir, "part").select(k.alias("k"), t.geometry_path(path).alias("grid"), F.when(path.contains("."), t.label_path(path)).otherwise(path).alias("label"), t.safe_suffix(path, kind).alias("suffix"), t.stem(path).alias("stem"))


@query(f"""{ctes('corr')}, j AS (SELECT match_id, CASE WHEN match_id % 3 <> 0 THEN source_x / 10 END AS longitude, CASE WHEN match_id % 3 <> 0 THEN source_y / 20 END AS latitude, CASE WHEN match_id % 4 <> 0 THEN reference_x * 2 END AS elevation_m, CASE WHEN match_id % 4 <> 0 THEN match_id % 5 <> 0 END AS valid FROM corr WHERE event_type <> 'error')
SELECT match_id, {q('longitude')} AS longitude, {q('elevation_m')} AS elevation_m, CASE WHEN latitude IS NULL THEN 'physical_validation_unavailable' WHEN NOT coalesce(valid, false) THEN 'dem_unavailable' ELSE 'dem_valid_physical_unavailable' END AS validity, NULL::DOUBLE AS residual_px FROM j""")
def q_physical_validation(spark, sf_dir):
    points, i = view(spark, sf_dir, "corr").withColumn("inlier", F.col("event_type") != "error"), F.col("match_id")
    located = points.where(i % 3 != 0).select("match_id", (F.col("source_x") / 10).alias("longitude"), (F.col("source_y") / 20).alias("latitude"))
    elevations = points.where(i % 4 != 0).select("match_id", (F.col("reference_x") * 2).alias("elevation_m"), (i % 5 != 0).alias("valid"))
    return physical_validation(points, located, elevations).select("match_id", r("longitude").alias("longitude"), r("elevation_m").alias("elevation_m"), "validity", "residual_px")


# rows one by one, from strong to weak in each pair, each held against those kept so far
GREEDY = """o AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY confidence DESC, match_id) AS n FROM corr),
g AS (SELECT DISTINCT pair_id, 0::BIGINT AS n, CAST([] AS STRUCT(sx DOUBLE, sy DOUBLE, rx DOUBLE, ry DOUBLE)[]) AS kept, NULL::BIGINT AS match_id FROM corr
 UNION ALL SELECT pair_id, n, CASE WHEN fits THEN list_append(kept, p) ELSE kept END, CASE WHEN fits THEN id END FROM (
  SELECT g.pair_id, o.n, g.kept, {'sx': o.source_x, 'sy': o.source_y, 'rx': o.reference_x, 'ry': o.reference_y} AS p, o.match_id AS id,
   len(list_filter(g.kept, lambda k: sqrt((k.sx - o.source_x) * (k.sx - o.source_x) + (k.sy - o.source_y) * (k.sy - o.source_y)) <= 30.0E0 AND sqrt((k.rx - o.reference_x) * (k.rx - o.reference_x) + (k.ry - o.reference_y) * (k.ry - o.reference_y)) <= 30.0E0)) = 0 AS fits
  FROM g JOIN o ON o.pair_id = g.pair_id AND o.n = g.n + 1))"""


@query(f"{ctes('corr').replace('WITH', 'WITH RECURSIVE', 1)}, {GREEDY} SELECT match_id, pair_id FROM g WHERE match_id IS NOT NULL")
def q_greedy_chains(spark, sf_dir):
    return c.deduplicate(view(spark, sf_dir, "corr").drop("event_type"), 30.0).select("match_id", "pair_id")
