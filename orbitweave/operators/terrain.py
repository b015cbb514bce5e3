"""Terrain as a table: elevations at places, slopes from probes around them, and where rays meet it.

A terrain is a table of pixels (y, x, v) with a rule from latitude and longitude to a pixel. All
questions are joins with that table by pixel, so neither the terrain nor the places are held anywhere,
and either may be of any size.

Elevations have a status for each place: valid, outside_dem_coverage or invalid_dem_value; nothing is
filled in. Null or NaN places are outside.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitweave.functions import projection as pr
from orbitweave.operators import rasters
from orbitweave.storage import written

STEP_DEGREES = 1e-4
#: Rounds of the intersection, and the movement in metres at which it has settled.
ROUNDS, SETTLED_M = 12, 1e-4

# The reasons that results tell.
MISSES_SPHERE = "camera_ray_misses_lunar_reference_sphere"
MISSES_SURFACE = "ray_misses_dem_surface"
MEETS = "dem_intersection"


class Terrain:
    """What a provider of elevations has: at() and, of slopes, the way that suits its raster."""

    def at(self, points: DataFrame, latitude: str = "latitude", longitude: str = "longitude") -> DataFrame:
        """points with elevation_m, valid and reason."""
        raise NotImplementedError

    def slopes(self, points: DataFrame, latitude: str = "latitude", longitude: str = "longitude") -> DataFrame:
        """points with north_slope and east_slope (metres per metre) from elevations a step of
        STEP_DEGREES to the south, north, west and east; null where one of these is missing."""
        probes = (("s", -STEP_DEGREES, 0.0), ("n", STEP_DEGREES, 0.0), ("w", 0.0, -STEP_DEGREES), ("e", 0.0, STEP_DEGREES))
        kept = _with_rows(points)
        shifted = F.array(*(F.struct(F.lit(k).alias("k"), (F.col(latitude) + dy).alias("_lat"), (F.col(longitude) + dx).alias("_lon")) for k, dy, dx in probes))
        asked = kept.select("_row", F.explode(shifted).alias("_p")).select("_row", "_p.k", "_p._lat", "_p._lon")
        got = self.at(asked, "_lat", "_lon")
        of = lambda k: F.max(F.when((F.col("k") == k) & F.col("valid"), F.col("elevation_m"))).alias(f"_{k}")
        found = got.groupBy(F.col("_row").alias("_r")).agg(*(of(k) for k, *_ in probes))
        north, east = rasters.latlon_gradient(F.col("_n"), F.col("_s"), F.col("_e"), F.col("_w"), F.col(latitude), STEP_DEGREES)
        whole = F.col("_n").isNotNull() & F.col("_s").isNotNull() & F.col("_e").isNotNull() & F.col("_w").isNotNull()
        out = kept.join(found, F.col("_row") == F.col("_r"))
        return out.select(*points.columns, F.when(whole, north).alias("north_slope"), F.when(whole, east).alias("east_slope"))


@dataclass(frozen=True)
class MapTerrain(Terrain):
    """A raster on a polar map, with the values that count as elevations."""

    dem: DataFrame
    projection: pr.PolarStereographic
    least: float
    most: float
    dummy: float

    def at(self, points: DataFrame, latitude: str = "latitude", longitude: str = "longitude") -> DataFrame:
        return rasters.elevation_at_latlon(points, self.dem, self.projection, self.least, self.most, self.dummy, latitude, longitude)


@dataclass(frozen=True)
class DegreeTerrain(Terrain):
    """A raster in degrees with north up, of radii in metres: tie is (i, j, longitude, latitude) of a
    pixel, scale degrees per pixel in x and y."""

    dem: DataFrame
    tie: tuple[float, float, float, float]
    scale: tuple[float, float]
    height: int
    width: int
    radius_m: float = pr.SPHERE_RADIUS_M

    def at(self, points: DataFrame, latitude: str = "latitude", longitude: str = "longitude") -> DataFrame:
        return rasters.elevation_geographic(points, self.dem, self.tie, self.scale, self.height, self.width, self.radius_m, latitude, longitude)

    def slopes(self, points: DataFrame, latitude: str = "latitude", longitude: str = "longitude") -> DataFrame:
        """north_slope (row below less row above, over two rows, as rows are stored) and east_slope from
        the nine pixels around the nearest one; null at the raster's edge and where one of them is
        missing or no number. The nine are asked for in one join and folded back."""
        kept = _with_rows(points)
        x, y = rasters.geographic_pixel(F.col(latitude), F.col(longitude), self.tie, self.scale)
        at = kept.withColumns({"_px": F.bround(x, 0).try_cast("long"), "_py": F.bround(y, 0).try_cast("long")})
        inner = (F.col("_px") >= 1) & (F.col("_py") >= 1) & (F.col("_px") < self.width - 1) & (F.col("_py") < self.height - 1)
        around = F.array(*(F.struct(F.lit(3 * (dy + 1) + dx + 1).alias("k"), (F.col("_py") + dy).alias("_cy"), (F.col("_px") + dx).alias("_cx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))
        asked = at.where(inner).select("_row", F.explode(around).alias("_c")).select("_row", "_c.k", "_c._cy", "_c._cx")
        cells = self.dem.select(F.col("y").alias("_dy"), F.col("x").alias("_dx"), F.col("v").cast("double").alias("_v")).where("NOT isnan(_v) AND abs(_v) < double('infinity')")
        met = asked.join(cells, (F.col("_cy") == F.col("_dy")) & (F.col("_cx") == F.col("_dx")))
        of = lambda k: F.max(F.when(F.col("k") == k, F.col("_v")))
        found = met.groupBy(F.col("_row").alias("_r")).agg(F.count(F.lit(1)).alias("_n9"), of(7).alias("_below"), of(1).alias("_above"), of(5).alias("_right"), of(3).alias("_left")).where("_n9 = 9")
        metres = F.lit(2.0 * self.radius_m * 3.141592653589793 / 180)
        north = (F.col("_below") - F.col("_above")) / (metres * F.lit(abs(self.scale[1])))
        east = F.try_divide(F.col("_right") - F.col("_left"), metres * F.cos(F.radians(F.col(latitude))) * F.lit(self.scale[0]))
        return kept.join(found, F.col("_row") == F.col("_r"), "left").select(*points.columns, north.alias("north_slope"), east.alias("east_slope"))


def _with_rows(points: DataFrame) -> DataFrame:
    """points, written, with numbers that join what was asked for them."""
    return written(points.withColumn("_row", F.monotonically_increasing_id()), "points")


def sphere_hit(radius: Column) -> Column:
    """How far along a ray (ox, oy, oz, dx, dy, dz, a unit direction) a sphere of that radius is first met;
    null if it is not."""
    o, d = [F.col(c) for c in ("ox", "oy", "oz")], [F.col(c) for c in ("dx", "dy", "dz")]
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    b = F.lit(2.0) * dot(o, d)
    root = F.sqrt(b * b - F.lit(4.0) * (dot(o, o) - radius * radius))  # NaN below 0
    near, far = (-b - root) / F.lit(2.0), (-b + root) / F.lit(2.0)
    return F.when(~F.isnan(root), F.when(near > 0, near).when(far > 0, far))


def ray_hits(rays: DataFrame, terrain: Terrain, radius_m: float = pr.SPHERE_RADIUS_M, rounds: int = ROUNDS, settled_m: float = SETTLED_M) -> DataFrame:
    """rays (ox, oy, oz, dx, dy, dz and more) with where they meet the terrain: hit_x, hit_y, hit_z,
    hit_latitude, hit_longitude, hit_elevation_m, hit_rounds, hit_status (valid or unavailable) and
    hit_reason.

    The reference sphere is met first, then the sphere of the elevation there, and so on until the point
    settles. Each round asks the terrain table for the rays that are still open, in one join, and
    writes them; rays that have settled or failed are set aside. A ray that has not settled after all
    rounds counts as valid where it is then, as hit_rounds tells. A ray with a null has status unavailable.
    """
    new = ("_x", "_y", "_z", "_lat", "_lon")
    start = _with_rows(rays)
    # the rounds take only what a ray is; other columns come back at the end
    live = start.select("_row", "ox", "oy", "oz", "dx", "dy", "dz")
    live = _moved(live.withColumn("_t", sphere_hit(F.lit(float(radius_m)))))
    live = written(live.select("_row", "ox", "oy", "oz", "dx", "dy", "dz", "_t", *new), "rays")
    done = [live.where("_t IS NULL").select("_row", *_result("unavailable", MISSES_SPHERE, 0))]
    live = live.where("_t IS NOT NULL")
    for k in range(1, rounds + 1):
        asked = terrain.at(live, "_lat", "_lon")
        t = sphere_hit(F.lit(float(radius_m)) + F.col("elevation_m"))
        moved = _moved(asked.withColumns({"_old": F.struct("_x", "_y", "_z"), "_place": F.struct("_lat", "_lon"), "_t": F.when(F.col("valid"), t)}))
        step = F.sqrt(sum((F.col(c) - F.col("_old")[c]) * (F.col(c) - F.col("_old")[c]) for c in ("_x", "_y", "_z")))
        moved = written(moved.withColumn("_still", F.coalesce(step < settled_m, F.lit(False))).drop("_old"), "rays")
        # the place of a failed lookup is told, that of a missed sphere is not
        failed = moved.where("NOT valid").select("_row", *_result("unavailable", F.col("reason"), k, place=True))
        missed = moved.where("valid AND _t IS NULL").select("_row", *_result("unavailable", MISSES_SURFACE, k))
        ended = F.lit(k == rounds) | F.col("_still")
        met = moved.where(F.col("_t").isNotNull() & ended)
        height = F.sqrt(sum(F.col(c) * F.col(c) for c in ("_x", "_y", "_z"))) - F.lit(float(radius_m))
        met = met.withColumn("_place", F.struct("_lat", "_lon")).select("_row", *_result("valid", MEETS, k, place=True, point=True, height=height))
        done += [failed, missed, met]
        live = moved.where(F.col("_t").isNotNull() & ~ended).select("_row", "ox", "oy", "oz", "dx", "dy", "dz", "_t", *new)
        if k == rounds or live.isEmpty():
            break
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return start.join(found.withColumnRenamed("_row", "_r"), F.col("_row") == F.col("_r")).drop("_row", "_r")


def _moved(rays: DataFrame) -> DataFrame:
    """rays with the point at _t along each, and its latitude and longitude."""
    at = {f"_{c}": F.col(f"o{c}") + F.col("_t") * F.col(f"d{c}") for c in "xyz"}
    la, lo, _ = pr.from_cartesian(F.col("_x"), F.col("_y"), F.col("_z"))
    return rays.withColumns(at).withColumns({"_lat": la, "_lon": lo})


def _result(status: str, reason: str | Column, k: int, place: bool = False, point: bool = False, height: Column | None = None) -> list[Column]:
    none = F.lit(None).cast("double")
    where = [F.col("_place")["_lat"], F.col("_place")["_lon"]] if place else [none, none]
    return [
        *((F.col(f"_{c}") if point else none).alias(f"hit_{c}") for c in "xyz"), where[0].alias("hit_latitude"), where[1].alias("hit_longitude"),
        (height if height is not None else none).alias("hit_elevation_m"), F.lit(k).alias("hit_rounds"), F.lit(status).alias("hit_status"), (F.lit(reason) if isinstance(reason, str) else reason).alias("hit_reason")]
