"""Operators on rasters as pixel tables (image_id, y, x, v): stretch, decimation, resizing, blending,
warping; and on elevation rasters: lookup, gradient, validation, resampling. Dummy values and NaN
are invalid; invalid pixels never enter statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitweave.functions import geometry as g
from orbitweave.functions.projection import PolarStereographic, unwrap_longitude
from orbitweave.operators.quantiles import quantiles

VALID, OUT_OF_BOUNDS, INVALID = "ok", "outside_dem_coverage", "invalid_dem_value"


def is_valid(v: Column, dummy: float | None = None) -> Column:
    ok = v.isNotNull() & ~F.isnan(v.cast("double"))
    return ok & (v != dummy) if dummy is not None else ok


def percentile_stretch(pixels: DataFrame, dummy: float | None = None, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Adds u8: v between the image's exact percentiles as 0 to 255, truncated (after nine places, so that a last bit does not count); invalid pixels 0. An
    image of one value, or without valid pixels, does not divide by 0."""
    v = F.col("v").cast("double")
    stats = quantiles(pixels.where(is_valid(F.col("v"), dummy)), "image_id", v, [low, high]).select("image_id", F.col("q").alias("_p"))
    joined = pixels.join(stats, "image_id", "left")
    lo = F.col("_p")[0]
    hi = F.when(F.col("_p")[1] <= lo, lo + 1).otherwise(F.col("_p")[1])
    scaled = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - lo) / (hi - lo))) * 255
    return joined.withColumn("u8", F.when(is_valid(F.col("v"), dummy), F.floor(F.round(scaled, 9)).cast("int")).otherwise(0)).drop("_p")


def decimated(pixels: DataFrame, step: int) -> DataFrame:
    """Every step-th row and column, renumbered."""
    return pixels.where((F.col("y") % step == 0) & (F.col("x") % step == 0)).withColumns({"y": F.floor(F.col("y") / step), "x": F.floor(F.col("x") / step)})


def decimation_step(height: int, width: int, cap: int) -> int:
    """The least whole step that brings the longest side to cap or less (1 if it is already)."""
    return max(1, -(-max(height, width) // cap))


def area_resized(pixels: DataFrame, factor: int = 2, dummy: float | None = None) -> DataFrame:
    """Means of factor x factor blocks, of valid pixels only."""
    return pixels.where(is_valid(F.col("v"), dummy)).groupBy("image_id", F.floor(F.col("y") / factor).alias("y"), F.floor(F.col("x") / factor).alias("x")).agg(F.avg(F.col("v").cast("double")).alias("v"))


def blended(a: DataFrame, b: DataFrame, weight: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Pixels of both images of a pair: weighted mean and absolute difference. a, b: (y, x, v), and
    the columns by that tell pairs apart."""
    at = [*by, "y", "x"]
    both = a.select(*at, F.col("v").cast("double").alias("a")).join(b.select(*at, F.col("v").cast("double").alias("b")), at)
    return both.select(*at, (F.lit(weight) * F.col("a") + F.lit(1 - weight) * F.col("b")).alias("blend"), F.abs(F.col("a") - F.col("b")).alias("difference"))


def minmax(pixels: DataFrame) -> DataFrame:
    """v of each image from its smallest to its largest value as 0 to 255."""
    s = pixels.groupBy("image_id").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    return pixels.join(s, "image_id").withColumn("v", F.when(F.col("_hi") > F.col("_lo"), (F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 255).otherwise(0.0)).drop("_lo", "_hi")


def frame(spark, height: int, width: int) -> DataFrame:
    """All pixels of an output image."""
    return spark.range(height * width).select(F.floor(F.col("id") / width).alias("y"), (F.col("id") % width).alias("x"))


def warped(pixels: DataFrame, inverse: list[float], height: int, width: int, by: Sequence[str] = ()) -> DataFrame:
    """Perspective warp with bilinear weights: for each output pixel the input point under the
    inverse homography; input pixels outside the image, or missing, count as 0. pixels: (y, x, v)
    of one image, or of many told apart by the columns by."""
    out = frame(pixels.sparkSession, height, width)
    if by:
        out = pixels.select(*by).distinct().crossJoin(out)
    sx, sy = g.project(F.col("x").cast("double"), F.col("y").cast("double"), inverse)
    at = out.withColumns({"_sx": sx, "_sy": sy}).withColumns({"_ix": F.floor("_sx"), "_iy": F.floor("_sy")})
    corners = F.array(*(F.struct((F.col("_ix") + dx).alias("x"), (F.col("_iy") + dy).alias("y"), (F.abs(F.lit(1.0 - dx) - (F.col("_sx") - F.col("_ix"))) * F.abs(F.lit(1.0 - dy) - (F.col("_sy") - F.col("_iy")))).alias("w")) for dx in (0, 1) for dy in (0, 1)))
    wanted = at.select(*by, "y", "x", F.explode(corners).alias("_c")).select(*by, "y", "x", F.col("_c")["x"].alias("_cx"), F.col("_c")["y"].alias("_cy"), F.col("_c")["w"].alias("_w"))
    source = pixels.select(*by, F.col("x").alias("_cx"), F.col("y").alias("_cy"), F.col("v").cast("double").alias("_v"))
    return wanted.join(source, [*by, "_cx", "_cy"], "left").groupBy(*by, "y", "x").agg(F.sum(F.col("_w") * F.coalesce("_v", F.lit(0.0))).alias("v"))


def elevation_at(points: DataFrame, dem: DataFrame, x: Column, y: Column, height: int, width: int, least: float, most: float, dummy: float) -> DataFrame:
    """points with elevation_m, valid and reason at the nearest pixel (halves to even). The pixel is
    checked after rounding. dem: (y, x, v) of one raster, joined by pixel."""
    probe = points.withColumns({"_px": F.bround(x, 0).try_cast("long"), "_py": F.bround(y, 0).try_cast("long")})
    cells = dem.select(F.col("y").alias("_dy"), F.col("x").alias("_dx"), F.col("v").cast("double").alias("_v"))
    joined = probe.join(cells, (F.col("_px") == F.col("_dx")) & (F.col("_py") == F.col("_dy")), "left")
    within = F.coalesce((F.col("_px") >= 0) & (F.col("_px") < width) & (F.col("_py") >= 0) & (F.col("_py") < height), F.lit(False))
    ok = F.coalesce(within & (F.col("_v") >= least) & (F.col("_v") <= most) & (F.col("_v") != dummy), F.lit(False))
    return joined.select(*points.columns, F.when(ok, F.col("_v")).alias("elevation_m"), ok.alias("valid"), F.when(ok, F.lit(VALID)).when(~within, F.lit(OUT_OF_BOUNDS)).otherwise(F.lit(INVALID)).alias("reason"))


def elevation_at_latlon(points: DataFrame, dem: DataFrame, projection: PolarStereographic, least: float, most: float, dummy: float, latitude: str = "latitude", longitude: str = "longitude") -> DataFrame:
    """elevation_at by way of the raster's map projection; places that it does not show are out of
    bounds."""
    px, py = projection.pixel(F.col(latitude), F.col(longitude))
    return elevation_at(points, dem, px, py, projection.lines, projection.samples, least, most, dummy)


def gradients(dem: DataFrame, spacing_m: float, least: float, most: float, dummy: float) -> DataFrame:
    """Central differences d_row (row below less row above) and d_col (right less left) over two
    spacings, where all nine pixels around are valid. Rows grow downwards: d_row is towards the
    south on a map with north up. Four shifted equi-joins would read the raster five times, so each
    pixel is sent to its eight neighbours instead, in one aggregation."""
    v = F.col("v").cast("double")
    ok = is_valid(F.col("v"), dummy) & (v >= least) & (v <= most)
    sent = dem.where(ok).select("image_id", F.explode(F.array(*(F.struct((F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))).alias("_t"), v.alias("_v"))
    at = lambda dy, dx: F.max(F.when((F.col("_t")["dy"] == dy) & (F.col("_t")["dx"] == dx), F.col("_v")))
    around = sent.groupBy("image_id", F.col("_t")["y"].alias("y"), F.col("_t")["x"].alias("x")).agg(F.count(F.lit(1)).alias("_n"), at(0, 0).alias("v"), at(-1, 0).alias("_up"), at(1, 0).alias("_down"), at(0, -1).alias("_left"), at(0, 1).alias("_right"))
    return around.where(F.col("_n") == 9).select("image_id", "y", "x", "v", ((F.col("_down") - F.col("_up")) / F.lit(2.0 * spacing_m)).alias("d_row"), ((F.col("_right") - F.col("_left")) / F.lit(2.0 * spacing_m)).alias("d_col"))


def latlon_gradient(north: Column, south: Column, east: Column, west: Column, latitude: Column, step_degrees: float = 1e-4, radius_m: float = 1_737_400.0) -> tuple[Column, Column]:
    """Slopes (north, east) in metres per metre from elevations one step away in each direction;
    null where one is missing, and at the poles."""
    metres = F.lit(2.0 * step_degrees * 3.141592653589793 / 180 * radius_m)
    return F.try_divide(north - south, metres), F.try_divide(east - west, metres * F.when(F.abs(latitude) < 90, F.cos(F.radians(latitude))))


def validation_summary(lookups: DataFrame, by: str | None = None) -> DataFrame:
    """Checked, valid and invalid lookups, and verified (all valid), partial or unavailable (none)."""
    n, ok = F.count(F.lit(1)), F.count_if("valid")
    status = F.when(ok == 0, F.lit("unavailable")).when(ok == n, F.lit("verified")).otherwise(F.lit("partial"))
    grouped = lookups.groupBy(by) if by else lookups.groupBy()
    return grouped.agg(n.alias("checked"), ok.alias("valid"), (n - ok).alias("invalid"), status.alias("status"))


def resample_points(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Every row position with every column position: the output grid of a resampling, whose size
    is what is asked for. rows (i, y), columns (j, x); the shorter side is small by nature and is
    broadcast."""
    return rows.join(F.broadcast(columns))


def geographic_pixel(latitude: Column, longitude: Column, tie: tuple[float, float, float, float], scale: tuple[float, float]) -> tuple[Column, Column]:
    """Pixel of a raster in degrees with north up. tie: (i, j, longitude, latitude) of one pixel;
    scale: degrees per pixel in x and y. Longitudes are taken within half a turn of the tie's."""
    i, j, lon0, lat0 = tie
    longitude = unwrap_longitude(longitude, F.lit(float(lon0)))
    return (longitude - F.lit(float(lon0))) / F.lit(float(scale[0])) + F.lit(float(i)), (F.lit(float(lat0)) - latitude) / F.lit(float(scale[1])) + F.lit(float(j))


def elevation_geographic(points: DataFrame, dem: DataFrame, tie: tuple[float, float, float, float], scale: tuple[float, float], height: int, width: int, radius_m: float = 1_737_400.0, latitude: str = "latitude", longitude: str = "longitude") -> DataFrame:
    """Elevations from a raster in degrees whose values are radii in metres: positive values are
    valid, and the reference radius is taken off."""
    x, y = geographic_pixel(F.col(latitude), F.col(longitude), tie, scale)
    got = elevation_at(points, dem, x, y, height, width, 5e-324, float("inf"), float("-inf"))
    return got.withColumn("elevation_m", F.col("elevation_m") - F.lit(float(radius_m)))
