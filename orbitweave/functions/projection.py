"""Column expressions of map projection: longitudes, polar stereographic pixels, body-fixed frame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean radius of the reference sphere in metres.
SPHERE_RADIUS_M = 1_737_400.0


def normalize_longitude(x: Column) -> Column:
    """Into [0, 360)."""
    return F.pmod(x, F.lit(360.0))


def unwrap_longitude(x: Column, reference: Column) -> Column:
    """x shifted by whole turns until it is within 180 degrees of reference, both ends included."""
    d = x - reference
    turn = F.lit(360.0)
    return (
        F.when(d > 180, x - turn * F.ceil((d - 180) / turn).cast("double"))
        .when(d < -180, x + turn * F.ceil((F.lit(-180.0) - d) / turn).cast("double"))
        .otherwise(x)
    )


@dataclass(frozen=True)
class PolarStereographic:
    """Spherical polar stereographic map: radius and scale in km, offsets in pixels. hemisphere:
    1 north, -1 south."""

    radius_km: float
    map_scale_km: float
    line_offset: float
    sample_offset: float
    lines: int
    samples: int
    centre_longitude: float = 0.0
    hemisphere: int = 1

    @classmethod
    def from_label(cls, label: dict[str, object]) -> PolarStereographic:
        """From label fields; ValueError for another projection or a missing field."""
        def need(key: str) -> float:
            try:
                return float(label[key])  # type: ignore[arg-type]
            except (KeyError, TypeError, ValueError):
                raise ValueError(f"label lacks a number for {key}") from None

        if "POLAR" not in str(label.get("MAP_PROJECTION_TYPE", "")).upper() or "STEREOGRAPHIC" not in str(label.get("MAP_PROJECTION_TYPE", "")).upper():
            raise ValueError("label is not of a polar stereographic map")
        latitude = need("CENTER_LATITUDE")
        if abs(abs(latitude) - 90) > 1e-9:
            raise ValueError("the map's centre is not a pole")
        lines = need("LINE_LAST_PIXEL" if "LINE_LAST_PIXEL" in label else "LINES")
        samples = need("SAMPLE_LAST_PIXEL" if "SAMPLE_LAST_PIXEL" in label else "LINE_SAMPLES")
        return cls(need("A_AXIS_RADIUS"), need("MAP_SCALE"), need("LINE_PROJECTION_OFFSET"), need("SAMPLE_PROJECTION_OFFSET"), int(lines), int(samples), need("CENTER_LONGITUDE"), 1 if latitude > 0 else -1)

    def to_plane(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Pixel (sample, line) to map plane in km."""
        return (x - F.lit(self.sample_offset)) * F.lit(self.map_scale_km), (F.lit(self.line_offset) - y) * F.lit(self.map_scale_km)

    def to_pixel(self, px: Column, py: Column) -> tuple[Column, Column]:
        return px / F.lit(self.map_scale_km) + F.lit(self.sample_offset), F.lit(self.line_offset) - py / F.lit(self.map_scale_km)

    def latlon(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Pixel to latitude and east longitude in degrees; the pole has the centre's longitude."""
        px, py = self.to_plane(x, y)
        rho = F.sqrt(px * px + py * py)
        c = F.lit(2.0) * F.atan(rho / F.lit(2.0 * self.radius_km))
        h = F.lit(float(self.hemisphere))
        theta = F.degrees(F.atan2(px, -h * py))
        return h * (F.lit(90.0) - F.degrees(c)), F.when(rho < 1e-15, normalize_longitude(F.lit(self.centre_longitude))).otherwise(normalize_longitude(F.lit(self.centre_longitude) + theta))

    def pixel(self, latitude: Column, longitude: Column) -> tuple[Column, Column]:
        """Latitude and longitude to pixel; null on the equator, in the other hemisphere, and
        beyond a pole."""
        h = F.lit(float(self.hemisphere))
        ok = (h * latitude > 0) & (F.abs(latitude) <= 90)
        rho = F.lit(2.0 * self.radius_km) * F.tan(F.radians(F.lit(90.0) - h * latitude) / F.lit(2.0))
        theta = F.radians(longitude - F.lit(self.centre_longitude))
        x, y = self.to_pixel(rho * F.sin(theta), -h * rho * F.cos(theta))
        return F.when(ok, x), F.when(ok, y)

    def contains(self, x: Column, y: Column) -> Column:
        return (x >= 0) & (x < self.samples) & (y >= 0) & (y < self.lines)

    def pixel_residual(self, x: Column, y: Column) -> Column:
        """Distance of a pixel from itself by way of latitude and longitude."""
        bx, by = self.pixel(*self.latlon(x, y))
        return F.sqrt((bx - x) * (bx - x) + (by - y) * (by - y))

    def latlon_residual(self, latitude: Column, longitude: Column) -> Column:
        """Largest difference in degrees after the way by pixels."""
        la, lo = self.latlon(*self.pixel(latitude, longitude))
        return F.greatest(F.abs(la - latitude), F.abs(unwrap_longitude(lo, longitude) - longitude))


def to_cartesian(latitude: Column, longitude: Column, elevation_m: Column, radius_m: float = SPHERE_RADIUS_M) -> tuple[Column, Column, Column]:
    """Planetocentric, east positive, metres; null where the radius is not positive."""
    r = F.lit(float(radius_m)) + elevation_m
    r = F.when(r > 0, r)
    la, lo = F.radians(latitude), F.radians(longitude)
    return r * F.cos(la) * F.cos(lo), r * F.cos(la) * F.sin(lo), r * F.sin(la)


def from_cartesian(x: Column, y: Column, z: Column, radius_m: float = SPHERE_RADIUS_M) -> tuple[Column, Column, Column]:
    """Latitude, longitude in [0, 360), elevation; null at the centre."""
    r = F.sqrt(x * x + y * y + z * z)
    safe = F.when(r > 0, r)
    sine = z / safe
    return F.degrees(F.asin(F.when(sine > 1, 1.0).when(sine < -1, -1.0).otherwise(sine))), F.when(r > 0, normalize_longitude(F.degrees(F.atan2(y, x)))), safe - F.lit(float(radius_m))


def terrain_point(latitude: Column, longitude: Column, elevation_m: Column, reason: Column | None = None) -> Column:
    """A struct with the point, or without one and the reason, where the elevation is null."""
    x, y, z = to_cartesian(latitude, longitude, elevation_m)
    ok = elevation_m.isNotNull() & x.isNotNull()
    why = reason if reason is not None else F.lit("elevation_unavailable")
    return F.struct(F.when(ok, x).alias("x"), F.when(ok, y).alias("y"), F.when(ok, z).alias("z"), ok.alias("valid"), F.when(~ok, why).alias("reason"))
