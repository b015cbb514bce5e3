"""Column expressions of a frame camera: quaternions, distortion, projection, rays."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from orbitweave.functions.projection import SPHERE_RADIUS_M, to_cartesian

Vector = tuple[Column, Column, Column]


def quaternion_matrix(x: Column, y: Column, z: Column, w: Column) -> Column:
    """Row-major rotation matrix of a scalar-last quaternion, which is normalised; null for zero."""
    n = F.sqrt(x * x + y * y + z * z + w * w)
    n = F.when(n > 0, n)
    x, y, z, w = x / n, y / n, z / n, w / n
    one, two = F.lit(1.0), F.lit(2.0)
    m = [
        one - two * (y * y + z * z), two * (x * y - z * w), two * (x * z + y * w),
        two * (x * y + z * w), one - two * (x * x + z * z), two * (y * z - x * w),
        two * (x * z - y * w), two * (y * z + x * w), one - two * (x * x + y * y),
    ]
    return F.when(n.isNotNull(), F.array(*m))


def distort(x: Column, y: Column, coefficients: Sequence[float]) -> tuple[Column, Column]:
    """Radial and tangential distortion k1, k2, p1, p2, k3; missing ones are 0."""
    k1, k2, p1, p2, k3 = (F.lit(float(c)) for c in [*coefficients, 0, 0, 0, 0, 0][:5])
    r2 = x * x + y * y
    radial = F.lit(1.0) + k1 * r2 + k2 * r2 * r2 + k3 * r2 * r2 * r2
    two = F.lit(2.0)
    return x * radial + two * p1 * x * y + p2 * (r2 + two * x * x), y * radial + p1 * (r2 + two * y * y) + two * p2 * x * y


def undistort(x: Column, y: Column, coefficients: Sequence[float], rounds: int = 12) -> tuple[Column, Column]:
    """Fixed-point inverse of distort, as a fold inside one expression, so that its size does not
    grow with the rounds."""
    def step(p: Column, _: Column) -> Column:
        dx, dy = distort(p["x"], p["y"], coefficients)
        return F.struct((p["x"] + x - dx).alias("x"), (p["y"] + y - dy).alias("y"))

    p = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(x.alias("x"), y.alias("y")), step)
    return p["x"], p["y"]


@dataclass(frozen=True)
class Camera:
    """Intrinsics in pixels, and optional distortion."""

    fx: float
    fy: float
    cx: float
    cy: float
    distortion: Sequence[float] = field(default_factory=tuple)

    @classmethod
    def of_focal_length(cls, focal_mm: float, pixel_mm: float, cx: float, cy: float, distortion: Sequence[float] = ()) -> Camera:
        f = focal_pixels(focal_mm, pixel_mm)
        return cls(f, f, cx, cy, distortion)

    def missing(self) -> list[str]:
        """Names of the parameters that are not usable."""
        return [n for n, ok in (("focal_length", self.fx > 0 and self.fy > 0), ("principal_point", self.cx == self.cx and self.cy == self.cy)) if not ok]


def focal_pixels(focal_mm: float, pixel_mm: float) -> float:
    if not pixel_mm > 0 or not focal_mm > 0:
        raise ValueError("focal length and pixel size must be positive")
    return focal_mm / pixel_mm


def is_rotation(m: Column, tolerance: float = 1e-6) -> Column:
    """Whether a row-major array of nine is orthonormal with determinant 1; null counts as not."""
    ok = F.size(m) == 9
    for i in range(3):
        for j in range(i, 3):
            dot = sum((m[3 * i + k] * m[3 * j + k] for k in range(3)), F.lit(0.0))
            ok = ok & (F.abs(dot - F.lit(float(i == j))) <= tolerance)
    det = m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])
    return F.coalesce(ok & (F.abs(det - 1) <= tolerance), F.lit(False))


def to_camera(p: Vector, centre: Vector, rotation: Column) -> Vector:
    """World to camera: the rotation (camera to world, row-major) transposed, times p - centre."""
    d = [a - b for a, b in zip(p, centre, strict=True)]
    return tuple(rotation[k] * d[0] + rotation[3 + k] * d[1] + rotation[6 + k] * d[2] for k in range(3))  # type: ignore[return-value]


def project_point(p: Vector, centre: Vector, rotation: Column, camera: Camera) -> Column:
    """Struct (x, y, valid, reason): pixel of a world point; none behind the camera."""
    x, y, z = to_camera(p, centre, rotation)
    ok = F.coalesce(z > 0, F.lit(False))
    safe = F.when(ok, z)
    u, v = distort(x / safe, y / safe, camera.distortion)
    return F.struct((u * F.lit(camera.fx) + F.lit(camera.cx)).alias("x"), (v * F.lit(camera.fy) + F.lit(camera.cy)).alias("y"), ok.alias("valid"), F.when(~ok, F.lit("point_behind_camera")).alias("reason"))


def project_latlon(latitude: Column, longitude: Column, elevation_m: Column, centre: Vector, rotation: Column, camera: Camera) -> Column:
    return project_point(to_cartesian(latitude, longitude, elevation_m), centre, rotation, camera)


def pixel_ray(x: Column, y: Column, rotation: Column, camera: Camera) -> Vector:
    """Unit direction in the world of the ray through a pixel."""
    u, v = (x - F.lit(camera.cx)) / F.lit(camera.fx), (y - F.lit(camera.cy)) / F.lit(camera.fy)
    if any(camera.distortion):
        u, v = undistort(u, v, camera.distortion)
    n = F.sqrt(u * u + v * v + F.lit(1.0))
    d = (u / n, v / n, F.lit(1.0) / n)
    return tuple(rotation[3 * k] * d[0] + rotation[3 * k + 1] * d[1] + rotation[3 * k + 2] * d[2] for k in range(3))  # type: ignore[return-value]


def ray_sphere(origin: Vector, direction: Vector, radius: Column | float = SPHERE_RADIUS_M) -> Column:
    """Distance along a unit ray to the first hit of a sphere around the centre; null for a miss."""
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    b = sum((o * d for o, d in zip(origin, direction, strict=True)), F.lit(0.0))
    c = sum((o * o for o in origin), F.lit(0.0)) - r * r
    disc = b * b - c
    root = F.sqrt(F.when(disc >= 0, disc))
    near, far = -b - root, -b + root
    return F.when(near > 0, near).when(far > 0, far)
