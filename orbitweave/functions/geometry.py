"""Column expressions on image points: homographies, errors, grid cells, scales, thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def entries(h: Sequence[float] | Column) -> list[Column]:
    """The nine row-major entries of a homography: literals, or elements of an array column."""
    return [h[k] for k in range(9)] if isinstance(h, Column) else [lit(x) for x in h]


def project(x: Column, y: Column, h: Sequence[float] | Column) -> tuple[Column, Column]:
    """A point under a homography; (0, 0) where the denominator is 0, null for a null model."""
    a = entries(h)
    w = a[6] * x + a[7] * y + a[8]
    safe = F.when(w == 0, F.lit(None).cast("double")).otherwise(w)
    px, py = (a[0] * x + a[1] * y + a[2]) / safe, (a[3] * x + a[4] * y + a[5]) / safe
    return F.when(w == 0, F.lit(0.0)).otherwise(px), F.when(w == 0, F.lit(0.0)).otherwise(py)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def reprojection_error(sx: Column, sy: Column, rx: Column, ry: Column, h: Sequence[float] | Column) -> Column:
    """Distance of the projected source point from the reference point; null without a model."""
    px, py = project(sx, sy, h)
    return distance(px, py, rx, ry)


def cell(coordinate: Column, size: float, n: int) -> Column:
    """Grid cell of a coordinate: truncated, then kept between 0 and n - 1."""
    return F.least(F.lit(n - 1), F.greatest(F.lit(0), (coordinate / F.lit(float(max(1, size))) * F.lit(float(n))).cast("int")))


def finite(*columns: Column) -> Column:
    """Whether all values are numbers: neither null, nor NaN, nor infinite."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return ok


def inside(x: Column, y: Column, width: float | Column, height: float | Column) -> Column:
    """0 <= x < width and 0 <= y < height."""
    return (x >= 0) & (x < lit(width)) & (y >= 0) & (y < lit(height))


def to_native(v: Column, working_scale: float | Column, native_scale: float | Column = 1.0) -> Column:
    """Working image coordinate to native: divided by the working scale, times the native one."""
    return v / lit(working_scale) * lit(native_scale)


def to_working(v: Column, working_scale: float | Column, native_scale: float | Column = 1.0) -> Column:
    return v / lit(native_scale) * lit(working_scale)


def compose_scales(h: Sequence[float] | Column, source: tuple[Column | float, Column | float], reference: tuple[Column | float, Column | float]) -> Column:
    """The homography between unscaled images from one between scaled ones: the reference scaling
    undone, after h, after the source scaling; row-major array."""
    a, (sx, sy), (rx, ry) = entries(h), map(lit, source), map(lit, reference)
    return F.array(a[0] * sx / rx, a[1] * sy / rx, a[2] / rx, a[3] * sx / ry, a[4] * sy / ry, a[5] / ry, a[6] * sx, a[7] * sy, a[8])


def working_homography(h: Sequence[float] | Column, source: tuple[Column | float, Column | float], reference: tuple[Column | float, Column | float]) -> Column:
    """The inverse of compose_scales."""
    (sx, sy), (rx, ry) = map(lit, source), map(lit, reference)
    one = lit(1.0)
    return compose_scales(h, (one / sx, one / sy), (one / rx, one / ry))


def confidence_of(d: Column) -> Column:
    """Confidence of a descriptor distance."""
    return F.lit(1.0) / (F.lit(1.0) + d)


def native_threshold(source_scale: Column | float, reference_scale: Column | float, noise: float = 2.5, least: float = 2.0) -> Column:
    """Inlier threshold in native pixels: the working noise at the coarser image's scale, and not
    below least. Scales that are not positive count for nothing; without any the scale is 1."""
    inverse = lambda s: F.when(lit(s) > 0, F.lit(1.0) / F.when(lit(s) > 0, lit(s)))
    coarser = F.coalesce(F.greatest(inverse(source_scale), inverse(reference_scale)), F.lit(1.0))
    return F.greatest(F.lit(float(least)), F.lit(float(noise)) * coarser)


def working_size(height: Column, width: Column, cap: int = 768) -> Column:
    """Longest side of the working image: the cap, or the image's own if smaller."""
    return F.least(F.lit(cap), F.greatest(height, width))


def refinement_branch(confidence: Column, dem_valid: Column, physical: Column, threshold: float = 0.75) -> Column:
    """How a correspondence is refined; null confidence takes the fallback unless terrain and
    geometry are there."""
    return F.when(confidence >= threshold, F.lit("classical")).when(dem_valid & physical, F.lit("dem_physical")).otherwise(F.lit("classical_fallback"))


def refinement_accepted(x: Column, y: Column, width: float, height: float, before: Column, after: Column) -> Column:
    """A refined point holds if it is a number, in the image, and its error has not grown."""
    return F.coalesce(finite(x, y, after) & inside(x, y, width, height) & (after <= before + F.lit(1e-6)), F.lit(False))
