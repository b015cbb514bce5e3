"""Sub-pixel refinement of correspondences."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitweave import workers
from orbitweave.functions import geometry as g

WINDOW = 17
RESULT = "dx double, dy double, response double, refine_status string"


def patch(image: np.ndarray, x: float, y: float, size: int) -> np.ndarray | None:
    """The size x size neighbourhood of the rounded point; None if it leaves the image."""
    if not np.isfinite((x, y)).all():
        return None
    r, cx, cy = size // 2, int(np.rint(x)), int(np.rint(y))
    if cx - r < 0 or cy - r < 0 or cx + r >= image.shape[1] or cy + r >= image.shape[0]:
        return None
    return image[cy - r : cy + r + 1, cx - r : cx + r + 1].astype(float)


def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """Shift (x, y) of b against a by phase correlation under a Hann window, sub-pixel by the
    centroid of the 5 x 5 peak, and the share of the response in it."""
    n = a.shape[0]
    hann = np.outer(np.hanning(n), np.hanning(n))
    fa, fb = np.fft.fft2((a - a.mean()) * hann), np.fft.fft2((b - b.mean()) * hann)
    cross = fb * np.conj(fa)
    surface = np.fft.fftshift(np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)).real)
    py, px = np.unravel_index(surface.argmax(), surface.shape)
    y0, y1, x0, x1 = max(0, py - 2), min(n, py + 3), max(0, px - 2), min(n, px + 3)
    peak = np.maximum(surface[y0:y1, x0:x1], 0)
    total = peak.sum()
    if total <= 0:
        return 0.0, 0.0, 0.0
    ys, xs = np.mgrid[y0:y1, x0:x1]
    return float((xs * peak).sum() / total - n // 2), float((ys * peak).sum() / total - n // 2), float(min(1.0, total))


def local_shift(source: np.ndarray, reference: np.ndarray, sx: float, sy: float, rx: float, ry: float, window: int = WINDOW) -> tuple[float | None, float | None, float | None, str]:
    """Shift to add to the reference point, its response, and a status."""
    size = max(9, window | 1)
    a, b = patch(source, sx, sy, size), patch(reference, rx, ry, size)
    if a is None or b is None:
        return None, None, None, "patch_outside_image"
    if a.std() < 1e-6 or b.std() < 1e-6:
        return None, None, None, "low_texture"
    dx, dy, response = phase_shift(a, b)
    return dx, dy, response, "refined"


def image_of(pixels: pd.DataFrame) -> np.ndarray:
    """A dense array of pixel rows; missing pixels are 0."""
    out = np.zeros((int(pixels["y"].max()) + 1, int(pixels["x"].max()) + 1))
    out[pixels["y"].to_numpy(int), pixels["x"].to_numpy(int)] = pixels["v"].to_numpy(float)
    return out


def refine(matches: DataFrame, source: DataFrame, reference: DataFrame, window: int = WINDOW) -> DataFrame:
    """matches with refined_reference_x and _y (the reference point moved by the local shift, or as
    it was), subpixel_diagnostic (1 - response) and refine_status. source, reference: pixel tables
    (pair_id, y, x, v); a pair's images are bounded by the working size and meet its matches in one
    group."""
    workers.prepare(matches.sparkSession)
    pixels = source.select("pair_id", F.lit(0).alias("side"), "y", "x", "v").unionByName(reference.select("pair_id", F.lit(1).alias("side"), "y", "x", "v"))
    names = matches.columns
    fields = ", ".join(f"`{c}` {t}" for c, t in matches.dtypes)

    def run(key: tuple, rows: pd.DataFrame, px: pd.DataFrame) -> pd.DataFrame:
        out = rows.copy()
        if px.empty or px["side"].nunique() < 2:
            got = [(None, None, None, "image_unavailable")] * len(rows)
        else:
            a, b = image_of(px[px["side"] == 0]), image_of(px[px["side"] == 1])
            got = [local_shift(a, b, *p, window) for p in rows[["source_x", "source_y", "reference_x", "reference_y"]].to_numpy(float)]
        out["refined_reference_x"] = [x + (d[0] or 0.0) for x, d in zip(rows["reference_x"], got, strict=True)]
        out["refined_reference_y"] = [y + (d[1] or 0.0) for y, d in zip(rows["reference_y"], got, strict=True)]
        out["subpixel_diagnostic"] = [max(0.0, 1 - d[2]) if d[2] is not None else None for d in got]
        out["refine_status"] = [d[3] for d in got]
        return out[[*names, "refined_reference_x", "refined_reference_y", "subpixel_diagnostic", "refine_status"]]

    return matches.groupBy("pair_id").cogroup(pixels.groupBy("pair_id")).applyInPandas(run, f"{fields}, refined_reference_x double, refined_reference_y double, subpixel_diagnostic double, refine_status string")


#: (source x, source y, elevation in metres) of a point to where it must be in the reference image.
Projector = Callable[[float, float, float], tuple[float, float]]
PROJECTED = "struct<x: double, y: double, failure: string>"


def projected(matches: DataFrame, projector: Projector | None, threshold: float = 0.75) -> DataFrame:
    """matches (with confidence, elevation_m, dem_valid, physical) with refinement_branch, predicted_x,
    predicted_y, physical_residual, physical_geometry_used and projection_reason.

    Only rows of the branch dem_physical go to the projector, in Arrow batches. A row for which it
    fails, or gives no number, falls back alone, and the reason names the failure; without a projector all
    of them do."""
    workers.prepare(matches.sparkSession)
    rows = matches.withColumn("_branch", g.refinement_branch(F.col("confidence"), F.coalesce("dem_valid", F.lit(False)), F.coalesce("physical", F.lit(False)), threshold))
    asked = F.col("_branch") == "dem_physical"
    if projector is None:
        rows = rows.withColumn("_p", F.when(asked, F.from_json(F.lit('{"failure": "physical_projector_not_supplied"}'), PROJECTED)))
    else:
        @F.pandas_udf(PROJECTED)
        def run(x: pd.Series, y: pd.Series, elevation: pd.Series, wanted: pd.Series) -> pd.DataFrame:
            out = []
            for a, b, e, w in zip(x, y, elevation, wanted, strict=True):
                if not w:
                    out.append((None, None, None))
                    continue
                try:
                    px, py = map(float, projector(float(a), float(b), float(e)))
                    out.append((px, py, None) if np.isfinite((px, py)).all() else (None, None, "physical_projection_failed:ValueError"))
                except Exception as error:  # whatever the projector raises is that row's reason
                    out.append((None, None, f"physical_projection_failed:{type(error).__name__}"))
            return pd.DataFrame(out, columns=["x", "y", "failure"])

        rows = rows.withColumn("_p", run("source_x", "source_y", F.col("elevation_m").cast("double"), asked))
    used = F.col("_p")["x"].isNotNull()
    dx, dy = F.col("_p")["x"] - F.col("reference_x"), F.col("_p")["y"] - F.col("reference_y")
    branch = F.when(asked & ~F.coalesce(used, F.lit(False)), F.lit("classical_fallback")).otherwise(F.col("_branch"))
    reason = F.when(used, F.lit("physical_dem_projection_used")).otherwise(F.col("_p")["failure"])
    return rows.select(
        *matches.columns, branch.alias("refinement_branch"), F.col("_p")["x"].alias("predicted_x"), F.col("_p")["y"].alias("predicted_y"), F.sqrt(dx * dx + dy * dy).alias("physical_residual"),
        F.coalesce(used, F.lit(False)).alias("physical_geometry_used"), reason.alias("projection_reason"))


#: What refine() says, in the words of a result. Those of methods and failures stand below.
LOCAL_REASONS = {"refined": "phase_correlation_subpixel", "patch_outside_image": "boundary_or_invalid_patch", "low_texture": "low_texture_patch", "image_unavailable": "image_patches_not_supplied"}


def refine_points(matches: DataFrame, source: DataFrame | None = None, reference: DataFrame | None = None, projector: Projector | None = None, threshold: float = 0.75, window: int = WINDOW) -> DataFrame:
    """Each correspondence by the branch that suits it: where terrain and geometry are there the projector's
    place, then, with images, the local shift from there. Adds refined_source_x, refined_source_y,
    refined_reference_x, refined_reference_y, refinement_method, reprojection_error (of the local shift),
    physical_residual, physical_geometry_used, status and reason. matches: pair_id, match_id, points,
    confidence, elevation_m, dem_valid, physical; source, reference: pixels as for refine()."""
    found = projected(matches, projector, threshold)
    at = {f"reference_{c}": F.coalesce(f"predicted_{c}", f"reference_{c}") for c in "xy"}
    used, classical = F.col("physical_geometry_used"), F.col("refinement_branch") == "classical"
    own = {f"_was_{c}": F.col(f"reference_{c}") for c in "xy"}
    if source is not None and reference is not None:
        rows = refine(found.withColumns(own).withColumns(at), source, reference, window)
        local = F.create_map(*(F.lit(x) for pair in LOCAL_REASONS.items() for x in pair))[F.col("refine_status")]
        method = F.when(used, F.lit("physics_dem_then_classical_subpixel")).when(classical, F.lit("classical_subpixel")).otherwise(F.lit("classical_fallback_subpixel"))
        error, status = F.col("subpixel_diagnostic"), F.lit("available")
    else:
        rows = found.withColumns(own).withColumns(at).withColumns({f"refined_reference_{c}": F.col(f"reference_{c}") for c in "xy"})
        local = F.lit("image_patches_not_supplied")
        method = F.when(used, F.lit("physical_dem")).when(classical, F.lit("classical")).otherwise(F.lit("classical_fallback"))
        error, status = F.lit(None).cast("double"), F.when(used | classical, F.lit("available")).otherwise(F.lit("retained"))
    rows = rows.withColumns({"refinement_method": method, "reprojection_error": error, "status": status, "reason": F.coalesce("projection_reason", local), "refined_source_x": F.col("source_x"), "refined_source_y": F.col("source_y")})
    rows = rows.withColumns({f"reference_{c}": F.col(f"_was_{c}") for c in "xy"})
    return rows.select(*matches.columns, "refined_source_x", "refined_source_y", "refined_reference_x", "refined_reference_y", "refinement_method", "reprojection_error", "physical_residual", "physical_geometry_used", "status", "reason")


def accepted(refined: DataFrame, models: DataFrame, source_shape: tuple[int, int], reference_shape: tuple[int, int]) -> DataFrame:
    """refined (refine_points() of inliers of models) with accepted, and the points of accepted rows moved to
    their refined places: both inside their images, and the error under the first model not grown."""
    rows = refined.join(models.select("pair_id", "h"), "pair_id")
    error = lambda side: g.reprojection_error(F.col(f"{side}source_x"), F.col(f"{side}source_y"), F.col(f"{side}reference_x"), F.col(f"{side}reference_y"), F.col("h"))
    inside = F.coalesce(g.inside(F.col("refined_source_x"), F.col("refined_source_y"), source_shape[1], source_shape[0]), F.lit(False))
    ok = inside & g.refinement_accepted(F.col("refined_reference_x"), F.col("refined_reference_y"), reference_shape[1], reference_shape[0], error(""), error("refined_"))
    rows = rows.withColumn("accepted", F.coalesce(ok, F.lit(False)))
    return rows.withColumns({c: F.when(F.col("accepted"), F.col(f"refined_{c}")).otherwise(F.col(c)) for c in ("source_x", "source_y", "reference_x", "reference_y")}).select(*refined.columns, "accepted")
