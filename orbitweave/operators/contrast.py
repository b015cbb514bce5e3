"""Illumination-robust local contrast of working images: contrast-limited adaptive equalisation, a
blurred background taken off, and edges blended in. Whole working images (at most the working
size, so bounded) are one group each."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from orbitweave import workers


def equalised(image: np.ndarray, clip: float = 2.0, grid: int = 8) -> np.ndarray:
    """Adaptive histogram equalisation of 8-bit values: each tile's histogram is clipped, the excess
    spread evenly, and pixels take the bilinear mean of the four nearest tiles' curves."""
    h, w = image.shape
    th, tw = -(-h // grid), -(-w // grid)
    padded = np.pad(image, ((0, th * grid - h), (0, tw * grid - w)), mode="reflect" if min(h, w) > max(th * grid - h, tw * grid - w) else "edge").astype(int)
    curves = np.empty((grid, grid, 256))
    limit = max(1, int(clip * th * tw / 256))
    for i in range(grid):
        for j in range(grid):
            n = np.bincount(padded[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = np.maximum(n - limit, 0).sum()
            n = np.minimum(n, limit) + over / 256
            curves[i, j] = np.clip(n.cumsum() * 255 / (th * tw), 0, 255)
    y, x = np.clip((np.arange(h) + 0.5) / th - 0.5, 0, grid - 1), np.clip((np.arange(w) + 0.5) / tw - 0.5, 0, grid - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, grid - 1), np.minimum(x0 + 1, grid - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    v = image.astype(int)
    at = lambda a, b: curves[a[:, None], b[None], v]
    return (at(y0, x0) * (1 - fx) + at(y0, x1) * fx) * (1 - fy) + (at(y1, x0) * (1 - fx) + at(y1, x1) * fx) * fy


def blurred(image: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian blur with mirrored borders."""
    r = max(1, int(np.ceil(3 * sigma)))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        p = np.pad(image, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric" if image.shape[axis] >= r else "edge")
        image = np.apply_along_axis(np.convolve, axis, p, k, "valid")
    return image


def edges(image: np.ndarray) -> np.ndarray:
    """Magnitude of the Scharr derivatives."""
    p = np.pad(image, 1, mode="edge")
    smooth = lambda a, axis: 3 * np.take(a, range(0, a.shape[axis] - 2), axis) + 10 * np.take(a, range(1, a.shape[axis] - 1), axis) + 3 * np.take(a, range(2, a.shape[axis]), axis)
    dx = smooth(p[:, 2:] - p[:, :-2], 0)
    dy = smooth(p[2:] - p[:-2], 1)
    return np.hypot(dx, dy)


def stretched(image: np.ndarray, low: float, high: float) -> np.ndarray:
    """Values between two percentiles as 0 to 255; zeros if these are equal."""
    a, b = np.percentile(image, (low, high))
    return np.clip((image - a) * 255 / (b - a), 0, 255) if b > a else np.zeros_like(image, float)


# Weights of the image, of its detail and of its edges, and of the background.
IMAGE, DETAIL, EDGES, SHARPEN, MIDDLE, SIGMA = 0.78, 0.18, 0.04, 0.35, 128.0, 9.0


def detail(equal: np.ndarray, amount: float) -> np.ndarray:
    """What stands out of the blurred background, around the middle gray."""
    return (1 + amount) * equal - amount * blurred(equal, SIGMA) + MIDDLE


def local_contrast(image: np.ndarray) -> np.ndarray:
    """8-bit values with local contrast, for matching images under different light: mostly the image
    itself, some of its equalised detail, a little of its edges."""
    d = np.floor(np.clip(detail(np.floor(equalised(image)), SHARPEN), 0, 255))
    parts = (1 - EDGES) * (IMAGE * image + DETAIL * d) + EDGES * stretched(edges(d), 5, 99)
    return np.clip(parts, 0, 255).astype(np.uint8)


def preview_contrast(image: np.ndarray) -> np.ndarray:
    """Equalised detail of a preview, stretched from its least to its largest value."""
    d = detail(np.floor(equalised(image)), 0.5)
    return (d - d.min()) / (d.max() - d.min()) * 255 if d.max() > d.min() else np.zeros_like(d)


def enhanced(pixels: DataFrame) -> DataFrame:
    """(image_id, y, x, v): pixel tables of 8-bit working images, enhanced."""
    workers.prepare(pixels.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        y, x = rows["y"].to_numpy(int), rows["x"].to_numpy(int)
        a = np.zeros((y.max() + 1, x.max() + 1), np.uint8)
        a[y, x] = np.clip(rows["v"].fillna(0), 0, 255).astype(np.uint8)
        return rows.assign(v=local_contrast(a)[y, x].astype(float))[["image_id", "y", "x", "v"]]

    return pixels.select("image_id", "y", "x", "v").groupBy("image_id").applyInPandas(run, "image_id long, y long, x long, v double")
