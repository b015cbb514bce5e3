"""Measures of registrations, per pair: counts, errors, coverage, ranks, quality gate."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitweave import workers
from orbitweave.functions import geometry as g


def rmse(e: Column) -> Column:
    return F.sqrt(F.avg(e * e))


def registration_metrics(scored: DataFrame, shape: tuple[int, int] = (1024, 1024), grid: tuple[int, int] = (8, 8)) -> DataFrame:
    """One aggregation over scored matches: counts, inlier share, confidences of all candidates,
    errors of inliers (null without any), grid cells that inliers reach (0 under three inliers)."""
    e = F.when(F.col("inlier"), F.col("reprojection_error"))
    row, col = g.cell(F.col("reference_y"), shape[0], grid[0]), g.cell(F.col("reference_x"), shape[1], grid[1])
    inliers = F.count_if("inlier")
    cells = F.count_distinct(F.when(F.col("inlier"), row * grid[1] + col))
    return scored.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("candidate_matches"), inliers.alias("ransac_inliers"), (F.count(F.lit(1)) - inliers).alias("ransac_outliers"),
        (inliers / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("inlier_ratio"), F.avg("confidence").alias("mean_match_confidence"), F.min("confidence").alias("minimum_match_confidence"),
        F.avg(e).alias("mean_reprojection_error_px"), F.median(e).alias("median_reprojection_error_px"), F.max(e).alias("maximum_reprojection_error_px"), rmse(e).alias("rmse_reprojection_error_px"),
        F.when(inliers >= 3, cells).otherwise(0).alias("occupied_grid_cells"), F.lit(grid[0] * grid[1]).alias("total_grid_cells"))


def quality_gate(metrics: DataFrame, threshold: Column | float, least: int = 12, ratio: float = 0.75) -> Column:
    """Enough inliers, a large enough share, and an error not above the threshold."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.coalesce((F.col("ransac_inliers") >= least) & (F.col("inlier_ratio") >= ratio) & (F.col("rmse_reprojection_error_px") <= t), F.lit(False))


def best_attempt(attempts: DataFrame, by: str = "pair_id", attempt: str = "attempt") -> DataFrame:
    """Of each pair the attempt with most inliers, then the largest share, then the smallest error,
    then the lowest number. attempts: a row each with ransac_inliers, inlier_ratio and
    rmse_reprojection_error_px (null: worst)."""
    rank = F.struct(F.col("ransac_inliers"), F.col("inlier_ratio"), F.coalesce(-F.col("rmse_reprojection_error_px"), F.lit(float("-inf"))), -F.col(attempt))
    rest = [c for c in attempts.columns if c != by]
    return attempts.groupBy(by).agg(F.max_by(F.struct(*rest), rank).alias("_b")).select(by, *(F.col("_b")[c].alias(c) for c in rest))


def ground_truth_rmse(matches: DataFrame, truth) -> DataFrame:
    """Root mean square error of all matches (not only inliers) against a known homography."""
    e = g.reprojection_error(F.col("source_x"), F.col("source_y"), F.col("reference_x"), F.col("reference_y"), truth)
    return matches.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), rmse(e).alias("ground_truth_rmse_px"))


def top_errors(scored: DataFrame, n: int = 10) -> DataFrame:
    """Per pair the n inliers with the largest errors; ties to the lower match_id."""
    w = Window.partitionBy("pair_id").orderBy(F.desc("reprojection_error"), "match_id")
    return scored.where("inlier").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def hull_points(x, y) -> list[tuple[float, float]]:
    """Convex hull by the monotone chain."""
    p = sorted(set(zip(x, y, strict=True)))
    if len(p) < 3:
        return p

    def half(points):
        out: list[tuple[float, float]] = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return half(p) + half(p[::-1])


def hull_coverage(points: DataFrame, x: str, y: str, shape: tuple[int, int] = (1024, 1024)) -> DataFrame:
    """Per pair the share of the image that the points' convex hull covers (0 under three points).
    Hulls of each batch of rows are taken where the rows are; only their corners are shuffled, and
    the hull of a pair's corners is the pair's."""
    workers.prepare(points.sparkSession)

    def corners(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            out = []
            for pair, own in rows.groupby("pair_id"):
                h = hull_points(own["x"], own["y"])
                out += [(pair, len(own) if k == 0 else 0, *p) for k, p in enumerate(h)]
            yield pd.DataFrame(out, columns=["pair_id", "n", "x", "y"])

    def area(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        h = hull_points(rows["x"], rows["y"])
        n = int(rows["n"].sum())
        a = abs(sum(p[0] * q[1] - p[1] * q[0] for p, q in zip(h, h[1:] + h[:1], strict=True))) / 2 if n >= 3 and len(h) >= 3 else 0.0
        return pd.DataFrame({"pair_id": [key[0]], "n": [n], "convex_hull_fraction": [a / (shape[0] * shape[1])]})

    some = points.where(g.finite(F.col(x), F.col(y))).select("pair_id", F.col(x).alias("x"), F.col(y).alias("y"))
    return some.mapInPandas(corners, "pair_id long, n long, x double, y double").groupBy("pair_id").applyInPandas(area, "pair_id long, n long, convex_hull_fraction double")


def attempt_counters(passes: DataFrame, by: str = "pair_id") -> DataFrame:
    """Sums over matcher passes of each pair, the largest keypoint counts, the mean descriptor
    distance over all matches (null without any), and whether any pass used physical geometry.
    passes: forward, reverse and mutual counts, source_keypoints, reference_keypoints,
    distance_sum, n_distances, physical."""
    return passes.groupBy(by).agg(
        F.count(F.lit(1)).alias("passes"), F.sum("forward").alias("raw_forward_matches"), F.sum("reverse").alias("raw_reverse_matches"), F.sum("mutual").alias("mutual_matches"),
        F.max("source_keypoints").alias("source_keypoints"), F.max("reference_keypoints").alias("reference_keypoints"),
        F.try_divide(F.sum("distance_sum"), F.sum("n_distances")).alias("mean_descriptor_distance"), F.coalesce(F.bool_or("physical"), F.lit(False)).alias("physical_geometry_used"))
