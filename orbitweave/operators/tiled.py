"""Matching inside tiles: descriptors of a tile of the source image meet those of its search box in the
reference image, all tiles of all pairs in one plan, and what the tiles found is merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitweave.operators import candidates as c
from orbitweave.operators.lookups import ratio_test
from orbitweave.operators.metric_join import nearest_within
from orbitweave.storage import written

TILE = ["pair_id", "tile"]


def boxes_of_pairs(pairs: DataFrame, boxes: DataFrame) -> DataFrame:
    """The same tiles and search boxes (candidates.search_boxes) for each pair_id of pairs, written, since
    what gives a box is long. The tiles of a grid are few and go to all tasks."""
    return written(pairs.select("pair_id").distinct().join(F.broadcast(written(boxes, "boxes"))), "boxes")


def inside(points: DataFrame, boxes: DataFrame, low: tuple[str, str], high: tuple[str, str]) -> DataFrame:
    """points (pair_id, id, x, y, embedding) once for each box of their pair that holds them."""
    within = (F.col("x") >= F.col(low[0])) & (F.col("x") < F.col(high[0])) & (F.col("y") >= F.col(low[1])) & (F.col("y") < F.col(high[1]))
    held = boxes.select(F.col("pair_id").alias("_pair"), "tile", *low, *high)
    return points.join(held, (F.col("pair_id") == F.col("_pair")) & within).select(*TILE, "id", "x", "y", "embedding")


def tiled_matches(source: DataFrame, reference: DataFrame, boxes: DataFrame, n_tiles: int, base: DataFrame | None = None, ratio: float = 0.75, mutual_radius: float = 8.0, dedup_radius: float = 3.0) -> DataFrame:
    """Matches of all tiles, with those of the whole images (base) if given, de-duplicated: pair_id, match_id,
    tile, source_id, reference_id, points and confidence.

    source, reference: pair_id, id, x, y, embedding. boxes: pair_id, tile (from 0, under n_tiles), x0, y0,
    x1, y1 and rx0, ry0, rx1, ry1. In each tile both directions pass the ratio test, and a match counts
    if the way back leads within mutual_radius. match_id is (source_id * (n_tiles + 1) + tile), with n_tiles
    itself for rows of base (pair_id, source_id, reference_id, points, confidence). A tile without two
    descriptors on the other side has no match.
    """
    s = inside(source, boxes, ("x0", "y0"), ("x1", "y1"))
    r = inside(reference, boxes, ("rx0", "ry0"), ("rx1", "ry1"))
    there = ratio_test(nearest_within(s, r, TILE), ratio, TILE).select(*TILE, "source_id", "reference_id", "confidence")
    back = ratio_test(nearest_within(r, s, TILE), ratio, TILE).select(*TILE, F.col("source_id").alias("reference_id"), F.col("reference_id").alias("source_id"), "confidence")
    at_s = source.select("pair_id", F.col("id").alias("source_id"), F.col("x").alias("_sx"), F.col("y").alias("_sy"))
    at_r = reference.select("pair_id", F.col("id").alias("reference_id"), F.col("x").alias("_rx"), F.col("y").alias("_ry"))
    key = F.struct(*TILE)  # tiles of a pair are matched apart
    points = lambda rows, *names: rows.join(at_s, ["pair_id", "source_id"]).join(at_r, ["pair_id", "reference_id"]).select(
        key.alias("pair_id"), "source_id", "reference_id", *(F.col(a).alias(b) for a, b in zip(names, c.POINTS, strict=True)), "confidence")
    forward = points(there, "_sx", "_sy", "_rx", "_ry").withColumn("match_id", F.col("source_id"))
    reverse = points(back, "_rx", "_ry", "_sx", "_sy").withColumn("rev_id", F.col("reference_id"))
    found = c.mutual(forward, reverse, mutual_radius)
    number = lambda tile: F.col("source_id") * F.lit(n_tiles + 1) + tile
    found = found.select(F.col("pair_id")["pair_id"].alias("pair_id"), F.col("pair_id")["tile"].alias("tile"), "source_id", "reference_id", *c.POINTS, "confidence")
    if base is not None:
        found = found.unionByName(base.select("pair_id", F.lit(n_tiles).alias("tile"), "source_id", "reference_id", *c.POINTS, "confidence"))
    return c.deduplicate(found.withColumn("match_id", number(F.col("tile"))), dedup_radius)


def tile_counts(matches: DataFrame, n_tiles: int) -> DataFrame:
    """Per pair: matches, tiles with a match, and matches of the whole images among them."""
    of_tile = F.col("tile") < n_tiles
    return matches.groupBy("pair_id").agg(F.count(F.lit(1)).alias("matches"), F.count_distinct(F.when(of_tile, F.col("tile"))).alias("tiles_with_matches"), F.count_if(~of_tile).alias("full_frame_matches"))
