"""The registration of many image pairs in one plan: candidate passes in, models, tie points and
measures out. A matcher gives candidates (none is part of this package: see `Matcher`)."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitweave.functions import geometry as g
from orbitweave.operators import candidates as c
from orbitweave.operators import metrics as m
from orbitweave.operators import robust as rb
from orbitweave.sources.tables import tie_points
from orbitweave.storage import written


class Matcher(Protocol):
    """Finds candidates of pairs; implementations need a feature detector or network weights."""

    def __call__(self, pairs: DataFrame, scale: float) -> DataFrame: ...


def unavailable_matcher(name: str) -> Matcher:
    """A matcher that says that it is not there, instead of giving made-up matches."""
    def run(pairs: DataFrame, scale: float) -> DataFrame:
        raise NotImplementedError(f"matcher {name} is not available")

    return run


@dataclass(frozen=True)
class Settings:
    """Sizes are (height, width) of native images; scales are working to native."""

    source_shape: tuple[int, int] = (1024, 1024)
    reference_shape: tuple[int, int] = (1024, 1024)
    source_scale: float = 1.0
    reference_scale: float = 1.0
    confidence: float = 0.25
    mutual_radius: float = 8.0
    dedup_radius: float = 3.0
    grid: tuple[int, int] = (8, 8)
    per_cell: int = 0
    noise: float = 1.5


@dataclass
class Result:
    models: DataFrame
    tie_points: DataFrame
    metrics: DataFrame
    histogram: DataFrame


def register(forward: DataFrame, reverse: DataFrame, s: Settings = Settings(), fallback: DataFrame | None = None) -> Result:
    """Both directions: mutual consistency, filters, de-duplication, an optional fallback pass for
    poor pairs, native coordinates, grid selection, robust models, tie points, measures."""
    working = tuple(int(round(x * s.source_scale)) for x in s.source_shape), tuple(int(round(x * s.reference_scale)) for x in s.reference_shape)
    both = c.mutual(forward, reverse, s.mutual_radius).drop("rev_id")
    kept = c.deduplicate(c.filter_candidates(both, *working, s.confidence), s.dedup_radius)
    if fallback is not None:
        kept = c.with_fallback(kept, fallback)
    native = c.to_native(kept, s.source_scale, s.reference_scale)
    native = native.where(c.in_bounds(s.source_shape, s.reference_shape))
    selected = written(c.grid_select(native, s.reference_shape, s.grid, s.per_cell), "selected")
    threshold = max(2.0, s.noise * max(1 / s.source_scale, 1 / s.reference_scale))
    models = written(rb.fit_models(selected, threshold, iterate=True), "models")
    return finish(selected, models, s)


def register_one_way(passes: list[tuple[DataFrame, float]], s: Settings = Settings(per_cell=4, confidence=0.0), threshold: float = 3.0) -> Result:
    """One direction at several scales: passes of (candidates, scale) brought to one frame, merged,
    grid selection, plain robust models."""
    merged = c.merge([c.unscaled(p, scale) for p, scale in passes], 2.0)
    kept = c.filter_candidates(merged, s.source_shape, s.reference_shape, s.confidence)
    selected = written(c.grid_select(kept, s.reference_shape, s.grid, s.per_cell), "selected")
    models = written(rb.fit_models(selected, threshold), "models")
    return finish(selected, models, s)


def finish(selected: DataFrame, models: DataFrame, s: Settings) -> Result:
    scored = rb.scored(selected, models)
    points = scored.where("inlier").withColumns({
        "refined_source_x": F.col("source_x"), "refined_source_y": F.col("source_y"), "refined_reference_x": F.col("reference_x"), "refined_reference_y": F.col("reference_y"),
        "refinement_method": g.refinement_branch(F.col("confidence"), F.lit(False), F.lit(False)), "status": F.lit("available"), "physical_geometry_used": F.lit(False), "coordinate_space": F.lit("native"),
        "preview_source_x": F.col("source_x") * s.source_scale, "preview_source_y": F.col("source_y") * s.source_scale, "preview_reference_x": F.col("reference_x") * s.reference_scale, "preview_reference_y": F.col("reference_y") * s.reference_scale})
    keyed = tie_points(points)
    keyed = points.select("pair_id", "match_id", *(F.col(x) if x in points.columns else F.lit(None).cast(dict(keyed.dtypes)[x]).alias(x) for x in keyed.columns))
    measured = m.registration_metrics(scored, s.reference_shape, s.grid)
    measured = measured.join(models.select("pair_id", "threshold"), "pair_id", "left")
    measured = measured.withColumn("registration_quality", F.when(m.quality_gate(measured, F.col("threshold")), F.lit("image_based_ransac_only")).otherwise(F.lit("insufficient_matches")))
    return Result(models, keyed, measured, c.grid_histogram(selected, s.grid))


#: Attempts of a pair at different working scales, at most; a pair and its attempt are one number then.
MOST_ATTEMPTS = 64


@dataclass
class Search:
    """attempts: all that were made, with their measures; chosen: the one of each pair; models and selected:
    the models and candidates of chosen ones, keyed by pair_id."""

    attempts: DataFrame
    chosen: DataFrame
    models: DataFrame
    selected: DataFrame


def search_scales(attempts: DataFrame, s: Settings = Settings()) -> Search:
    """The working scale of each pair. attempts: candidates of all attempts (pair_id, attempt from 1, match_id,
    points in working pixels, confidence, source_scale, reference_scale: working to native).

    One after another an attempt is brought to native pixels, its candidates are spread over the grid and a
    model is fitted; attempts end at the first one that is good enough, and the best of those made by then
    is chosen: most inliers, then the higher share of them, then the lower error, then the earlier
    one. Here all attempts are rows, fitted in one job; which of them would not have been made is decided
    from their measures, as a minimum over the good ones.
    """
    native = attempts.withColumns({f"{side}_{a}": F.col(f"{side}_{a}") / F.col(f"{side}_scale") for side in ("source", "reference") for a in "xy"})
    limit = F.greatest(F.lit(2.0), F.lit(s.noise) / F.least("source_scale", "reference_scale"))
    native = native.withColumns({"_pair": F.col("pair_id"), "_limit": limit, "pair_id": F.col("pair_id") * F.lit(MOST_ATTEMPTS) + F.col("attempt")})
    native = native.where(c.in_bounds(s.source_shape, s.reference_shape))
    selected = written(c.grid_select(native, s.reference_shape, s.grid, s.per_cell), "selected")
    limits = selected.groupBy("pair_id").agg(F.first("_limit").alias("limit"))  # one value for each
    models = written(rb.fit_models(selected, limits, iterate=True), "models")
    scored = rb.scored(selected, models)
    error = F.when(F.col("inlier"), F.col("reprojection_error") * F.col("reprojection_error"))
    made = scored.groupBy("_pair", "attempt").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if("inlier").alias("inliers"), (F.count_if("inlier") / F.count(F.lit(1))).alias("inlier_ratio"), F.sqrt(F.avg(error)).alias("rmse"), F.max("threshold").alias("threshold"))
    good = (F.col("inliers") >= 12) & (F.col("inlier_ratio") >= 0.75) & (F.col("rmse") <= F.col("threshold"))
    made = written(made.withColumn("sufficient", F.coalesce(good, F.lit(False))), "attempts")
    pair = Window.partitionBy("_pair")  # a pair has MOST_ATTEMPTS rows at most
    last = F.coalesce(F.min(F.when(F.col("sufficient"), F.col("attempt"))).over(pair), F.max("attempt").over(pair))
    made = made.withColumn("attempts_made", last).where(F.col("attempt") <= F.col("attempts_made"))
    best = pair.orderBy(F.desc("inliers"), F.desc("inlier_ratio"), F.asc_nulls_last("rmse"), "attempt")
    chosen = written(made.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k"), "chosen")
    of = chosen.select((F.col("_pair") * F.lit(MOST_ATTEMPTS) + F.col("attempt")).alias("_key"), "_pair")
    back = lambda rows: rows.join(of, F.col("pair_id") == F.col("_key")).withColumn("pair_id", F.col("_pair")).drop("_key", "_pair")
    named = lambda rows: rows.withColumnRenamed("_pair", "pair_id")
    return Search(named(made), named(chosen), back(models), back(selected.drop("_pair", "_limit")))


def physical_validation(points: DataFrame, located: DataFrame, elevations: DataFrame) -> DataFrame:
    """Per inlier: place (located: match_id, longitude, latitude), elevation (match_id, elevation_m,
    valid) and what of them is there. Predicted positions need exact camera geometry and are null."""
    rows = points.where("inlier").join(located, "match_id", "left").join(elevations, "match_id", "left")
    status = F.when(F.col("latitude").isNull(), F.lit("physical_validation_unavailable")).when(~F.coalesce("valid", F.lit(False)), F.lit("dem_unavailable")).otherwise(F.lit("dem_valid_physical_unavailable"))
    return rows.select("match_id", "longitude", "latitude", "elevation_m", status.alias("validity"), F.lit(None).cast("double").alias("predicted_x"), F.lit(None).cast("double").alias("predicted_y"), F.lit(None).cast("double").alias("residual_px"))
