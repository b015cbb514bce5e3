"""The store of run documents: append with unique keys, point lookup, recent runs, nested shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitweave.functions import text as t
from orbitweave.operators import ranges

# Files that may stand for an output, the first that exists; outputs of a run with the file that
# shows each, and its address where the name differs.
FALLBACKS = {
    "source_reference.png": ("source_reference.png",),
    "candidate_matches.png": ("candidate_matches.png", "matches.png"),
    "ransac_inliers.png": ("ransac_inliers.png", "inliers.png"),
    "final_tie_points.png": ("final_tie_points.png", "inliers.png"),
    "difference.png": ("difference.png",),
}
OUTPUTS = {
    "correspondence_image": "candidate_matches.png",
    "registered_source": "registered_source.png",
    "overlay": "overlay.png",
    "difference": "difference.png",
    "tie_points_csv": "tie_points.csv",
    "metrics_json": "metrics.json",
    "report": "report.md",
}
STATUS = {"success": "completed"}
DONE = ("success", "insufficient_matches")
# Sections of a run document, each field with the measure that it shows.
SECTIONS = {
    "matching": {
        "source_keypoints": "source_keypoints",
        "reference_keypoints": "reference_keypoints",
        "raw_loftr_candidate_matches": "raw_working_matches",
        "filtered_candidate_matches": "native_candidate_matches_before_grid",
        "uniform_grid_selected_matches": "grid_selected_matches",
        "ransac_inliers": "ransac_inliers",
        "ransac_outliers": "ransac_outliers",
        "inlier_ratio": "inlier_ratio",
        "mean_confidence": "mean_match_confidence",
        "minimum_confidence": "minimum_match_confidence",
    },
    "validation": {
        "mean_reprojection_error": "mean_reprojection_error_px",
        "median_reprojection_error": "median_reprojection_error_px",
        "maximum_reprojection_error": "maximum_reprojection_error_px",
        "reprojection_rmse": "rmse_reprojection_error_px",
        "ground_truth_rmse": "ground_truth_rmse_px",
        "physical_residual": "physical_reprojection_error",
        "registration_status": "registration_quality",
        "validation_status": "validation",
    },
    "runtime": {
        "loftr_seconds": "loftr_runtime_seconds",
        "preprocessing_seconds": "preprocessing_runtime_seconds",
        "refinement_seconds": "refinement_runtime_seconds",
        "registration_seconds": "registration_runtime_seconds",
        "total_pipeline_seconds": "total_pipeline_runtime_seconds",
        "device": "device",
    },
    "processing": {
        "method": "method",
        "scale_factor": "working_scale_factor",
        "device": "device",
        "preprocessing_method": "preprocessing_method",
        "selected_target_max_dimension": "working_scale_selected",
        "attempts": "working_scale_attempts",
    },
}
DIMENSIONS = ("original_source_dimensions", "original_reference_dimensions", "working_source_dimensions", "working_reference_dimensions")


def by_id(runs: DataFrame, run_id: str) -> DataFrame:
    """The document of a run; ValueError for what is no run id. The filter reaches the scan."""
    import re

    if not re.fullmatch("[0-9a-f]{32}", run_id):
        raise ValueError("a run id is 32 hexadecimal digits")
    return runs.where(F.col("run_id") == run_id)


def recent(runs: DataFrame, limit: int = 20, skip: int = 0) -> DataFrame:
    """Newest first, ties by run_id; limit is kept between 1 and 100, skip at 0 or more."""
    return runs.orderBy(F.desc("created_at"), "run_id").offset(max(0, skip)).limit(min(100, max(1, limit)))


def page_arguments(limit: int, skip: int) -> None:
    if not 1 <= limit <= 100 or skip < 0:
        raise ValueError("limit must be 1 to 100, skip 0 or more")


def append(runs: DataFrame, path: str) -> int:
    """Adds documents to a Parquet store, of each run_id one that is not there yet; how many."""
    spark = runs.sparkSession
    new = runs.dropDuplicates(["run_id"])
    try:
        new = new.join(spark.read.parquet(path).select("run_id"), "run_id", "left_anti")
    except Exception as e:  # a store that does not exist yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    from orbitweave.storage import written

    new = written(new, "runs")
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def connect(spark: SparkSession, path: str) -> DataFrame | None:
    """The store, or None where there is none: a run never fails for the store."""
    try:
        return spark.read.parquet(path)
    except Exception:
        return None


def numbered(tie_points: DataFrame, by: str = "run_id", order: str = "match_id") -> DataFrame:
    """point_id from 1 in order, in each run. A long run is numbered in ranges (ranges.numbered)."""
    return ranges.numbered(tie_points, [order], [by], "point_id")


def stage_records(stages: Column, api_status: Column, terrain: Column, physical: Column, durations: Column | None = None) -> Column:
    """Stages with display name, status and duration. They are completed where the run came to an end, else
    failed; where terrain or physical (truth values, null: not known) is false, the stage that needed
    it fell back. durations: a map of seconds by stage, if there is one."""
    ended = F.when(api_status.isin(*DONE), F.lit("completed")).otherwise(F.lit("failed"))
    fell_back = lambda s: (s == "dem_retrieval_validation") & ~F.coalesce(terrain, F.lit(True)) | s.contains("physical") & ~F.coalesce(physical, F.lit(True))
    seconds = lambda s: (F.element_at(durations, s) if durations is not None else F.lit(None)).cast("double")
    return F.transform(stages, lambda s: F.struct(t.stage_label(s).alias("stage"), F.when(fell_back(s), F.lit("fallback")).otherwise(ended).alias("status"), seconds(s).alias("duration_seconds")))


def preprocessing_stages(stages: Column) -> Column:
    return F.filter(stages, lambda s: s.contains("preprocess") | s.contains("scale"))


#: The type of tie points in a run document.
POINT = "array<struct<point_id:int,source_x:double,source_y:double,reference_x:double,reference_y:double,confidence:double,match_distance:double,reprojection_error:double,inlier:boolean>>"


def run_documents(runs: DataFrame, tie_points: DataFrame, base: str = "") -> DataFrame:
    """The whole document of each run. runs: run_id, api_status, and what there is of created_at,
    completed_at, error, source_image, reference_image, pipeline_stages (array), stage_durations (map),
    files (names of those that exist), dem_elevation_validation, physical_geometry_available and the
    measures of SECTIONS and DIMENSIONS; what is missing is null. tie_points: run_id, match_id, source_x ...
    confidence, reprojection_error, inlier, and what there is of match_distance and
    physical_geometry_used. A run's document holds its tie points, as the store wants it: a row is as
    large as its run."""
    of = lambda name, kind=None: F.col(name) if name in runs.columns else F.lit(None).cast(kind or "string")
    extra = lambda name, kind: (F.col(name) if name in tie_points.columns else F.lit(None)).cast(kind)
    point = F.struct("point_id", "source_x", "source_y", "reference_x", "reference_y", "confidence", extra("match_distance", "double").alias("match_distance"), "reprojection_error", "inlier")
    nested = numbered(tie_points).groupBy("run_id").agg(F.array_sort(F.collect_list(point)).alias("_points"), F.bool_or(extra("physical_geometry_used", "boolean")).alias("_used"))
    rows = runs.join(nested, "run_id", "left")
    points = F.coalesce("_points", F.array().cast(POINT))
    state, physical = of("dem_elevation_validation"), of("physical_geometry_available", "boolean")
    terrain = F.when(state.isNotNull(), state != "unavailable")
    stages = of("pipeline_stages", "array<string>")
    section = {k: [of(m).alias(f) for f, m in fields.items()] for k, fields in SECTIONS.items()}
    return rows.select(
        "run_id", of("created_at", "timestamp").alias("created_at"), of("completed_at", "timestamp").alias("completed_at"), normal_status(F.col("api_status")).alias("status"), "api_status", of("method").alias("method"),
        F.concat_ws(":", "run_id", F.lit("source")).alias("source_image_id"), F.concat_ws(":", "run_id", F.lit("reference")).alias("reference_image_id"), of("source_image").alias("source_image"), of("reference_image").alias("reference_image"),
        F.struct(*section["processing"], *(dimensions(of(d, "array<int>")).alias(d) for d in DIMENSIONS), preprocessing_stages(F.coalesce(stages, F.array().cast("array<string>"))).alias("preprocessing_stages"), terrain.alias("dem_available"), physical.alias("physical_geometry_available"), F.coalesce("_used", F.lit(False)).alias("physical_refinement_used")).alias("processing"),
        F.struct(*section["matching"], F.size(points).alias("final_tie_points")).alias("matching"), F.struct(*section["validation"]).alias("validation"), points.alias("tie_points"),
        output_references(of("files", "array<string>"), F.col("run_id"), base).alias("outputs"), F.struct(*section["runtime"], F.lit(None).cast("double").alias("api_processing_seconds")).alias("runtime"),
        F.coalesce(stage_records(stages, F.col("api_status"), terrain, physical, of("stage_durations", "map<string,double>")), F.array()).alias("pipeline_stages"), of("error").alias("error"))


def output_references(files: Column, run_id: Column, base: str = "") -> Column:
    """Addresses of a run's outputs; null where neither the file nor one that stands for it exists."""
    return F.struct(*(F.when(artifact(files, name).isNotNull(), F.concat(F.lit(f"{base.rstrip('/')}/api/results/"), run_id, F.lit(f"/{name}"))).alias(k) for k, name in OUTPUTS.items()))


def normal_status(status: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv))
    return F.coalesce(F.element_at(names, status), status)


def artifact(files: Column, wanted: str) -> Column:
    """The first of the wanted file and its stand-ins that is in the array of file names."""
    return F.coalesce(*(F.when(F.array_contains(files, n), F.lit(n)) for n in FALLBACKS.get(wanted, (wanted,))))


def search(rows: DataFrame, query: str, order: str, page: int = 1, per_page: int = 5) -> DataFrame:
    """A page of the rows of which any column holds the query, in order, with a display number from
    1. Only the rows up to the page's end are gathered to number them."""
    hits = rows.where(t.row_matches([F.col(c) for c in rows.columns], query))
    upto = hits.orderBy(order).limit(page * per_page)
    return upto.withColumn("display", F.row_number().over(Window.orderBy(order))).where(F.col("display") > (page - 1) * per_page)


def dimensions(shape: Column) -> Column:
    """An array [height, width, ...] as a struct; null where either is missing."""
    h, w = F.try_element_at(shape, F.lit(1)), F.try_element_at(shape, F.lit(2))
    return F.when(h.isNotNull() & w.isNotNull(), F.struct(h.cast("int").alias("height"), w.cast("int").alias("width")))


def image_metadata(files: DataFrame) -> DataFrame:
    """What a run document says of an image: id '<run>:<role>', format by suffix, size, dimensions
    (the decoded ones, else those that the run reports). files: run_id, role, path, length, decoded
    and reported (arrays), sensor."""
    suffix = F.upper(F.regexp_extract("path", "\\.([^./\\\\]+)$", 1))
    size = F.coalesce(dimensions(F.col("decoded")), dimensions(F.col("reported")))
    return files.select(
        "run_id", "role", F.concat_ws(":", "run_id", "role").alias("image_id"), t.basename(F.col("path")).alias("filename"), F.nullif(suffix, F.lit("")).alias("format"),
        size["width"].alias("width"), size["height"].alias("height"), F.col("length").alias("file_size"), F.coalesce("sensor", F.lit("unavailable")).alias("sensor"), "path")
