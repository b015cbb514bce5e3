"""CSV and JSON inputs: catalogues, pairs, geometry grids, tie points, metrics; and CSV, JSON and
report outputs with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave.functions import text as t

# Columns of the files, in order.
PAIRS = "pair_id string, source_path string, reference_path string"
TRUTH = "sample_id string, source_image string, reference_image string, homography string"
CATALOG = "image_path string, browse_path string, product_id string, sensor string"
MANIFEST = "dtm_label_path string, dtm_path string"
GRID = "Pixel double, Scan double, Longitude double, Latitude double"
TIE_POINTS = [
    "source_x", "source_y", "reference_x", "reference_y", "refined_source_x", "refined_source_y", "refined_reference_x", "refined_reference_y", "refinement_method", "reprojection_error", "physical_residual", "confidence", "status", "reason", "physical_geometry_used",
    "subpixel_diagnostic", "match_distance", "inlier", "coordinate_space", "preview_source_x", "preview_source_y", "preview_reference_x", "preview_reference_y", "preview_refined_source_x", "preview_refined_source_y", "preview_refined_reference_x", "preview_refined_reference_y",
]
TEXT_COLUMNS = ("refinement_method", "status", "reason", "coordinate_space")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header line; a byte order mark is skipped by the reader. Columns come by name."""
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)


def read_text_columns(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, named by the header."""
    return spark.read.option("header", True).csv(path)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As read_csv; an empty table where there is no file."""
    try:
        return read_csv(spark, path, schema)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """A geometry grid as (idx, pixel, scan, longitude, latitude); ValueError if it is empty. idx
    is the order in the file."""
    rows = read_csv(spark, path, GRID).select(F.monotonically_increasing_id().alias("idx"), *(F.col(c).alias(c.lower()) for c in ("Pixel", "Scan", "Longitude", "Latitude")))
    if rows.isEmpty():
        raise ValueError("the geometry grid has no rows")
    return rows


def homography(c) -> object:
    """A JSON 3 x 3 matrix as a row-major array of nine; null if it is none."""
    h = F.flatten(F.from_json(c, "array<array<double>>"))
    return F.when(F.size(h) == 9, h)


def coerced(rows: DataFrame) -> DataFrame:
    """Tie points read as text, with numbers and truth values in their columns; what is neither is null there
    and kept as it stands in the map unparsed, by column."""
    out = {c: t.coerced_boolean(F.col(c)) if c in t.BOOLEAN_COLUMNS else t.coerced_number(F.col(c)) if c not in TEXT_COLUMNS else F.nullif(F.col(c), F.lit("")) for c in rows.columns if c in TIE_POINTS}
    left = {c: t.unparsed_boolean(F.col(c)) if c in t.BOOLEAN_COLUMNS else t.unparsed(F.col(c)) for c in out if c not in TEXT_COLUMNS}
    pairs = F.array(*(F.struct(F.lit(c).alias("key"), v.alias("value")) for c, v in left.items())) if left else F.array().cast("array<struct<key:string,value:string>>")
    return rows.withColumns(out | {"unparsed": F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull()))})


def tie_points(rows: DataFrame) -> DataFrame:
    """The fixed columns in their order; missing ones are null."""
    kind = lambda c: "string" if c in TEXT_COLUMNS else "boolean" if c in t.BOOLEAN_COLUMNS else "double"
    return rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(kind(c)).alias(c) for c in TIE_POINTS))


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV parts with a header each, also for an empty table."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON objects; what is no object is null."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("document"))


def report(metrics: DataFrame) -> DataFrame:
    """(pair_id, report): a short text on each pair's measures."""
    line = lambda name, value: F.concat(F.lit(f"- {name}: "), value, F.lit("\n"))
    body = F.concat(
        F.format_string("# Registration of pair %s\n\n", F.col("pair_id").cast("string")),
        line("candidate matches", F.col("candidate_matches").cast("string")), line("inliers", F.col("ransac_inliers").cast("string")), line("inlier ratio", t.percent_text(F.col("inlier_ratio"))),
        line("RMSE", t.unit_text(F.col("rmse_reprojection_error_px"), "px")), line("mean confidence", t.cell_text(F.col("mean_match_confidence"))), line("occupied cells", F.concat_ws(" of ", F.col("occupied_grid_cells").cast("string"), F.col("total_grid_cells").cast("string"))))
    return metrics.select("pair_id", body.alias("report"))


# Columns of the grid file, in order.
UNIFORM_GRID = ["match_id", "grid_row", "grid_col", "source_x", "source_y", "reference_x", "reference_y", "confidence", "preview_source_x", "preview_source_y", "preview_reference_x", "preview_reference_y"]


def uniform_grid(celled: DataFrame, source_scale: float = 1.0, reference_scale: float = 1.0) -> DataFrame:
    """The grid file's rows from selected matches with cells: native points, and the same in preview
    pixels."""
    return celled.withColumns({"preview_source_x": F.col("source_x") * source_scale, "preview_source_y": F.col("source_y") * source_scale, "preview_reference_x": F.col("reference_x") * reference_scale, "preview_reference_y": F.col("reference_y") * reference_scale}).select(*(["pair_id"] if "pair_id" in celled.columns else []), *UNIFORM_GRID)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files that a path or glob names; the contents are not read."""
    try:
        return spark.read.format("binaryFile").load(path).select("path", "length")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path string, length long")


def elevation_sources(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(ordinal, kind, path, label): terrain rasters in the order in which they are tried - those of
    the manifest whose label and data both exist, then GeoTIFFs by path. manifest may be empty."""
    there = files.select(F.col("path").alias("_f"))
    rows = manifest.join(there, F.col("dtm_path") == F.col("_f"), "left_semi").join(there, F.col("dtm_label_path") == F.col("_f"), "left_semi")
    rows = rows.select(F.lit(0).alias("_k"), F.lit("polar_dtm").alias("kind"), F.col("dtm_path").alias("path"), F.col("dtm_label_path").alias("label"))
    tiffs = files.where(F.lower("path").rlike("\\.tiff?$")).select(F.lit(1).alias("_k"), F.lit("geotiff").alias("kind"), "path", F.lit(None).cast("string").alias("label"))
    from pyspark.sql import Window

    # a project's terrain files are a short list
    return rows.unionByName(tiffs).withColumn("ordinal", F.row_number().over(Window.orderBy("_k", "path"))).drop("_k")


def inputs(images: DataFrame, catalog: DataFrame, files: DataFrame) -> DataFrame:
    """Everything that is known of an image by its path: catalogue row (by image or browse path),
    native raster, geometry grid and label, each only if the file exists. images: image_id, path;
    catalog: ordinal and the columns of CATALOG; files: path."""
    from orbitweave.operators.lookups import any_key_lookup

    rows = any_key_lookup(images, "path", catalog, ["image_path", "browse_path"], "ordinal")
    rows = rows.withColumn("native_path", F.coalesce("catalog_image_path", "path"))
    rows = rows.withColumns({"geometry_path": t.geometry_path(F.col("native_path")), "label_path": t.label_path(F.col("native_path"))})
    there = files.select("path").distinct()
    for c in ("geometry_path", "label_path"):
        rows = rows.join(there.select(F.col("path").alias("_f")), F.col(c) == F.col("_f"), "left").withColumn(c, F.col("_f")).drop("_f")
    return rows.select(*images.columns, "native_path", "label_path", "geometry_path", F.col("catalog_product_id").alias("product_id"), F.col("catalog_sensor").alias("sensor"))
