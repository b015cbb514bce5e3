"""Column expressions on labels, names, metadata and display text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Columns of a tie-point file that hold numbers and truth values.
NUMBER_COLUMNS = ("source_x", "source_y", "reference_x", "reference_y", "refined_source_x", "refined_source_y", "refined_reference_x", "refined_reference_y", "reprojection_error", "physical_residual", "confidence", "subpixel_diagnostic", "match_distance")
BOOLEAN_COLUMNS = ("inlier", "physical_geometry_used")
# Upload suffixes, and those of media types.
SUFFIXES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".jp2", ".img")
MEDIA_SUFFIXES = {"image/png": ".png", "image/jpeg": ".jpg", "image/tiff": ".tif", "image/jp2": ".jp2"}
# Display names of pipeline stages.
STAGE_LABELS = {
    "metadata_context_check": "metadata/context check",
    "catalog_localization": "catalog localization",
    "dem_retrieval_validation": "DEM retrieval/validation",
    "multi_scale_illumination_robust_preprocessing": "multi-scale illumination-robust preprocessing",
    "working_scale_selection": "working-scale selection",
    "loftr_or_baseline_matching": "LoFTR/baseline matching",
    "candidate_filtering": "candidate filtering",
    "native_coordinate_conversion": "native-coordinate conversion",
    "uniform_grid_selection": "uniform-grid selection",
    "image_ransac": "RANSAC",
    "confidence_evaluation": "confidence evaluation",
    "adaptive_subpixel_refinement": "adaptive sub-pixel refinement",
    "adaptive_subpixel_refinement_on_ransac_inliers": "adaptive sub-pixel refinement on RANSAC inliers",
    "dem_physical_validation_or_honest_fallback": "DEM/physical validation",
    "native_coordinate_tie_points": "native-coordinate tie points",
    "original_resolution_registration": "original-resolution registration",
    "registration_outputs_and_metrics": "registration outputs and metrics",
}
# Display texts of what a run ended with.
STATUS_TEXTS = {"success": "Successful", "insufficient_matches": "Insufficient matches", "failed": "Failed"}

LABEL_LINE = r"^\s*([A-Za-z0-9_:^]+)\s*=\s*(.*)$"


def label_key(line: Column) -> Column:
    """KEY of a `KEY = VALUE` line; null for other lines."""
    key = F.regexp_extract(line, LABEL_LINE, 1)
    return F.when(key != "", key)


def label_value(line: Column) -> Column:
    """VALUE without unit in angle brackets, blanks and quotes; null for other lines."""
    value = F.trim(F.substring_index(F.regexp_extract(line, LABEL_LINE, 2), "<", 1))
    return F.when(label_key(line).isNotNull(), F.regexp_replace(value, "^\"|\"$", ""))


def label_number(line: Column) -> Column:
    """VALUE as a number; null if it is none."""
    value = label_value(line)
    return F.when(value.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), value.try_cast("double"))


def required(c: Column, name: str) -> Column:
    """c, or an error that names the missing field."""
    return F.coalesce(c, F.raise_error(F.lit(f"required field {name} is missing")))


def sample_bits(data_type: Column) -> Column:
    """Bits of a data type named with its bytes, such as UnsignedLSB2; 8 without a number."""
    n = F.regexp_extract(data_type, "([0-9]+)$", 1)
    return F.when(n != "", n.try_cast("int") * 8).otherwise(8)


def sample_type(name: Column, bits: Column) -> Column:
    """Array type code of a sample type: byte order, u or i, bytes. 8 bits are u1; signed if the
    name starts with `signed`, or with `int` and is not unsigned; little-endian if it says LSB or
    little."""
    low = F.lower(name)
    signed = low.startswith("signed") | (low.startswith("int") & ~low.contains("unsigned"))
    order = F.when(low.contains("lsb") | low.contains("little"), F.lit("<")).otherwise(F.lit(">"))
    return F.when(bits == 8, F.lit("u1")).otherwise(F.concat(order, F.when(signed, F.lit("i")).otherwise(F.lit("u")), (bits / 8).cast("int").cast("string")))


def coerced_number(c: Column) -> Column:
    """A number of CSV text: blank is null, what is no number is null too (see unparsed)."""
    return F.nullif(F.trim(c), F.lit("")).try_cast("double")


def coerced_boolean(c: Column) -> Column:
    """true or false in any case; all else is null (see unparsed_boolean)."""
    low = F.lower(c)
    return F.when(low == "true", True).when(low == "false", False)


def unparsed(c: Column) -> Column:
    """The text of a number column that is neither blank nor a number."""
    return F.when((F.trim(c) != "") & c.try_cast("double").isNull(), c)


def unparsed_boolean(c: Column) -> Column:
    """The text of a truth column that is neither empty nor a truth value."""
    return F.when((c != "") & coerced_boolean(c).isNull(), c)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/\\\\]*)$", 1)


def stem(path: Column) -> Column:
    """Last part of a path without its suffix."""
    return F.regexp_replace(basename(path), "(?<=.)\\.[^.]*$", "")


def safe_suffix(name: Column, media_type: Column) -> Column:
    """The suffix of an upload if allowed, else that of its media type, else .bin."""
    own = F.lower(F.regexp_extract(name, "(\\.[^./\\\\]*)$", 1))
    kinds = F.create_map(*(F.lit(x) for kv in MEDIA_SUFFIXES.items() for x in kv))
    return F.when(own.isin(*SUFFIXES), own).otherwise(F.coalesce(F.element_at(kinds, F.lower(media_type)), F.lit(".bin")))


def geometry_path(path: Column) -> Column:
    """Where the geometry grid of an image is: the last /data/ becomes /geometry/, the image mark
    becomes the grid mark, the suffix .csv. Null for paths without /data/."""
    moved = F.regexp_replace(path, "^(.*)/data/", "$1/geometry/")
    return F.when(path.contains("/data/"), F.regexp_replace(F.replace(moved, F.lit("_d_img_"), F.lit("_g_grd_")), "\\.[^./]*$", ".csv"))


def label_path(path: Column) -> Column:
    """The sibling label of an image file."""
    return F.regexp_replace(path, "\\.[^./]*$", ".xml")


# What a label must tell for exact camera geometry, with the words that tell it (a dot is
# any character but a line feed), and what is missing where there is no label.
CAMERA_METADATA = [
    ("spacecraft_position", "(?id)spacecraft.*position|sub.*spacecraft"),
    ("attitude_reference_frame", "(?id)attitude.*reference|reference.*frame"),
    ("camera_principal_point", "(?id)principal.*point|optical.*axis"),
    ("lens_distortion_model", "(?id)distortion"),
    ("camera_to_spacecraft_boresight_alignment", "(?id)boresight|camera.*alignment|payload.*alignment"),
]
NO_LABEL = ("source_PDS4_label", "spacecraft_position", "attitude_reference_frame", "camera_principal_point", "lens_distortion_model", "camera_to_spacecraft_boresight_alignment")


def missing_metadata(label: Column, required_words: Sequence[tuple[str, str]] = CAMERA_METADATA, orbit: Column | None = None) -> Column:
    """Names whose words a label's text does not hold, in order; where orbit is true, orbit records tell the
    spacecraft's position. A null label misses all and itself."""
    known = F.coalesce(orbit, F.lit(False)) if orbit is not None else F.lit(False)
    found = [F.when(~(label.rlike(p) | (known if n == "spacecraft_position" else F.lit(False))), F.lit(n)) for n, p in required_words]
    return F.when(label.isNull(), F.array(*map(F.lit, NO_LABEL))).otherwise(F.array_compact(F.array(*found)))


def is_unavailable(c: Column) -> Column:
    """Null, blank, or a word for nothing."""
    return c.isNull() | c.cast("string").isin("", "unavailable", "None", "null")


def fixed_text(c: Column, places: int) -> Column:
    """A number with that many places (0 to 2), rounded by its exact value; halves go away from zero."""
    pattern = "0." + "0" * places if places else "0"
    half = F.abs(c * (1 << (places + 1))) % 2 == 1
    moved = F.when(half, c + F.signum(c) * 10.0 ** -(places + 1)).otherwise(c)
    return F.call_function("format_number", moved.cast("double") + F.lit(0.0), F.lit(pattern))


def percent_text(c: Column, places: int = 2) -> Column:
    return F.when(c.isNull(), F.lit("—")).otherwise(F.concat(fixed_text(c * 100, places), F.lit("%")))


def unit_text(c: Column, unit: str, places: int = 2) -> Column:
    return F.when(c.isNull(), F.lit("—")).otherwise(F.concat(fixed_text(c, places), F.lit(f" {unit}")))


def cell_text(c: Column, places: int = 2) -> Column:
    return F.when(c.isNull(), F.lit("Not available")).otherwise(fixed_text(c, places))


def status_text(c: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in STATUS_TEXTS.items() for x in kv))
    return F.when(is_unavailable(c), F.lit("—")).otherwise(F.coalesce(F.element_at(names, c), c))


def file_size_text(n: Column) -> Column:
    """Bytes as KB, from a MiB on as MB; a dash for none."""
    d = n.cast("double")
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit("—")).when(n < 1048576, F.concat(fixed_text(d / 1024, 0), F.lit(" KB"))).otherwise(F.concat(fixed_text(d / 1048576, 1), F.lit(" MB")))


def stage_label(stage: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in STAGE_LABELS.items() for x in kv))
    return F.coalesce(F.element_at(names, stage), F.replace(stage, F.lit("_"), F.lit(" ")))


def is_run_id(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{32}$"), F.lit(False))


def row_matches(columns: Sequence[Column], query: str) -> Column:
    """Whether any column, as text, holds the query, in any case; a blank query fits all rows."""
    words = query.strip().lower()
    if not words:
        return F.lit(True)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c.cast("string")).contains(words), F.lit(False))
    return hit
