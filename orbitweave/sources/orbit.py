"""Fixed-width orbit and attitude records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TAG, LENGTH = "ORBTATTD", 587

# First and last (exclusive) character of each field, from 0.
TIME = [(18 + 4 * k, 22 + 4 * k) for k in range(7)]
NUMBERS = {
    "lunar_x_km": (46, 66), "lunar_y_km": (66, 86), "lunar_z_km": (86, 106),
    "px": (106, 126), "py": (126, 146), "pz": (146, 166), "vx": (166, 178), "vy": (178, 190), "vz": (190, 202),
    **{f"{frame}_q{axis}": (start + 14 * k, start + 14 * k + 14) for frame, start in (("body", 202), ("earth", 258), ("moon", 314)) for k, axis in enumerate("xyzw")},
    "sub_latitude": (370, 384), "sub_longitude": (384, 398), "solar_azimuth": (398, 412), "solar_elevation": (412, 426), "footprint_latitude": (426, 440), "footprint_longitude": (440, 454),
    "altitude_km": (454, 466), "emission_angle": (479, 488), "slant_range_km": (506, 516), "fov_velocity_angle": (530, 539), "yaw": (539, 555), "roll": (555, 571), "pitch": (571, 587),
}


def cut(line: Column, first: int, last: int) -> Column:
    return F.trim(F.substring(line, first + 1, last - first))


def record_time(line: Column) -> Column:
    """Year, month, day, hour, minute, second, millisecond as a timestamp without zone (UTC)."""
    y, mo, da, h, mi, s, ms = (cut(line, *p).try_cast("int") for p in TIME)
    return F.try_make_timestamp_ntz(y, mo, da, h, mi, s.cast("decimal(16,6)") + ms.cast("decimal(16,6)") / F.lit(1000).cast("decimal(16,6)"))


def parse_prefix(lines: DataFrame, line: str = "value") -> DataFrame:
    """record_number and time of lines that begin with the tag, whatever their length."""
    c = F.col(line)
    return lines.where(c.startswith(TAG)).withColumns({"record_number": cut(c, 8, 14).try_cast("int"), "time": record_time(c)})


def parse(lines: DataFrame, line: str = "value") -> DataFrame:
    """All fields of full records; malformed (too short, no tag) lines have valid = false and null
    fields, so that one bad line does not end a job."""
    c = F.col(line)
    ok = c.startswith(TAG) & (F.length(c) >= LENGTH)
    fields = {n: F.when(ok, cut(c, *p).try_cast("double")) for n, p in NUMBERS.items()}
    return lines.withColumns({"valid": F.coalesce(ok, F.lit(False)), "record_number": F.when(ok, cut(c, 8, 14).try_cast("int")), "time": F.when(ok, record_time(c)), "orbit_number": F.when(ok, cut(c, 516, 521).try_cast("int")), **fields})


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of all files of a path, with path; other lines are left out by the scan's filter."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), "value")
    return parse(lines.where(F.col("value").startswith(TAG))).drop("value")


def header(first_lines: DataFrame, line: str = "value") -> DataFrame:
    """Fields of a header line; what is no number is null."""
    c = F.col(line)
    return first_lines.withColumns({"record_count": cut(c, 99, 105).try_cast("int"), "record_length": cut(c, 105, 111).try_cast("int"), "attitude_flag": cut(c, 111, 112).try_cast("int"), "phase_flag": cut(c, 112, 113).try_cast("int"), "start_text": cut(c, 43, 71), "end_text": cut(c, 71, 99)})
