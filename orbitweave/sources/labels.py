"""Labels of image products: `KEY = VALUE` text labels and XML labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave.functions import text as t


def fields(lines: DataFrame, line: str = "value", order: str = "line_no", by: list[str] | None = None) -> DataFrame:
    """(by..., key, value, number): the last value of each key. Lines that are no field are left
    out; number is null where the value is none."""
    own = [F.col(b) for b in by or []]
    rows = lines.select(*own, t.label_key(F.col(line)).alias("key"), t.label_value(F.col(line)).alias("value"), t.label_number(F.col(line)).alias("number"), F.col(order).alias("_o")).where(F.col("key").isNotNull())
    last = rows.groupBy(*(by or []), "key").agg(F.max_by(F.struct("value", "number"), "_o").alias("_v"))
    return last.select(*own, "key", F.col("_v")["value"].alias("value"), F.col("_v")["number"].alias("number"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, labels): a map of all fields of each text label of a path."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\r\n|\r|\n")).alias("line_no", "value"))
    rows = fields(files, "value", "line_no", ["path"])
    return rows.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("labels"))


def raster_layout(labels: DataFrame) -> DataFrame:
    """Columns of a raster from its label map: lines, samples, dtype, scaling, offset, dummy. The
    scaling is told, not applied."""
    at = lambda k: F.try_element_at("labels", F.lit(k))
    number = lambda *keys: F.coalesce(*(at(k).try_cast("double") for k in keys))
    bits = F.coalesce(number("SAMPLE_BITS").cast("int"), F.lit(8))
    return labels.select("path", number("LINE_LAST_PIXEL", "LINES").cast("int").alias("lines"), number("SAMPLE_LAST_PIXEL", "LINE_SAMPLES").cast("int").alias("samples"), t.sample_type(F.coalesce(at("SAMPLE_TYPE"), F.lit("")), bits).alias("dtype"), F.coalesce(number("SCALING_FACTOR"), F.lit(1.0)).alias("scaling"), F.coalesce(number("OFFSET"), F.lit(0.0)).alias("offset"), number("DUMMY").alias("dummy"))


def xml_layout(spark: SparkSession, path: str) -> DataFrame:
    """The same columns from XML labels: the first array of two or three axes, axes by their sequence
    number (a third, slower axis is the band), data type with its bytes. Name spaces are dropped."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace(F.regexp_replace("value", "<(/?)[A-Za-z0-9_.-]+:", "<$1"), "\\sxmlns(:[A-Za-z0-9]+)?=\"[^\"]*\"", "").alias("x"))
    array = "//*[self::Array_2D or self::Array_2D_Image or self::Array_3D or self::Array_3D_Image or self::Array_2D_Map]"
    axis = F.expr(f"xpath(x, '{array}[1]/Axis_Array/elements/text()')")
    number = F.expr(f"xpath(x, '{array}[1]/Axis_Array/sequence_number/text()')")
    axes = F.transform(F.array_sort(F.arrays_zip(number.alias("n"), axis.alias("e"))), lambda a: a["e"].try_cast("int"))
    kind = F.expr(f"xpath_string(x, '{array}[1]/Element_Array/data_type')")
    bits = t.sample_bits(kind)
    return files.withColumn("_a", axes).select("path", F.try_element_at("_a", F.lit(-2)).alias("lines"), F.try_element_at("_a", F.lit(-1)).alias("samples"), F.when(F.size("_a") > 2, F.col("_a")[0]).otherwise(1).alias("bands"), t.sample_type(kind, bits).alias("dtype"), F.expr(f"xpath_string(x, '{array}[1]/offset')").try_cast("long").alias("byte_offset"), F.expr("xpath_string(x, '//file_name')").alias("file_name"))
