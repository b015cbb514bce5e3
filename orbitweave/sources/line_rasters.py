"""Binary rasters with a label, line by line: a file of any size is read by many tasks.

A raster without a header is lines of one length, so Hadoop's fixed-length records are its lines: a file is
split where the store splits it, on any store that Spark reads, and no task holds more than its
lines. The file's size must be that of its label to the byte; a raster whose size or label is
wrong, or that is not there, is a row that says so, and the others are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave import workers

PIXELS = "image_id long, y long, x long, v double"
ISSUES = "image_id long, path string, reason string"
FORMAT = "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat"
#: Bytes of a file that one task reads, about.
SPLIT = 64 << 20


@dataclass(frozen=True)
class Layout:
    """What a label says of a raster (sources.labels.raster_layout)."""

    image_id: int
    path: str
    lines: int | None
    samples: int | None
    dtype: str | None

    def wrong(self, size: int | None) -> str | None:
        """Why a file of that size can't be read; None if it can."""
        if not self.lines or not self.samples or not self.dtype:
            return "label_incomplete"
        try:
            need = self.lines * self.samples * np.dtype(self.dtype).itemsize
        except TypeError:
            return "sample_type_unknown"
        if size is None:
            return "file_missing"
        return None if size == need else f"size_{size}_label_{need}"


def size_of(spark: SparkSession, path: str) -> int | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.getFileStatus(at).getLen() if store.exists(at) else None


def lines_of(spark: SparkSession, layout: Layout, split: int = SPLIT) -> DataFrame:
    """(image_id, y, data): the lines of a raster whose size has been checked."""
    length = layout.samples * np.dtype(layout.dtype).itemsize
    conf = {"fixedlengthinputformat.record.length": str(length), "mapreduce.input.fileinputformat.split.maxsize": str(max(length, split // length * length))}
    found = spark.sparkContext.newAPIHadoopFile(layout.path, FORMAT, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf)
    number = layout.image_id
    # the key of a record is its place in the file
    return found.map(lambda r: (number, r[0] // length, bytearray(r[1]))).toDF("image_id long, y long, data binary")


def pixels_of(lines: DataFrame, dtype: str) -> DataFrame:
    """Pixels of lines of one sample type."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, y, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                v = np.frombuffer(data, dtype).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), image)), pa.array(np.full(len(v), y)), pa.array(np.arange(len(v))), pa.array(v)], names=["image_id", "y", "x", "v"])

    workers.prepare(lines.sparkSession)
    return lines.mapInArrow(run, PIXELS)


def read(spark: SparkSession, layouts: Sequence[Layout], split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """Pixels of all rasters that can be read, and a row for each that can't. layouts: one for each file, of which
    there are as many as a driver may list."""
    out, issues = spark.createDataFrame([], PIXELS), []
    by_type: dict[str, DataFrame] = {}
    for layout in layouts:
        why = layout.wrong(size_of(spark, layout.path))
        if why:
            issues.append((layout.image_id, layout.path, why))
            continue
        lines = lines_of(spark, layout, split)
        by_type[layout.dtype] = by_type[layout.dtype].unionByName(lines) if layout.dtype in by_type else lines
    for dtype, lines in by_type.items():
        out = out.unionByName(pixels_of(lines, dtype))
    return out, spark.createDataFrame(issues, ISSUES)


def layouts_of(labels: DataFrame) -> list[Layout]:
    """Layouts from a table (image_id, path, lines, samples, dtype)."""
    return [Layout(r["image_id"], r["path"], r["lines"], r["samples"], r["dtype"]) for r in labels.select("image_id", "path", "lines", "samples", "dtype").collect()]


def covered(pixels: DataFrame) -> DataFrame:
    """Per image: pixels, lines and samples that were read."""
    return pixels.groupBy("image_id").agg(F.count(F.lit(1)).alias("pixels"), (F.max("y") + 1).alias("lines"), (F.max("x") + 1).alias("samples"))
