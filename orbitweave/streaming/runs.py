"""A stream of run documents: each run once, counts by status and time, late runs up to a bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "run_id string, created_at timestamp, status string, total_seconds double"


def read(spark: SparkSession, path: str, schema: str = SCHEMA, files_per_trigger: int = 100) -> DataFrame:
    """Documents of Parquet files as they come to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def unique(runs: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each run_id once within the bound of lateness; the state is dropped beyond it."""
    return runs.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["run_id"])


def counts(runs: DataFrame, window: str = "1 day") -> DataFrame:
    """Runs and mean seconds by window and status; runs must have a watermark."""
    w = F.window("created_at", window)
    return runs.groupBy(w.alias("window"), "status").agg(F.count(F.lit(1)).alias("runs"), F.avg("total_seconds").alias("mean_seconds")).select(F.col("window")["start"].alias("window_start"), "status", "runs", "mean_seconds")


def start(runs: DataFrame, path: str, checkpoint: str):
    """Appends to a Parquet store with exactly-once files; the checkpoint must be on a shared store."""
    return runs.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").start(path)
