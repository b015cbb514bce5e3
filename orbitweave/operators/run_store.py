"""A store of run documents: Parquet files in folders by month and by bucket of run_id.

The bucket is a hash of the id, so a lookup reads one bucket of each month, and of its files the parts whose
ids it can be among, as rows are sorted by id. The newest runs are those of the last months, which
counts of folders tell before any document is read. Months and few buckets, because a file must hold many runs. run_id is unique: an append
leaves out what is there, so a batch that a stream delivers twice is stored once. There is one writer
at a time (a stream, or a job); readers see whole appends.

Defined results: runs without an id are not stored; of runs of one batch with the same id the newest
is. A run without a time is in a month of its own (null) and comes last. A store that does not exist is empty.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, StructField, StructType

from orbitweave.storage import written

BUCKETS = 4
FOLDERS = ["month", "bucket"]
RUN_ID = "[0-9a-f]{32}"


def bucket_of(run_id: Column) -> Column:
    return F.pmod(F.xxhash64(run_id), F.lit(BUCKETS)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The runs of the store; schema: of a run (run_id, created_at and more). Its folders month and bucket are
    columns too."""
    whole = StructType([*schema.fields, StructField("month", DateType()), StructField("bucket", IntegerType())])
    return spark.read.schema(whole).parquet(path) if _exists(spark, path) else spark.createDataFrame([], whole)


def append(runs: DataFrame, path: str) -> int:
    """Stores those runs whose ids are not there yet; how many."""
    spark, schema = runs.sparkSession, runs.schema
    rows = runs.where(F.col("run_id").isNotNull())
    order = F.struct(F.col("created_at").isNotNull(), "created_at", F.hash(*runs.columns), F.to_json(F.struct(*runs.columns)))
    one = rows.groupBy("run_id").agg(F.max_by(F.struct(*runs.columns), order).alias("_r")).select("_r.*")
    new = one.withColumns({"month": F.trunc("created_at", "month"), "bucket": bucket_of(F.col("run_id"))})
    there = read(spark, path, schema).select("bucket", "run_id")
    new = written(new.join(there, ["bucket", "run_id"], "left_anti").select(*runs.columns, *FOLDERS), "runs")
    n = new.count()
    if n:
        # one task for each folder that gets rows, so that a small append is few files
        new.repartition(*FOLDERS).sortWithinPartitions(*FOLDERS, "run_id").write.mode("append").partitionBy(*FOLDERS).parquet(path)
    return n


def persisted(runs: DataFrame, path: str) -> dict[str, object]:
    """append() as a record that never fails the run: status stored, with the number of new runs, or
    unavailable, with the reason."""
    try:
        return {"status": "stored", "stored": append(runs, path)}
    except Exception as error:  # whatever the store raises is its state
        return {"status": "unavailable", "reason": type(error).__name__}


def by_id(runs: DataFrame, run_id: str) -> DataFrame:
    """The run of that id. Only folders of its bucket are read; ValueError for what is no id."""
    if not re.fullmatch(RUN_ID, run_id):
        raise ValueError("a run id is 32 hexadecimal digits")
    bucket = runs.sparkSession.range(1).select(bucket_of(F.lit(run_id))).first()[0]
    return runs.where((F.col("bucket") == bucket) & (F.col("run_id") == run_id))


def recent(runs: DataFrame, limit: int = 20, skip: int = 0) -> DataFrame:
    """Newest first, ties by run_id; limit is kept between 1 and 100, skip at 0 or more. Months whose
    runs would not be shown are not read."""
    limit, skip = min(100, max(1, limit)), max(0, skip)
    held, first = 0, None
    # a row for each month
    for month, n in runs.where(F.col("month").isNotNull()).groupBy("month").count().orderBy(F.desc("month")).toLocalIterator():
        held, first = held + n, month
        if held >= limit + skip:
            break
    shown = runs.where(F.col("month") >= F.lit(first)) if held >= limit + skip else runs
    return shown.orderBy(F.desc_nulls_last("created_at"), "run_id").offset(skip).limit(limit)


def stream(runs: DataFrame, path: str, checkpoint: str):
    """Appends each batch of a stream of runs; a batch that comes again after a failure adds nothing."""
    def store(batch: DataFrame, _: int) -> None:
        append(batch, path)

    return runs.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).start()
