"""Tables that are written between steps."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where the session has none, a run on one
    machine (a test) gets a local folder; a cluster would lose what executors write there, so that is an
    error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = Path(tempfile.gettempdir(), "orbitweave-shared").resolve().as_uri()
    return folder.rstrip("/")


_paths: list[str] = []


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; clear_written removes what comes to stand there."""
    _paths.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _paths[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again. That cuts the lineage: a lost
    executor costs a re-read of the file, not a recomputation, and non-deterministic row ids are
    fixed once and for all. The files stay until clear_written or the folder's owner removes them."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_written(spark: SparkSession) -> int:
    """Removes the tables that this process has written; how many. Only when no result that reads them is
    needed any more: DataFrames are lazy."""
    n = 0
    while _paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(_paths.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
