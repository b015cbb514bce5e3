"""The store of runs: each once, whatever comes twice; lookups that read few folders."""

import pytest
from pyspark.sql import functions as F

from orbitweave.operators import run_store as rs


@pytest.fixture(scope="module")
def runs(spark):
    rows = spark.range(400).select(F.md5(F.col("id").cast("string")).alias("run_id"), F.timestamp_seconds(F.col("id") * 100_000 + 1_700_000_000).alias("created_at"), F.lit("completed").alias("status"))
    return spark.createDataFrame(rows.collect(), "run_id string, created_at timestamp, status string")


def ids(df):
    return [r["run_id"] for r in df.collect()]


def test_what_comes_twice_is_stored_once(spark, runs, tmp_path):
    path = (tmp_path / "store").as_uri()
    again = runs.withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 40 DAYS"))  # another month, the same run
    early = runs.where("created_at < '2024-03-20'")
    n = early.count()
    assert 0 < n < 400 and rs.append(early, path) == n and rs.append(runs, path) == 400 - n and rs.append(again, path) == 0
    stored = rs.read(spark, path, runs.schema)
    assert sorted(map(tuple, stored.select(*runs.columns).collect())) == sorted(map(tuple, runs.collect()))
    odd = spark.createDataFrame([(None, None, "x"), ("f" * 32, None, "b"), ("f" * 32, None, "a"), ("f" * 32, runs.first()["created_at"], "newest")], runs.schema)
    assert rs.append(odd, path) == 1 and rs.by_id(rs.read(spark, path, runs.schema), "f" * 32).first()["status"] == "newest"
    assert rs.read(spark, path + "-none", runs.schema).count() == 0


def test_lookups_read_few_folders(spark, runs, tmp_path):
    path = (tmp_path / "store").as_uri()
    rs.append(runs, path)
    stored = rs.read(spark, path, runs.schema)
    wanted = ids(runs)[77]
    found = rs.by_id(stored, wanted)
    assert ids(found) == [wanted]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(run_id)" in plan
    with pytest.raises(ValueError):
        rs.by_id(stored, "x' OR 1=1")
    order = [r["run_id"] for r in sorted(runs.collect(), key=lambda r: r["created_at"], reverse=True)]
    newest = rs.recent(stored, 20, 5)
    assert ids(newest) == order[5:25] and "month" in newest._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [", 1)[1].split("]")[0]
    assert len(ids(rs.recent(stored, 500))) == 100 and ids(rs.recent(stored, 100, 380)) == order[380:]


def test_batches_of_a_stream(spark, runs, tmp_path):
    source, path = str(tmp_path / "in"), (tmp_path / "store").as_uri()
    for k in range(3):  # files that overlap
        runs.where(F.col("created_at") < F.timestamp_seconds(F.lit(1_700_000_000 + 14_000_000 * (k + 1)))).coalesce(1).write.mode("append").parquet(source)
    for k in range(2):  # the second time without what the stream knows of the first
        query = rs.stream(spark.readStream.schema(runs.schema).option("maxFilesPerTrigger", 1).parquet(source), path, (tmp_path / f"at{k}").as_uri())
        query.processAllAvailable()
        query.stop()
    stored = ids(rs.read(spark, path, runs.schema))
    assert len(stored) == len(set(stored)) == 400


def test_a_store_that_fails_does_not_fail_the_run(runs, tmp_path):
    assert rs.persisted(runs, (tmp_path / "s").as_uri()) == {"status": "stored", "stored": 400}
    record = rs.persisted(runs, "nosuchscheme://x/y")
    assert record["status"] == "unavailable" and record["reason"]
