"""Weighted rendezvous hashing of stable record keys over shards [native].

Every (key, shard) pair gets a uniform number u from MD5 and the score -weight / ln(u); the shard
with the highest score takes the key. A new shard can only win keys for itself, and a key moves
only if the new shard wins it, so growing from n to n + 1 equal shards moves 1 / (n + 1) of the
records. Only DataFrame functions are used.

Slots (gapless numbers inside a shard) come from counts, not from one sort per shard: rows are
first aggregated by key (so a key that holds a third of all rows is one row), a shard is split
into hash ranges, BUCKETS or more so that none has over about RANGE rows of all shards, offsets are a
running sum over the (shard, bucket) counts, and rows are numbered inside a bucket.

Defined results: a null key hashes as the empty string. Null text: 0 bytes, CRC-32 0. Repeated
rows get slots of their own; ties are between rows equal in all columns, which are
interchangeable. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash ranges inside a shard, at least, and rows of a range in all shards together; each is numbered by
#: one task-local sort.
BUCKETS, RANGE = 256, 4_000_000
#: Copies of one key that a single row is expanded to in one step; the rest is spread over tasks.
RUN = 4096


def uniform(key: Column, shard: int) -> Column:
    """In (0, 1), from the first 13 hexadecimal digits (52 bits) of md5('shard:key')."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{shard}:"), key).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (int, from 0) that takes key. Equal scores, which 52 bits make unlikely, go to
    the lower shard. With equal weights the digits themselves decide, without logarithms."""
    if not weights or min(weights) <= 0:
        raise ValueError("shard weights must be positive")
    key = F.coalesce(key.cast("string"), F.lit(""))
    if len(set(weights)) == 1:
        scores = [F.struct(F.substring(F.md5(F.concat(F.lit(f"{s}:"), key).cast("binary")), 1, 13).alias("u"), F.lit(-s).alias("s")) for s in range(len(weights))]
    else:
        scores = [F.struct((F.lit(-float(w)) / F.ln(uniform(key, s))).alias("u"), F.lit(-s).alias("s")) for s, w in enumerate(weights)]
    return (-F.array_max(F.array(*scores))["s"]).cast("int")


def assign_shards(df: DataFrame, key: str, weights: list[float], into: str = "shard") -> DataFrame:
    """Adds the shard of each row, in place of a column of that name; row-local, without a shuffle."""
    return df.withColumn(into, rendezvous(F.col(key), weights))


def numbered(rows: DataFrame, shard: str, by: list[str], into: str = "slot", range_: int = RANGE) -> DataFrame:
    """rows (read several times, so best written) with gapless numbers from 0 inside each shard, in the
    order of (hash range, by). by: columns that tell rows apart; rows equal in all columns are counted, then expanded."""
    own = list(rows.columns)
    buckets = max(BUCKETS, rows.count() // range_)
    bucket = F.conv(F.substring(F.md5(F.coalesce(F.col(by[0]).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % buckets
    counted = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_bucket", bucket)
    inside = Window.partitionBy(shard, "_bucket").orderBy(*by)
    counted = counted.withColumn("_first", F.sum("_copies").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    starts = (
        rows.withColumn("_bucket", bucket).groupBy(shard, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.sum("_n").over(Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select(F.col(shard).alias("_shard"), F.col("_bucket").alias("_b"), "_start")
    )
    # starts has at most shards x buckets rows: one for some thousands of the input's
    held = F.broadcast(starts) if buckets == BUCKETS else starts
    placed = counted.join(held, (F.col(shard) == F.col("_shard")) & (F.col("_bucket") == F.col("_b")))
    first = F.coalesce("_first", F.lit(0)) + F.coalesce("_start", F.lit(0))
    runs = placed.select(*own, first.alias("_first"), "_copies").select(
        *own, "_first", "_copies", F.explode(F.expr(f"sequence(0L, (_copies - 1) div {RUN})")).alias("_run"))
    copies = F.expr(f"sequence(_first + _run * {RUN}, _first + least(_copies, (_run + 1) * {RUN}) - 1)")
    return runs.select(*own, F.explode(copies).alias(into))
