"""Importance resampling of documents towards a target corpus.

Features are hashed runs of words. A bucket's gain is how much likelier the target holds it than the
documents do; a document's weight is the mean gain of its features; Gumbel noise from its id turns
the highest weights into a draw without replacement.

A document's features are an array of buckets, made by higher-order functions and written once.
Scoring folds the array over the gains, which are one literal array of the plan: no row is exploded
and nothing is joined. What is shuffled are totals: counts of buckets and counts of scores, both
combined in each task first.

Ranks over all documents come without a global sort: scores are integers of a bounded span (see
SPAN), so their counts fit the driver, which finds the last score that is drawn and the first rank
of each score above it. Only drawn rows are shuffled, by score, and numbered inside it.

Defined results: null and empty texts, and texts without a word, have no features and weight 0; they
get a score but are never drawn, as texts of under `least` words. A null id hashes like an empty one
and comes last among equal scores. Repeated rows each get a rank of their own; rows that are equal
in all that is returned are counted and numbered together, so a row that stands a million times is
one row of a sort. An empty target leaves gains of smoothing alone. Other columns of any name are not looked at.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitweave.llm.common import counted_out, written

#: Words of the lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
SEED = "2024"
#: Noise lies between -3,130 and 22,873, since h is one of 2**32 values. A gain is a thousand logarithms
#: of a ratio of counts: of 10**15 features it stays within 35,000 on either side. So there are
#: fewer than SPAN scores, whatever the number of documents.
SPAN = 100_000


def features(text: Column, longest: int = 1, buckets: int = BUCKETS) -> Column:
    """array<int>: the buckets of all runs of 1 to longest consecutive words, joined by a space."""
    words = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), F.lit(WORD), F.lit(0))
    bucket = lambda run: F.pmod(F.crc32(run.cast("binary")), F.lit(buckets)).cast("int")
    if longest == 1:
        return F.transform(words, bucket)

    def runs(w: Column, k: int) -> Column:
        starts = F.when(F.size(w) >= k, F.sequence(F.lit(1), F.size(w) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: bucket(F.array_join(F.slice(w, i, k), " ")))

    # the words are made once
    return F.transform(F.array(words), lambda w: F.concat(F.transform(w, bucket), *(runs(w, k) for k in range(2, longest + 1))))[0]


def totals(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket stands in the arrays of rows; at most `buckets` rows reach the driver."""
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows.select(F.explode("features").alias("bucket")).groupBy("bucket").count().collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousand logarithms, rounded down, of the smoothed shares of the target over those of the source."""
    s, t, n = source.astype(float), target.astype(float), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """rows with n_features and weight: the mean gain of a document's features, rounded down."""
    held = F.lit(np.asarray(gain, np.int64))
    total = F.aggregate("features", F.lit(0).cast("long"), lambda sum_, b: sum_ + F.element_at(held, b + 1))
    rows = rows.withColumns({"n_features": F.size("features").cast("long"), "_total": total})
    return rows.withColumn("weight", F.expr("CASE WHEN n_features > 0 THEN (_total - pmod(_total, n_features)) div n_features ELSE 0L END")).drop("_total")


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of SHA-256 of 'seed:doc_id'."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, fits: Column, percent: int) -> DataFrame:
    """scored (doc_id, n_features, weight, score, written) with rank: from 1 over the floor(percent
    in a hundred) rows with the highest score among those that fit, null for the others."""
    spark = scored.sparkSession
    counts = scored.where(fits).groupBy("score").count().toArrow()
    score, n = counts["score"].to_numpy(), counts["count"].to_numpy()
    order = np.argsort(-score)
    score, n = score[order], n[order]
    drawn = int(n.sum()) * percent // 100
    before = np.cumsum(n) - n
    open_ = before < drawn
    if not open_.any():
        return scored.withColumn("rank", F.lit(None).cast("long"))
    last = int(score[open_][-1])
    # at most SPAN rows
    starts = spark.createDataFrame(pa.table({"_score": score[open_], "_before": before[open_]}))
    own = ["doc_id", "n_features", "weight", "score"]
    taken = F.coalesce(fits & (F.col("score") >= last), F.lit(False))
    some = scored.where(taken).groupBy(*own).agg(F.count(F.lit(1)).alias("_copies")).join(F.broadcast(starts), F.col("score") == F.col("_score"))
    inside = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight").rowsBetween(Window.unboundedPreceding, -1)
    some = some.withColumn("_first", F.col("_before") + F.coalesce(F.sum("_copies").over(inside), F.lit(0)) + 1)
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    return counted_out(some, own, "_first", "_copies", "rank").withColumn("rank", rank).unionByName(
        scored.where(~taken).select(*own, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: str = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null for those that are
    not drawn. target: a table with the same text column."""
    held = written(docs.select(F.col(doc_id).alias("doc_id"), features(F.col(text), longest, buckets).alias("features")), "features")
    gain = gains(totals(held, buckets), totals(target.select(features(F.col(text), longest, buckets).alias("features")), buckets))
    rows = weighed(held, gain)
    # of n words there are n + (n - 1) + ... features, which grows with n
    fits = F.col("n_features") >= sum(least - k for k in range(min(longest, least)))
    scored = written(rows.select("doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score")), "scores")
    return ranked(scored, fits, percent)
