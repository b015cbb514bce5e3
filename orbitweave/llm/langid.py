"""Language identification by the nearest of several centroids per language.

A text is lower-cased, everything but letters becomes one space, and its character n-grams (1 to 3)
are hashed into BUCKETS features, weighted log(1 + count) x idf and normalised. Each language's
training vectors are clustered by spherical k-means into CENTROIDS centroids; a text gets the
language of the centroid with the highest cosine. A text farther from its nearest centroid than
nearly all training texts of that language are from theirs is marked as rejected.

All languages that occur are learnt. The inverse document frequencies count all learnable documents
in one pass; centroids come from SAMPLE distinct texts of each language at most, those that hash
lowest, each language in a task of its own. Centroids go out in blocks of AT_ONCE languages, one pass
over the texts for each block, so that what is broadcast has a bound however many languages there
are; the best cosine over all blocks is kept.

Defined results: null texts, and texts without a letter, are 'und' with score 0. Without training
documents all are. Ties go to the language that sorts first. Repeated rows are judged each, and
learnt from once. A very long text is folded slice by slice, so that memory stays bounded. Columns
that are kept must not have the names of the new ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitweave.llm.common import arrow_map, free_of, texts_of, written

BUCKETS = 1 << 14
SIZES = (1, 2, 3)
SAMPLE = 600
CENTROIDS = 4
#: Languages in a block of centroids: 256 x 4 x 64 KB.
AT_ONCE = 256
#: Chosen texts that are sent to all executors at most; with more, they are joined by a shuffle.
BROADCAST_TEXTS = 1_000_000
#: Languages whose numbers of texts are sent to all executors; with more, a merge join splits hot ones.
BROADCAST_LANGUAGES = 10_000
#: The share of a language's own training texts that its rejection distance would turn away.
REJECT = 0.005
SLICE = 1_000_000
UNDETERMINED = "und"

_letters: list[np.ndarray] = []


def folded(text: str) -> np.ndarray:
    """Code points of the lower-cased text, runs of other than letters as one space (0); empty if
    there is no letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters[0][code]
    if not letter.any():
        return np.zeros(0, np.uint32)
    keep = letter | np.concatenate(([False], letter[:-1]))
    code = np.where(letter, code, 0)[keep]
    return np.concatenate(([0], code, [0] if code[-1] else [])).astype(np.uint32)


def counts(text: str) -> np.ndarray | None:
    """n-gram counts of a whole text by bucket; None without a letter."""
    code = folded(text)
    if not len(code):
        return None
    out = np.zeros(BUCKETS, np.float32)
    for at in range(0, len(code), SLICE):
        part = code[at : at + SLICE + max(SIZES) - 1].astype(np.uint64)
        h = np.zeros(len(part), np.uint64)
        for n in range(1, max(SIZES) + 1):
            stop = min(SLICE, len(part) - n + 1)
            if stop <= 0:
                break
            # the n-gram that starts at each place, from the one a letter shorter
            h = h[: len(part) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + part[n - 1 :] + np.uint64(n)
            if n in SIZES:
                bucket = ((h[:stop] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 14)).astype(np.int64)
                out += np.bincount(bucket, minlength=BUCKETS)
    return out


@dataclass
class Block:
    """The centroids of some languages, in the languages' order."""

    langs: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    #: The least cosine of each language that is not rejected.
    floor: np.ndarray

    def predict(self, texts: list[str], best: np.ndarray, found: list[str], rejected: np.ndarray) -> None:
        """Takes over those texts that have a higher cosine here than the best so far."""
        for at in range(0, len(texts), 64):
            got = [(at + k, c) for k, t in enumerate(texts[at : at + 64]) if (c := counts(t)) is not None]
            if not got:
                continue
            cosine = unit(np.log1p(np.stack([c for _, c in got])) * self.idf) @ self.centroids.T
            for (i, _), k, x in zip(got, cosine.argmax(1), cosine.max(1), strict=True):
                if found[i] == UNDETERMINED or x > best[i]:
                    best[i], found[i], rejected[i] = x, self.langs[self.owner[k]], x < self.floor[self.owner[k]]


@dataclass
class Model:
    """langs, sorted; idf; and the written table of centroids (lang, k, vector, floor)."""

    langs: list[str]
    idf: np.ndarray
    table: DataFrame | None

    def blocks(self) -> Iterator[Block]:
        for at in range(0, len(self.langs), AT_ONCE):
            langs = self.langs[at : at + AT_ONCE]
            rows = sorted(self.table.where(F.col("lang").isin(langs)).collect(), key=lambda r: (r["lang"], r["k"]))  # AT_ONCE x CENTROIDS at most
            owner = np.array([langs.index(r["lang"]) for r in rows], int)
            floor = np.zeros(len(langs))
            floor[owner] = [r["floor"] for r in rows]
            yield Block(langs, owner, np.stack([np.frombuffer(r["vector"], "<f4") for r in rows]), self.idf, floor)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of unit rows; the starts are rows far from those chosen before."""
    first = int((x @ x.mean(0)).argmax())
    chosen, near = [first], x @ x[first]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = unit(np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))]))
    return c


def chosen_texts(docs: DataFrame, sample: int) -> DataFrame:
    """docs: (lang, text). (lang, hash) of at most sample distinct texts of each language: those that hash
    lowest. A language is first thinned by its number of texts, so that none is sorted whole."""
    texts = written(docs.select("lang", F.xxhash64("text").alias("hash")).distinct(), "texts")
    sizes = written(texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_LANGUAGES else sizes.hint("merge")
    share = (F.shiftrightunsigned("hash", 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    some = texts.join(sizes, "lang").where(share * F.col("n") < 2 * sample + 20)
    return some.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("hash", 11), "hash"))).where(F.col("_r") <= sample).select("lang", "hash")


def features(docs: DataFrame) -> DataFrame:
    """docs: (lang, text, hash), hash null for texts that were not chosen. Rows (bucket, n) with the number
    of texts that have a feature, for each task; and rows (lang, hash, at, count) of chosen texts."""
    names = ["bucket", "n", "lang", "hash", "at", "count"]
    types = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total, seen = np.zeros(BUCKETS, np.int64), 0, set()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for lang, text, h in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                if (c := counts(text)) is None:
                    continue
                df += c > 0
                total += 1
                if h is not None and (lang, h) not in seen:
                    seen.add((lang, h))
                    at = np.flatnonzero(c)
                    for column, x in zip(out, (lang, h, at.astype("<u2").tobytes(), c[at].astype("<f4").tobytes()), strict=True):
                        column.append(x)
            if out[0]:
                none = [None] * len(out[0])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((none, none, *out), types, strict=True)], names=names)
        some = np.flatnonzero(df)
        rows = [*some.tolist(), BUCKETS], [*df[some].tolist(), total]  # the last row tells how many texts
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((*rows, *([[None] * len(rows[0])] * 4)), types, strict=True)], names=names)

    return arrow_map(docs, run, "bucket int, n bigint, lang string, hash bigint, at binary, count binary")


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """docs: only those that may be learnt from."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    chosen = written(chosen_texts(known, sample), "chosen")
    few = chosen.count() <= BROADCAST_TEXTS
    own = chosen.select(F.col("lang").alias("_l"), "hash")
    found = known.join(F.broadcast(own) if few else own.hint("merge"), (F.col("lang") == F.col("_l")) & (F.xxhash64("text") == F.col("hash")), "left").select("lang", "text", "hash")
    rows = written(features(found), "features")
    counted = {r["bucket"]: r["n"] for r in rows.where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # BUCKETS + 1 rows
    df = np.zeros(BUCKETS)
    for k, n in counted.items():
        if k < BUCKETS:
            df[k] = n
    idf = (np.log((1 + counted.get(BUCKETS, 0)) / (1 + df)) + 1).astype(np.float32)
    vectors = rows.where(F.col("hash").isNotNull()).dropDuplicates(["lang", "hash"]).select("lang", "at", "count")

    def cluster(key: tuple, table: pa.Table) -> pa.Table:
        got = sorted(zip(table.column("at").to_pylist(), table.column("count").to_pylist(), strict=True))  # sample at most
        x = np.zeros((len(got), BUCKETS), np.float32)
        for i, (at, n) in enumerate(got):
            x[i, np.frombuffer(at, "<u2")] = np.frombuffer(n, "<f4")
        x = unit(np.log1p(x) * idf)
        c = clusters(x, centroids)
        floor = float(np.quantile((x @ c.T).max(1), REJECT))
        return pa.table({"lang": pa.array([key[0].as_py()] * len(c), pa.string()), "k": pa.array(range(len(c)), pa.int32()), "vector": pa.array([v.astype("<f4").tobytes() for v in c], pa.binary()), "floor": pa.array([floor] * len(c), pa.float64())})

    table = written(vectors.groupBy("lang").applyInArrow(cluster, "lang string, k int, vector binary, floor double"), "centroids")
    return Model(sorted(r["lang"] for r in table.select("lang").distinct().collect()), idf, table)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (default: all) of docs with lang_pred, score (cosine to the nearest
    centroid) and rejected. A column of docs that has one of these names is not kept: the new ones win."""
    keep = free_of(docs.columns if keep is None else keep, ("lang_pred", "score", "rejected"))
    source = docs.select(F.col(text).cast("string").alias("_text"), *(F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)))
    out = source.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0), "rejected": F.lit(False)})
    for block in model.blocks():
        out = _pass(out, docs.sparkSession.sparkContext.broadcast(block))
    return out.select(*(F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)), "lang_pred", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")).alias("score"), "rejected")


def _pass(docs: DataFrame, held) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, best, rejected = (batch.column(k).to_pylist() for k in range(batch.num_columns - 3, batch.num_columns))
            best, rejected = np.array(best, np.float64), np.array(rejected, bool)
            held.value.predict(texts_of(batch.column(0)), best, found, rejected)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(found, pa.string()), pa.array(best), pa.array(rejected)], names=batch.schema.names)

    return arrow_map(docs, run, docs.schema)
