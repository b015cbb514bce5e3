"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are of documents. From a bounded sample of them (SAMPLE documents of each label, those whose
ids hash lowest) Spark counts in how many toxic and other documents each word and word beginning
stands; those that a likelihood-ratio test ties to the toxic ones beyond chance mark tokens of
toxic documents as toxic. A chain model is fitted to these tags on FIT documents of each label and
generalises by beginnings, ends and neighbours. Scoring runs forward and backward over whole texts;
token marginals give offending spans, and the sum of their cubes and their maximum, through a logistic curve fitted to
the sample and moved to the corpus's share of toxic labels, the document's score.

Defined results: null and empty texts have no tokens and get the score of a document without toxic
marginals; without any toxic label nothing is learnt and all scores are the share of toxic labels
(0 without labels). A document with several labels is toxic if one says so; null labels count
for nothing. Repeated rows are scored each. Other columns pass through if asked for, but for those that have
the names of new ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitweave.llm import crf
from orbitweave.llm.common import arrow_map, free_of, spans_of_size, texts_of, written

#: Documents of each label from which words and beginnings are counted, and toxic documents to
#: which the chain model is fitted (with twice as many others, and as many others that hold
#: a marking word).
SAMPLE, FIT = {1: 4000, 0: 8000}, 700
#: Words of each of these three groups after which no further document is taken for the chain model, which
#: one task fits; longer documents are cut into runs of so many words for it.
FIT_TOTAL, FIT_WORDS = 300_000, 2000
#: A token in a span has at least this marginal.
SPAN = 0.5
#: Marginals count in a document's sum by this power, or long texts would collect faint ones.
POWER = 3
CACHE_WORDS = 200_000
THRESHOLD = 0.3
#: How much commoner a marking word or beginning is in toxic documents.
RATIO = 20

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_fold = {c: 32 for c in range(128) if not chr(c).isalnum()}


def words_of(text: str) -> list[str]:
    """Lower-cased runs of digits, letters and other non-ASCII characters."""
    return [w for w in text.lower().translate(_fold).split(" ") if w]


@dataclass
class Model:
    tagger: crf.Tagger
    #: Logistic curve: intercept, weight of the largest marginal, weight of log(1 + sum).
    curve: tuple[float, float, float]

    def score(self, top: np.ndarray, total: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * top + c * np.log1p(total), -30, 30)))


def token_marginals(docs: list[list[str]], tagger: crf.Tagger, cache: dict[str, int], scores: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of all tokens of docs, one after another, and where each document ends."""
    ends = np.cumsum([len(d) for d in docs])
    flat = [w for d in docs for w in d]
    new = list(set(flat) - cache.keys())
    if new:
        cache.update(zip(new, range(len(cache), len(cache) + len(new)), strict=True))
        scores[0] = np.concatenate((scores[0], tagger.scores(new)))
    word = np.fromiter(map(cache.__getitem__, flat), np.int64, len(flat))
    first = np.zeros(len(word), bool)
    first[[e - len(d) for e, d in zip(ends, docs, strict=True) if d]] = True
    return crf.marginals(tagger.emissions(word, scores[0], first), first, tagger.transition, tagger.start), ends


def summaries(docs: list[list[str]], model: Model, cache: dict, scores: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Largest marginal and sum of cubed marginals of each document; all marginals; ends."""
    p, ends = token_marginals(docs, model.tagger, cache, scores)
    some = np.array([len(d) > 0 for d in docs], bool)
    top, total = np.zeros(len(docs)), np.zeros(len(docs))
    if len(p):
        starts = np.array([e - len(d) for e, d in zip(ends, docs, strict=True)])[some]
        top[some], total[some] = np.maximum.reduceat(p, starts), np.add.reduceat(p**POWER, starts)
    return top, total, p, ends


def _ratio(k1: np.ndarray, n1: float, k0: np.ndarray, n0: float) -> np.ndarray:
    """Twice the log-likelihood ratio of two shares being different."""
    def part(k, e):
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(e, 1e-9)), 0)

    share = (k1 + k0) / (n1 + n0)
    return 2 * (part(k1, n1 * share) + part(n1 - k1, n1 * (1 - share)) + part(k0, n0 * share) + part(n0 - k0, n0 * (1 - share)))


def marks(word: str) -> list[str]:
    """What is counted of a word: itself and its beginning of four or more characters."""
    return ["w:" + word, *(f"p{k}:" + word[:k] for k in range(4, 9) if len(word) > k)]


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: dict[int, int] | None = None, fit_docs: int = FIT) -> Model:
    """docs: only those that may be learnt from."""
    sample = sample or SAMPLE
    spark = docs.sparkSession
    said = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("_y"))
    known = written(said.join(docs.select(F.col(doc_id).alias("_id")).distinct(), "_id", "left_semi"), "labels")
    shares = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = shares.get(1, 0) / max(1, sum(shares.values()))
    odds = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    if not shares.get(1) or not shares.get(0):
        return Model(crf.Tagger(), (float(odds), 0.0, 0.0))
    chosen = None
    for y, n in sample.items():
        part = known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most sum(SAMPLE) ids
    rows = written(docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")).join(F.broadcast(chosen), "_id"), "sample")
    n = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}
        for batch in batches:
            for t, y in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                for f in {f for w in set(words_of(t)) for f in marks(w)}:
                    held.setdefault(f, [0, 0])[y] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([x[0] for x in held.values()], pa.int64()), pa.array([x[1] for x in held.values()], pa.int64())], names=["f", "k0", "k1"])

    found = arrow_map(rows.select("_text", "_y"), counted, "f string, k0 bigint, k1 bigint").groupBy("f").agg(F.sum("k0").alias("k0"), F.sum("k1").alias("k1"))
    n1, n0 = n.get(1, 0), n.get(0, 0)
    # the rate among toxic documents must be RATIO times that among others; a bounded sample's features
    found = written(found, "marks")
    n_features = found.count()
    got = found.where((F.col("k1") >= 3) & (F.col("k1") * n0 > RATIO * (F.col("k0") + 0.5) * n1)).toPandas()
    strong = got[_ratio(got.k1.to_numpy(float), n1, got.k0.to_numpy(float), n0) > 2 * np.log(max(2, n_features)) + 4]
    toxic = set(strong.f)

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hard = [y == 0 and any(f in toxic for w in set(words_of(t)) for f in marks(w)) for t, y in zip(texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hard)], names=["_id", "_text", "_y", "_hard"])

    id_type = dict(rows.dtypes)["_id"]
    some = arrow_map(rows.select("_id", "_text", "_y"), flagged, f"_id {id_type}, _text string, _y int, _hard boolean").withColumn("_h", F.xxhash64("_id"))
    some = written(some, "flagged")
    sizes = {(r["_y"], r["_hard"]): r["n"] for r in some.groupBy("_y", "_hard").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = None
    for k, (y, hard) in enumerate(GROUPS):
        part = some.where((F.col("_y") == y) & (F.col("_hard") == hard)).orderBy("_h", "_id").limit(fit_docs * (1 if y or hard else 2))
        part = part.select(F.lit(k).alias("_k"), "_h", "_id", "_text")
        parts = part if parts is None else parts.unionByName(part)
    given = [sizes.get(group, 0) for group in GROUPS]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = chain(((k, t) for b in batches for k, t in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True)), toxic, given, float(odds))
        if model:
            yield pa.RecordBatch.from_arrays(_rows_of(model), names=["name", "w"])

    # the rows are a bounded sample, so that one task may fit them; what comes back are weights
    one = arrow_map(parts.coalesce(1).sortWithinPartitions("_k", "_h", "_id").select("_k", "_text"), learn, "name string, w array<double>").toArrow()
    return _model_of(one) if one.num_rows else Model(crf.Tagger(), (float(odds), 0.0, 0.0))


#: Toxic documents, others, and others with a mark: these teach what a mark alone does not say.
GROUPS = ((1, False), (0, False), (0, True))


def chain(rows: Iterator[tuple[int, str]], toxic: set[str], sizes: list[int], odds: float) -> Model | None:
    """The model from rows (place in GROUPS, text), sorted by group; sizes: how many documents each group has in
    the sample. Of each group documents are taken until they have FIT_TOTAL words."""
    texts, group, total = [], [], [0] * len(GROUPS)
    for k, text in rows:
        if total[k] <= FIT_TOTAL and (d := words_of(text)):
            texts.append(d)
            group.append(k)
            total[k] += len(d)
    if not texts:
        return None
    group = np.array(group)
    ys = np.array([y for y, _ in GROUPS])[group]
    weights = (np.array(sizes) / np.maximum(1, np.bincount(group, minlength=len(GROUPS))))[group]
    tags = [np.array([y == 1 and any(f in toxic for f in marks(w)) for w in d], float) for d, y in zip(texts, ys, strict=True)]
    # a very long document is several runs of the chain, all of them learnt from
    runs = [(d[k : k + FIT_WORDS], t[k : k + FIT_WORDS]) for d, t in zip(texts, tags, strict=True) for k in range(0, len(d), FIT_WORDS)]
    model = Model(crf.fit([d for d, _ in runs], [t for _, t in runs]), (0.0, 0.0, 0.0))
    top, total, _, _ = summaries(texts, model, {}, [np.zeros((0, 3))])
    model.curve = _curve(np.stack([np.ones(len(top)), top, np.log1p(total)], 1), ys, weights / weights.mean(), odds)
    return model


def _rows_of(model: Model) -> list[pa.Array]:
    """A model as names and weights: features, and under names without a colon what belongs to none."""
    t = model.tagger
    rows = {"bias": [t.bias], "transition": t.transition.ravel().tolist(), "start": list(t.start), "curve": list(model.curve), **{f: list(w) for f, w in t.weights.items()}}
    return [pa.array(list(rows), pa.string()), pa.array(list(rows.values()), pa.list_(pa.float64()))]


def _model_of(rows: pa.Table) -> Model:
    of = dict(zip(rows["name"].to_pylist(), rows["w"].to_pylist(), strict=True))
    bias, transition, start, curve = (of.pop(n) for n in ("bias", "transition", "start", "curve"))
    return Model(crf.Tagger({f: tuple(w) for f, w in of.items()}, bias[0], np.array(transition).reshape(2, 2), np.array(start)), tuple(curve))


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, odds: float, l2: float = 0.05) -> tuple[float, float, float]:
    """Logistic regression by Newton's method; the intercept is moved from the sample's share of
    toxic documents to the corpus's."""
    w = np.zeros(3)
    ridge = l2 * np.diag([1e-3, 1, 1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ x + ridge
        w = w + np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge @ w)
    share = min(max((weight * y).sum() / weight.sum(), 1e-6), 1 - 1e-6)
    return float(w[0] + odds - np.log(share / (1 - share))), float(w[1]), float(w[2])


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (default: all) of docs with toxic_score (0 to 1) and toxic_spans (character
    offsets [start, end) of runs of tokens whose marginal is SPAN or more, with the largest). A column of docs that has one of these
    names is not kept: the new ones win."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    keep = free_of(docs.columns if keep is None else keep, ("toxic_score", "toxic_spans"))
    at, at_kept = docs.columns.index(text), [docs.columns.index(c) for c in keep]
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        cache, scores = {}, [np.zeros((0, 3))]
        for batch in batches:
            texts = texts_of(batch.column(at))
            score, spans = np.zeros(len(texts)), []
            for a, b in spans_of_size(texts):
                docs = [words_of(t) for t in texts[a:b]]
                if len(cache) > CACHE_WORDS:
                    cache, scores = {}, [np.zeros((0, 3))]
                top, total, p, ends = summaries(docs, model, cache, scores)
                score[a:b] = model.score(top, total)
                spans += [_spans(t, p[e - len(d) : e]) if x >= SPAN else [] for t, d, e, x in zip(texts[a:b], docs, ends, top, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in at_kept), pa.array(score), pa.array(spans, spans_type)], names=[*keep, "toxic_score", "toxic_spans"])

    schema = "".join(f"`{c}` {dict(docs.dtypes)[c]}, " for c in keep)
    return arrow_map(docs, run, schema + "toxic_score double, toxic_spans array<struct<start: bigint, end: bigint, p: double>>")


def _spans(text: str, p: np.ndarray) -> list[dict]:
    bounds = [m.span() for m in WORD.finditer(text)]
    if len(bounds) != len(p):  # lower-casing changed what is a word; none is placed
        return []
    out: list[dict] = []
    last = -2
    for i in np.flatnonzero(p >= SPAN):
        if i == last + 1:
            out[-1] |= {"end": bounds[i][1], "p": max(out[-1]["p"], float(p[i]))}
        else:
            out.append({"start": bounds[i][0], "end": bounds[i][1], "p": float(p[i])})
        last = i
    return out
