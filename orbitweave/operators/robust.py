"""Robust projective models per image pair: deterministic RANSAC, iterative tightening, refinement
with refit. A pair of up to SAMPLE rows is fitted in one task. Of a larger one only hypotheses come from
SAMPLE of its rows (the lowest hashes of match_id); which of them wins, refits (sums of the 9 x 9 normal
matrix), medians, tightening and ranks take all its rows, by aggregations over tasks.

Determinism: hypotheses are drawn with a seed from pair_id over rows sorted by match_id; a model is
refitted by least squares on its inliers and rescored before it is returned. Pairs with fewer than
four usable rows, or only degenerate ones, get no model: null h, null errors, no inliers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitweave import workers
from orbitweave.functions import geometry as g
from orbitweave.operators.quantiles import beside, quantiles
from orbitweave.storage import written

SAMPLE = 20_000
#: Hypotheses of a large pair that all its rows decide between.
TOP = 8
POINTS = ["source_x", "source_y", "reference_x", "reference_y"]
ITERATIONS, CONFIDENCE, ROUNDS = 5000, 0.999, 3
MODEL = "pair_id long, h array<double>, threshold double, n_fit long"


def _scaled(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points moved to mean 0 and mean distance sqrt(2), and the matrix that does it."""
    c = p.mean(0)
    d = np.sqrt(((p - c) ** 2).sum(1)).mean()
    s = np.sqrt(2) / d if d > 1e-12 else 1.0
    return (p - c) * s, np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])


def least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """The homography of a to b by the direct linear transform over all points."""
    if len(a) < 4:
        return None
    (pa, ta), (pb, tb) = _scaled(a), _scaled(b)
    x, y, u, v = pa[:, 0], pa[:, 1], pb[:, 0], pb[:, 1]
    zero, one = np.zeros(len(a)), np.ones(len(a))
    rows = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y, -u], 1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y, -v], 1)])
    # the normal matrix is 9 x 9 whatever the number of points
    values, vectors = np.linalg.eigh(rows.T @ rows)
    if len(a) == 4 and values[1] < 1e-12 * max(1.0, values[-1]):
        return None
    h = np.linalg.inv(tb) @ vectors[:, 0].reshape(3, 3) @ ta
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def errors(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w = h[2, 0] * a[:, 0] + h[2, 1] * a[:, 1] + h[2, 2]
    safe = np.where(w == 0, np.inf, w)
    x, y = (h[0, 0] * a[:, 0] + h[0, 1] * a[:, 1] + h[0, 2]) / safe, (h[1, 0] * a[:, 0] + h[1, 1] * a[:, 1] + h[1, 2]) / safe
    return np.hypot(x - b[:, 0], y - b[:, 1])


def _degenerate(p: np.ndarray) -> bool:
    """Whether three of four points are nearly on a line."""
    for i, j, k in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)):
        u, v = p[j] - p[i], p[k] - p[i]
        if abs(u[0] * v[1] - u[1] * v[0]) < 1e-6 * max(1.0, (u @ u) + (v @ v)):
            return True
    return False


def hypotheses(a: np.ndarray, b: np.ndarray, threshold: float, seed: int) -> list[np.ndarray]:
    """Models of seeded minimal samples, each with more inliers than the one before."""
    found: list[np.ndarray] = []
    if len(a) < 4:
        return found
    rng = np.random.default_rng(seed)
    count, needed, k = 0, ITERATIONS, 0
    while k < min(needed, ITERATIONS):
        k += 1
        pick = rng.choice(len(a), 4, replace=False)
        if _degenerate(a[pick]) or _degenerate(b[pick]) or (h := least_squares(a[pick], b[pick])) is None:
            continue
        n = int((errors(h, a, b) <= threshold).sum())
        if n > count:
            found.append(h)
            count = n
            share = min(n / len(a), 1 - 1e-9)
            needed = int(np.ceil(np.log(1 - CONFIDENCE) / np.log(max(1e-12, 1 - share**4)))) if share > 0 else ITERATIONS
    return found


def ransac(a: np.ndarray, b: np.ndarray, threshold: float, seed: int) -> np.ndarray | None:
    """The model with most inliers over seeded minimal samples, refitted on them and rescored."""
    found = hypotheses(a, b, threshold, seed)
    best = found[-1] if found else None
    for _ in range(3):
        if best is None:
            break
        inlier = errors(best, a, b) <= threshold
        again = least_squares(a[inlier], b[inlier]) if inlier.sum() >= 4 else None
        if again is None or (errors(again, a, b) <= threshold).sum() < inlier.sum():
            break
        best = again
    return best


def tightened(e: np.ndarray, threshold: float) -> float:
    """The threshold, or less where the inliers' noise allows: their median error plus three
    standard deviations from the median absolute deviation, at least 2. Never more than before."""
    inlier = e[np.isfinite(e) & (e <= threshold)]
    if len(inlier) < 4:
        return threshold
    middle = float(np.median(inlier))
    sigma = 1.4826 * float(np.median(np.abs(inlier - middle)))
    return min(threshold, max(2.0, middle + 3 * sigma))


def rank(e: np.ndarray, threshold: float) -> tuple[int, float, float]:
    """Inliers, their share, minus their root mean square error: compared in that order."""
    inlier = e <= threshold
    n = int(inlier.sum())
    return (n, n / max(1, len(e)), -float(np.sqrt((e[inlier] ** 2).mean())) if n else -np.inf)


def iterative(a: np.ndarray, b: np.ndarray, threshold: float, seed: int, rounds: int = ROUNDS) -> tuple[np.ndarray | None, float]:
    """RANSAC, then rounds of tightening and refitting on inliers; the best by rank is kept."""
    h = ransac(a, b, threshold, seed)
    if h is None:
        return None, threshold
    limit = tightened(errors(h, a, b), threshold)
    best, best_rank = h, rank(errors(h, a, b), limit)
    for k in range(rounds):
        inlier = errors(best, a, b) <= limit
        if inlier.sum() < 4:
            break
        again = ransac(a[inlier], b[inlier], limit, seed + k + 1)
        if again is None:
            again = least_squares(a[inlier], b[inlier])
        if again is None or (r := rank(errors(again, a, b), limit)) <= best_rank:
            break
        best, best_rank = again, r
    return best, limit


def fit_models(matches: DataFrame, threshold: float | DataFrame = 3.0, iterate: bool = False, sample: int = SAMPLE) -> DataFrame:
    """A row of MODEL for each pair. threshold: in pixels, or a table (pair_id, limit) of each pair's own."""
    workers.prepare(matches.sparkSession)
    usable = matches.where(g.finite(*(F.col(c) for c in POINTS))).select("pair_id", "match_id", *POINTS)

    def limited(rows: DataFrame) -> DataFrame:
        if isinstance(threshold, DataFrame):
            return rows.join(threshold.select("pair_id", F.col("limit").cast("double").alias("_limit")), "pair_id")
        return rows.withColumn("_limit", F.lit(float(threshold)))

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("match_id")
        a, b = rows[["source_x", "source_y"]].to_numpy(), rows[["reference_x", "reference_y"]].to_numpy()
        seed, limit = int(key[0]) & 0x7FFFFFFF, float(rows["_limit"].iloc[0])
        h, limit = iterative(a, b, limit, seed) if iterate else (ransac(a, b, limit, seed), limit)
        return pd.DataFrame({"pair_id": [key[0]], "h": [h.ravel().tolist() if h is not None else None], "threshold": [limit], "n_fit": [len(rows)]})

    large = usable.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n_fit")).where(F.col("n_fit") > sample)
    large = written(large, "large")
    if large.isEmpty():
        return limited(usable).groupBy("pair_id").applyInPandas(fit, MODEL)
    rows = beside(usable, large, "pair_id")
    whole = fit_large(rows, written(limited(sampled(rows, sample)), "some"), iterate)
    few = usable.join(F.broadcast(large) if large.count() <= 10_000 else large, "pair_id", "left_anti")
    return limited(few).groupBy("pair_id").applyInPandas(fit, MODEL).unionByName(whole)


def sampled(rows: DataFrame, sample: int) -> DataFrame:
    """The rows of the sample lowest hashes of each pair. rows: with n_fit, the pair's rows. Hashes are even, so a
    bound somewhat above the wanted share leaves few rows to be sorted; a pair for which it leaves too
    few, as with ids that repeat, is sorted whole."""
    first = Window.partitionBy("pair_id").orderBy(F.xxhash64("match_id"), "match_id")
    lowest = lambda t: t.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= sample).drop("_rank", "n_fit")
    share = F.lit(sample + 6.0 * sample**0.5 + 100.0) / F.col("n_fit")
    some = written(lowest(rows.where(F.xxhash64("match_id").cast("double") <= F.lit(-(2.0**63)) + share * F.lit(2.0**64))), "sampled")
    full = some.groupBy("pair_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= sample).select("pair_id")
    short = written(rows.select("pair_id").distinct().join(full, "pair_id", "left_anti"), "short")
    if short.isEmpty():
        return some
    return some.join(full, "pair_id", "left_semi").unionByName(lowest(beside(rows, short, "pair_id")).select(*some.columns))


def _error(h: str = "h"):
    return g.reprojection_error(*(F.col(c) for c in POINTS), F.col(h))


def ranked(rows: DataFrame, models: DataFrame) -> DataFrame:
    """models (pair_id, k, h, limit, ...) with, from one pass over all rows, rank: inliers, their share, minus
    their root mean square error; middle: the means of their points; and mark, which tells sets of inliers apart."""
    e = beside(rows, models.select("pair_id", "k", "h", "limit"), "pair_id").select("pair_id", "k", *POINTS, _error().alias("_e"), "limit")
    inlier = F.coalesce(F.col("_e") <= F.col("limit"), F.lit(False))
    rank = F.struct(F.count_if(inlier).alias("n"), (F.count_if(inlier) / F.count(F.lit(1))).alias("share"), F.coalesce(-F.sqrt(F.avg(F.when(inlier, F.col("_e") * F.col("_e")))), F.lit(float("-inf"))).alias("rmse"))
    middle = F.struct(*(F.avg(F.when(inlier, F.col(c))).alias(n) for c, n in zip(POINTS, MIDDLE, strict=True)))
    measured = e.groupBy("pair_id", "k").agg(rank.alias("rank"), middle.alias("middle"), F.bit_xor(F.when(inlier, F.xxhash64(*POINTS))).alias("mark"))
    return models.join(measured, ["pair_id", "k"])


#: Means of the four coordinates.
MIDDLE = ("a0", "a1", "b0", "b1")


def least_squares_of(rows: DataFrame) -> DataFrame:
    """(pair_id, h): the direct linear transform over all rows of each pair, from sums."""
    middle = written(rows.groupBy("pair_id").agg(*(F.avg(c).alias(n) for c, n in zip(POINTS, MIDDLE, strict=True))), "middles")
    return least_squares_about(beside(rows, middle, "pair_id"))


def least_squares_about(rows: DataFrame) -> DataFrame:
    """least_squares_of rows that hold the means of their pair. With p = (x, y, 1) the 9 x 9 normal matrix is made
    of the sums of p p', u p p', v p p' and (u u + v v) p p', so one pass gives it; it is scaled afterwards."""
    x, y, u, v = (F.col(c) - F.col(n) for c, n in zip(POINTS, MIDDLE, strict=True))
    rows = rows.select("pair_id", *MIDDLE, x.alias("x"), y.alias("y"), u.alias("u"), v.alias("v"))
    x, y, u, v = (F.col(c) for c in "xyuv")
    products = [F.lit(1.0), x, y, x * x, x * y, y * y]
    weights = [F.lit(1.0), u, v, u * u + v * v]
    sums = rows.groupBy("pair_id").agg(*(F.first(n).alias(n) for n in MIDDLE), F.avg(F.hypot(x, y)).alias("ad"), F.avg(F.hypot(u, v)).alias("bd"), F.array(*(F.sum(w * p) for w in weights for p in products)).alias("m"))

    def solve(parts):
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                sa, sb = (np.sqrt(2) / d if d > 1e-12 else 1.0 for d in (r.ad, r.bd))
                own = np.array(r.m, float).reshape(4, 6)[:, [[0, 1, 2], [1, 3, 4], [2, 4, 5]]][:, [[1], [2], [0]], [1, 2, 0]]
                scale = np.array([sa, sa, 1.0])
                one, by_u, by_v, by_w = own * np.outer(scale, scale) * np.array([1.0, sb, sb, sb * sb])[:, None, None]
                zero = np.zeros((3, 3))
                m = np.block([[one, zero, -by_u], [zero, one, -by_v], [-by_u, -by_v, by_w]])
                ta, tb = (np.array([[s, 0, -s * c0], [0, s, -s * c1], [0, 0, 1]]) for s, c0, c1 in ((sa, r.a0, r.a1), (sb, r.b0, r.b1)))
                h = np.linalg.inv(tb) @ np.linalg.eigh(m)[1][:, 0].reshape(3, 3) @ ta
                out.append((h / h[2, 2]).ravel().tolist() if abs(h[2, 2]) > 1e-12 else None)
            yield pd.DataFrame({"pair_id": part.pair_id, "h": out})

    return sums.where(F.col("m")[0] >= 4).mapInPandas(solve, "pair_id long, h array<double>")


def search(rows: DataFrame, some: DataFrame, limits: DataFrame, shift: int) -> DataFrame:
    """(pair_id, k, h, limit, rank): the hypothesis from some that most of all rows agree with, refitted up to
    three times on all its inliers while these do not get fewer; a refit that leaves the inliers as they were is
    the last, for the next would be the same. limits: (pair_id, limit), written."""

    def draw(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("match_id")
        found = hypotheses(own[["source_x", "source_y"]].to_numpy(), own[["reference_x", "reference_y"]].to_numpy(), float(own["limit"].iloc[0]), (int(key[0]) & 0x7FFFFFFF) + shift)[-TOP:]
        return pd.DataFrame({"pair_id": [key[0]] * len(found), "k": range(len(found)), "h": [h.ravel().tolist() for h in found], "limit": [float(own["limit"].iloc[0])] * len(found)})

    drawn = written(beside(some, limits, "pair_id").groupBy("pair_id").applyInPandas(draw, "pair_id long, k long, h array<double>, limit double"), "drawn")
    agreed = beside(rows, drawn, "pair_id").groupBy("pair_id", "k").agg(F.count_if(_error() <= F.col("limit")).alias("_n"))
    first = written(agreed.groupBy("pair_id").agg(F.max_by("k", F.struct("_n", "k")).alias("k")).join(drawn, ["pair_id", "k"]), "first")
    columns = ["k", "h", "limit", "rank", "middle", "mark"]
    open_, done = written(ranked(rows, first).select("pair_id", *columns), "best"), None
    for _ in range(3):
        inliers = beside(rows, open_.select("pair_id", "h", "limit", "middle.*"), "pair_id").where(_error() <= F.col("limit"))
        again = written(least_squares_about(inliers).where(F.col("h").isNotNull()).join(open_.select("pair_id", "k", "limit"), "pair_id"), "again")
        new = ranked(rows, again).select("pair_id", F.struct(*columns).alias("_m"))
        both = open_.join(new, "pair_id", "left").withColumn("_new", F.coalesce(F.col("_m.rank.n") >= F.col("rank.n"), F.lit(False)))
        both = both.select("pair_id", *(F.when(F.col("_new"), F.col(f"_m.{c}")).otherwise(F.col(c)).alias(c) for c in columns), (F.col("_new") & ~F.col("_m.mark").eqNullSafe(F.col("mark"))).alias("_moved"))
        both = written(both, "best")
        rest = both.where("NOT _moved").drop("_moved")
        done = rest if done is None else done.unionByName(rest)
        open_ = both.where("_moved").drop("_moved")
        if open_.isEmpty():
            break
    return written(done.unionByName(open_).select("pair_id", "k", "h", "limit", "rank"), "found")


def fit_large(rows: DataFrame, some: DataFrame, iterate: bool) -> DataFrame:
    """Models of pairs of any size, as of ransac and iterative. rows: all rows, with n_fit; some: those that
    hypotheses are drawn from, with _limit."""
    own_limits = written(some.groupBy("pair_id").agg(F.first("_limit").alias("limit")), "limits")
    sizes = rows.select("pair_id", "n_fit").distinct().join(own_limits.withColumnRenamed("limit", "_limit"), "pair_id")
    some = some.drop("_limit")
    best = search(rows, some, own_limits, 0)
    for k in range(ROUNDS if iterate else 0):
        if k == 0:
            near = beside(rows, best.select("pair_id", "h", "limit"), "pair_id").select("pair_id", _error().alias("_e"), "limit").where("_e <= limit")
            bounds = tightened_over(written(near.select("pair_id", "_e"), "errors"))
            limited = written(best.join(bounds, "pair_id", "left").select("pair_id", F.lit(0).alias("k"), "h", F.coalesce(F.least("limit", "_bound"), "limit").alias("limit")), "limited")
            best, open_pairs = written(ranked(rows, limited).drop("middle", "mark"), "best"), limited.select("pair_id")
        own = lambda table: beside(table, best.join(open_pairs, "pair_id", "left_semi").select("pair_id", "h", "limit"), "pair_id").where(_error() <= F.col("limit"))
        inliers, limits = written(own(rows).select("pair_id", *POINTS), "inliers"), written(best.join(open_pairs, "pair_id", "left_semi").select("pair_id", "limit"), "limits")
        found = search(inliers, own(some).select("pair_id", "match_id", *POINTS), limits, k + 1)
        new = ranked(rows, written(found.select("pair_id", "k", "h", "limit"), "found")).select("pair_id", F.struct("k", "h", "limit", "rank").alias("_m"))
        joined = written(best.join(new, "pair_id", "left").withColumn("_better", F.coalesce(F.col("_m.rank") > F.col("rank"), F.lit(False))), "rounds")
        open_pairs = written(joined.where("_better").select("pair_id"), "open")
        best = written(joined.select("pair_id", *(F.when(F.col("_better"), F.col(f"_m.{c}")).otherwise(F.col(c)).alias(c) for c in ("k", "h", "limit", "rank"))), "best")
        if open_pairs.isEmpty():
            break
    return sizes.join(best, "pair_id", "left").select("pair_id", "h", F.coalesce("limit", "_limit").alias("threshold"), "n_fit")


def tightened_over(near: DataFrame) -> DataFrame:
    """near: (pair_id, _e) of inliers. (pair_id, _bound): max(2, median + 3 sigma) where there are four."""
    middle = written(quantiles(near, "pair_id", F.col("_e"), [0.5]).where(F.col("n") >= 4).select("pair_id", F.col("q")[0].alias("_middle")), "medians")
    mad = quantiles(beside(near, middle, "pair_id"), "pair_id", F.abs(F.col("_e") - F.col("_middle")), [0.5]).select("pair_id", F.col("q")[0].alias("_mad"))
    return middle.join(mad, "pair_id").select("pair_id", F.greatest(F.lit(2.0), F.col("_middle") + 3 * F.lit(1.4826) * F.col("_mad")).alias("_bound"))


def scored(matches: DataFrame, models: DataFrame) -> DataFrame:
    """matches with h, threshold, reprojection_error (null without a model) and inlier."""
    joined = matches.join(models.select("pair_id", "h", "threshold"), "pair_id", "left")
    e = g.reprojection_error(F.col("source_x"), F.col("source_y"), F.col("reference_x"), F.col("reference_y"), F.col("h"))
    return joined.withColumn("reprojection_error", e).withColumn("inlier", F.coalesce(F.col("reprojection_error") <= F.col("threshold"), F.lit(False)))


def noise_bound(scored_matches: DataFrame, by: str = "pair_id") -> DataFrame:
    """Per pair, by exact medians of inlier errors: median, mad, bound and effective threshold (the
    smaller of threshold and bound, given at least four inliers)."""
    inliers = scored_matches.where("inlier").select(by, "reprojection_error", "threshold")
    middle = quantiles(inliers, by, F.col("reprojection_error"), [0.5]).select(by, "n", F.col("q")[0].alias("median"))
    middle = written(middle.join(inliers.groupBy(by).agg(F.max("threshold").alias("threshold")), by), "medians")
    mad = quantiles(beside(inliers.drop("threshold"), middle.select(by, "median"), by), by, F.abs(F.col("reprojection_error") - F.col("median")), [0.5]).select(by, F.col("q")[0].alias("mad"))
    bound = F.greatest(F.lit(2.0), F.col("median") + 3 * F.lit(1.4826) * F.col("mad"))
    return middle.join(mad, by).withColumn("bound", bound).withColumn("effective", F.when(F.col("n") >= 4, F.least("threshold", "bound")).otherwise(F.col("threshold")))


def refit(refined: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Models after refinement: pair_id, h, threshold, n_fit and model. refined: matches with refined
    coordinates in place and inlier, whether the first model took them. Two models are fitted on those
    inliers anew, one by least squares (refit) and one robustly (second_pass); the better by rank over
    them (more inliers, then the lower error, to a billionth of a pixel) is taken, ties to the refit. The first model, which is of
    other coordinates, is not looked at. A pair for which neither can be fitted has a null h."""
    rows = written(refined.where("inlier").select("pair_id", "match_id", *POINTS), "inliers")
    sizes = rows.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n_fit"))
    whole = least_squares_of(rows).join(sizes, "pair_id").select("pair_id", "h", F.lit(float(threshold)).alias("threshold"), "n_fit", F.lit("refit").alias("model"))
    again = fit_models(rows, threshold, iterate=True).withColumn("model", F.lit("second_pass"))
    models = written(whole.unionByName(again).where(F.col("h").isNotNull()), "refits")

    def ranks(name: str, order: int) -> DataFrame:
        own = models.where(F.col("model") == name)
        error = F.avg(F.when(F.col("inlier"), F.col("reprojection_error") * F.col("reprojection_error")))
        s = scored(rows, own).where(F.col("h").isNotNull()).groupBy("pair_id").agg(F.struct(F.count_if("inlier").alias("n"), F.coalesce(-F.round(F.sqrt(error), 9), F.lit(float("-inf"))).alias("rmse"), F.lit(order).alias("order")).alias("rank"))
        return s.join(own, "pair_id")

    both = ranks("refit", 1).unionByName(ranks("second_pass", 0))
    best = both.groupBy("pair_id").agg(F.max_by(F.struct("h", "threshold", "model"), "rank").alias("m"))
    every = refined.select("pair_id").distinct().join(best, "pair_id", "left").join(sizes, "pair_id", "left")
    return every.select("pair_id", "m.h", F.coalesce("m.threshold", F.lit(float(threshold))).alias("threshold"), F.coalesce("n_fit", F.lit(0).cast("long")).alias("n_fit"), "m.model")
