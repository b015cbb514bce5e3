"""k nearest vectors by Euclidean distance, exact, without a side held whole anywhere.

Pivots (rows of the reference, taken by hash, one for each PART of them up to PIVOTS) cut space into
cells; a cell is cut into rings of equal counts by distance from its pivot, and a ring of many equal
distances into parts by hash. A ring's part is what one task compares: about PART vectors. Pivots,
cells and rings are bounded by PIVOTS and BINS whatever the size of the tables, so they go to all
executors.

Two rounds: each source vector first meets its nearest ring, which bounds the distance of its k-th
neighbour; then it goes only to rings that can still win. A ring of pivot p with radii a to b is at
least as far from a vector x as max(a - d(x, p), d(x, p) - b), and, since its vectors are nearer to
p than to x's own pivot q, as (d(x, p)**2 - d(x, q)**2) / (2 d(p, q)).

Inside a part most pairs end early: vectors are turned into the main axes of SAMPLE of them; the first
axes that hold HEAD of the sample's spread give one part of a distance, and norms of the rest bound the
other from below (the sample only chooses axes, any of which give the same result). Only pairs below the bound are compared in full. Where vectors have no structure
(coordinates as good as random, in many dimensions), no ring can be left out and this is what saves.

Defined results: ids are unique on each side. Null vectors have no neighbours and are none. Equal
distances go to the lower id. A reference of fewer than k vectors gives them all. Vectors of
different lengths are an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitweave import workers
from orbitweave.storage import written

PIVOTS = 64
SAMPLE = 1024
#: Steps of distance in which a cell's rings are counted.
BINS = 256
PART = 4096
#: Source vectors that a task compares with one part.
VISITS = 20_000
HEAD = 0.85
#: Bounds are compared with this much room, relatively, for what sums of squares lose.
ROOM = 1e-9


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of an Arrow list column as rows; no nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances between rows, by differences: exact to the last bits also for near vectors."""
    return np.sqrt(np.maximum(((x[:, None] - y[None]) ** 2).sum(2), 0.0))


class Space:
    """Pivots, the main axes of a sample, and rings once these are counted."""

    def __init__(self, pivots: np.ndarray, sample: np.ndarray) -> None:
        self.pivots = pivots
        self.between = distances(pivots, pivots)
        spread, axes = np.linalg.eigh(np.atleast_2d(np.cov(sample.T)) if len(sample) > 1 else np.eye(sample.shape[1]))
        self.axes = axes[:, ::-1]
        share = np.cumsum(np.maximum(spread[::-1], 0.0))
        self.head = int(np.searchsorted(share, HEAD * share[-1]) + 1) if share[-1] > 0 else 1

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each row, and all distances to pivots."""
        d = np.concatenate([distances(x[i : i + 256], self.pivots) for i in range(0, len(x), 256)]) if len(x) else np.zeros((0, len(self.pivots)))
        return d.argmin(1) if len(x) else np.zeros(0, np.int64), d

    def set_rings(self, cell: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray, k: int) -> None:
        """Rings by cell and distance, with their counts."""
        order = np.lexsort((low, cell))
        self.cell, self.low, self.high, self.n = (v[order] for v in (cell, low, high, n))
        self.parts = np.maximum(1, -(-self.n // PART))
        # of each cell the distance within which it has k vectors
        self.reach = np.full(len(self.pivots), np.inf)
        for c in np.unique(self.cell):
            at = np.flatnonzero(self.cell == c)
            enough = np.cumsum(self.n[at]) >= k
            if enough.any():
                self.reach[c] = self.high[at][enough.argmax()]

    def ring_of(self, cell: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Rings are closed below; the last of a cell also above."""
        out = np.zeros(len(cell), np.int64)
        for c in np.unique(cell):
            at = np.flatnonzero(self.cell == c)
            rows = np.flatnonzero(cell == c)
            out[rows] = at[np.clip(np.searchsorted(self.low[at], d[rows], "right") - 1, 0, len(at) - 1)]
        return out

    def bounds(self, own: np.ndarray, d: np.ndarray) -> np.ndarray:
        """For each row (own: its cell, d: distances to pivots) a lower bound of its distance to each ring."""
        x = d[:, self.cell]
        ring = np.maximum(self.low[None] - x, x - self.high[None])
        apart = self.between[own][:, self.cell]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(apart > 0, (x**2 - d[np.arange(len(d)), own][:, None] ** 2) / (2 * apart), 0.0)
        return np.maximum(np.maximum(ring, plane), 0.0)


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from (b.slice(at, rows) for at in range(0, b.num_rows, rows))


def _celled(rows: DataFrame, held) -> DataFrame:
    """id, embedding with cell and distance from its pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            cell, d = held.value.cells(matrix(b.column(1)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int64()), pa.array(d[np.arange(len(d)), cell], pa.float64())], names=["id", "embedding", "cell", "d"])

    return rows.select("id", F.col("embedding").cast("array<double>")).mapInArrow(run, "id long, embedding array<double>, cell long, d double")


def _rings(celled: DataFrame) -> tuple[np.ndarray, ...]:
    """(cell, low, high, n) of rings of about PART vectors, from at most PIVOTS x BINS counts."""
    ends = celled.groupBy("cell").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    step = F.least(F.lit(BINS - 1), F.floor((F.col("d") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300)) * BINS)).cast("int")
    counts = celled.select("cell", "d").join(F.broadcast(ends), "cell").groupBy("cell", step.alias("bin")).agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count(F.lit(1)).alias("n"))
    out: list[list] = []
    for r in sorted(counts.collect(), key=lambda r: (r["cell"], r["bin"])):
        if out and out[-1][0] == r["cell"] and out[-1][3] + r["n"] <= PART:
            out[-1][2], out[-1][3] = r["hi"], out[-1][3] + r["n"]
        else:
            out.append([r["cell"], r["lo"], r["hi"], r["n"]])
    cell, low, high, n = zip(*out, strict=True)
    return np.array(cell, np.int64), np.array(low), np.array(high), np.array(n, np.int64)


def _visits(source: DataFrame, held, first: bool) -> DataFrame:
    """Source vectors with the rings that they go to. The first round goes to the ring with the lowest
    bound, which later rounds leave out; source has the limit of each row (most) by then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = held.value
        for b in _pieces(batches, 256):
            x = matrix(b.column(1))
            own, d = s.cells(x)
            bound = s.bounds(own, d)
            # of rings with the same bound the one whose distances are nearest to the row's own
            nearest = np.lexsort((np.abs(d[:, s.cell] - (s.low + s.high)[None] / 2), bound), axis=1)[:, 0]
            if first:
                most = np.min(d + s.reach[None], 1)
                goes = np.zeros(bound.shape, bool)
                goes[np.arange(len(x)), nearest] = True
            else:
                most = b.column(2).to_numpy(zero_copy_only=False).astype(float)
                most = np.where(np.isnan(most), np.inf, most)
                goes = bound <= most[:, None] * (1 + ROOM) + ROOM
                goes[np.arange(len(x)), nearest] = False
            row, ring = np.nonzero(goes)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(most[row], pa.float64()), pa.array(ring, pa.int64()), pa.array(s.parts[ring], pa.int64())],
                names=["id", "embedding", "most", "ring", "parts"])

    rows = source.mapInArrow(run, "id long, embedding array<double>, most double, ring long, parts long")
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")


def best_of(space: Space, ids: np.ndarray, y: np.ndarray, x: np.ndarray, most: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each row of x the ids and distances of its k nearest rows of y (fewer where the limit most
    leaves fewer), and how many were compared in full."""
    h = space.head
    ty, tx = y @ space.axes, x @ space.axes
    rest_y = np.sqrt((ty[:, h:] ** 2).sum(1))
    square_y = (ty[:, :h] ** 2).sum(1)
    for at in range(0, len(x), 256):
        part = tx[at : at + 256]
        rest_x = np.sqrt((part[:, h:] ** 2).sum(1))
        low = np.maximum((part[:, :h] ** 2).sum(1)[:, None] - 2 * part[:, :h] @ ty[:, :h].T + square_y[None], 0.0) + (rest_x[:, None] - rest_y[None]) ** 2
        size = np.sqrt(square_y.max(initial=0.0)) + np.sqrt((part**2).sum(1))
        for i in range(len(part)):
            limit = (most[at + i] * (1 + ROOM) + ROOM) ** 2
            some = min(4 * k, len(y))
            sample = np.argpartition(low[i], some - 1)[:some]
            if len(sample) >= k:  # the k-th of a few likely ones bounds the k-th of all
                limit = min(limit, np.partition(((y[sample] - x[at + i]) ** 2).sum(1), k - 1)[k - 1])
            near = np.flatnonzero(low[i] <= limit * (1 + ROOM) + ROOM * size[i] ** 2)
            exact = np.sqrt(((y[near] - x[at + i]) ** 2).sum(1))
            order = np.lexsort((ids[near], exact))[:k]
            yield ids[near][order], exact[order], len(near)


def _compared(visits: DataFrame, reference: DataFrame, held, k: int, keys: Sequence[str] = ("ring",)) -> DataFrame:
    """keys with (source_id, reference_ids, distances, compared) of each visit: source and reference rows
    meet in a part of equal keys. A part that many visit is repeated, for VISITS of them at a time."""
    salts = visits.groupBy(*keys, "part").agg(F.expr(f"1 + (count(*) - 1) div {VISITS}").alias("salts"))
    left = reference.join(salts, [*keys, "part"]).select("id", "embedding", *keys, "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    right = visits.join(salts, [*keys, "part"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts"))).drop("salts")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, out = left["id"].to_numpy(), []
        if left.num_rows and right.num_rows:
            order = np.argsort(ids)
            out = list(best_of(held.value, ids[order], matrix(left["embedding"])[order], matrix(right["embedding"]), right["most"].to_numpy(), k))
        own = right.slice(0, len(out)).select([*keys, "id"])
        return pa.table([*own.columns, pa.array([o[0].tolist() for o in out], pa.list_(pa.int64())), pa.array([o[1].tolist() for o in out], pa.list_(pa.float64())), pa.array([o[2] for o in out], pa.int64())], names=[*keys, "source_id", "reference_ids", "distances", "compared"])

    fields = "".join(f"`{c}` {t}, " for c, t in visits.select(*keys).dtypes)
    groups = [*keys, "part", "salt"]
    return left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInArrow(run, f"{fields}source_id long, reference_ids array<long>, distances array<double>, compared long")


def _vectors(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return rows.select(*keys, "id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull())


def _sample(reference: DataFrame) -> np.ndarray:
    return matrix(reference.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toArrow()["embedding"])


def visited(source: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    """(source_id, reference_ids, distances, compared) of all visits of both rounds, written."""
    spark = source.sparkSession
    workers.prepare(spark)
    source, reference = (_vectors(x) for x in (source, reference))
    sample = _sample(reference)
    empty = "source_id long, reference_ids array<long>, distances array<double>, compared long"
    if not len(sample):
        return spark.createDataFrame([], empty)
    pivots = sample[: min(PIVOTS, max(1, reference.count() // PART))]
    space = Space(np.unique(pivots, axis=0), sample)
    held = spark.sparkContext.broadcast(space)
    celled = written(_celled(reference, held), "cells")
    space.set_rings(*_rings(celled), k)
    held = spark.sparkContext.broadcast(space)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = held.value
        for b in batches:
            ring = s.ring_of(b.column(2).to_numpy(), b.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ring, pa.int64()), pa.array(s.parts[ring], pa.int64())], names=["id", "embedding", "ring", "parts"])

    ringed = celled.mapInArrow(place, "id long, embedding array<double>, ring long, parts long")
    ringed = written(ringed.select("id", "embedding", "ring", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")), "rings")
    once = written(_visits(source, held, True), "visits")
    first = written(_compared(once, ringed, held, k), "compared")
    # the k-th distance so far, with the bound of the cells where the ring held fewer than k
    limit = first.select("source_id", F.explode("distances").alias("d")).groupBy("source_id").agg(F.sort_array(F.collect_list("d")).alias("ds"))  # k values of a part
    limit = limit.select("source_id", F.expr(f"CASE WHEN size(ds) >= {k} THEN ds[{k - 1}] END").alias("found"))
    starts = once.groupBy("id").agg(F.min("most").alias("most"), F.first("embedding").alias("embedding"))
    rows = starts.join(limit, F.col("id") == F.col("source_id"), "left").select("id", "embedding", F.least("most", "found").alias("most"))
    again = written(_visits(rows, held, False), "visits")
    return first.unionByName(written(_compared(again, ringed, held, k), "compared"))


def nearest(source: DataFrame, reference: DataFrame, k: int = 2) -> DataFrame:
    """(source_id, reference_id, distance, rank): the k nearest reference vectors of each source vector.
    Both sides: id (long), embedding (array of numbers)."""
    return _ranked(visited(source, reference, k), (), k)


def _ranked(found: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    one = F.explode(F.arrays_zip(F.col("reference_ids").alias("reference_id"), F.col("distances").alias("distance")))
    found = found.select(*keys, "source_id", one.alias("_n")).select(*keys, "source_id", "_n.reference_id", "_n.distance")
    best = Window.partitionBy(*keys, "source_id").orderBy("distance", "reference_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def nearest_within(source: DataFrame, reference: DataFrame, keys: Sequence[str], k: int = 2) -> DataFrame:
    """keys, source_id, reference_id, distance, rank: nearest() inside each group of equal keys, all groups in
    one plan. Groups are small (what one tile shows), so they have no rings; one of more than PART
    reference vectors is met part by part."""
    spark = source.sparkSession
    workers.prepare(spark)
    source, reference = (_vectors(x, keys) for x in (source, reference))
    sample = _sample(reference)
    if not len(sample):
        sample = np.zeros((1, 1))
    held = spark.sparkContext.broadcast(Space(sample[:1], sample))
    parts = reference.groupBy(*keys).agg(F.expr(f"1 + (count(*) - 1) div {PART}").alias("parts"))
    placed = reference.join(parts, [*keys]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    visits = source.join(parts, [*keys]).withColumns({"most": F.lit(float("inf")), "part": F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))}).drop("parts")
    # both sides may stem from one table, which a written one no longer tells
    visits, placed = written(visits, "visits"), written(placed, "parts")
    return _ranked(written(_compared(visits, placed, held, k, keys), "compared"), keys, k)
