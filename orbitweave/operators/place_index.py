"""Nearest point of a grid of places, exact, by a tree of cells.

The square around all places is cut into FANOUT x FANOUT cells, and each of these again, until a cell
holds at most LEAF places: a crowded part of the grid gets deeper cells than an empty one. A cell
knows the box around its places.

A point goes down the tree: from each level it keeps the cells whose boxes are no farther than some
place of the best of them must be. That is a join of points and cells by the parent cell,
and a minimum for each point; at the end the few leaves that are left are joined with their places.
The upper levels have at most TOP cells by construction, and these go to all executors.

Bounds are formed as distances are, from differences, squares and a sum, which rounding keeps in order: the
result is that of a comparison of all pairs, ties to the lowest idx included.

Points at one place are looked up once. Tables with a row for each point never go to all executors: Spark would
take the size of their files, which compress well, for that of their rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitweave import workers
from orbitweave.storage import written

FANOUT = 4
LEAF = 32
#: Cells of the level at which points enter the tree, at most.
TOP = FANOUT**6
#: No cell is cut deeper: its places differ by less than the square's side over 4**26, as near as doubles tell.
DEEPEST = 26
#: Places that go to all executors, at most.
BROADCAST_PLACES = 10_000


def _cell(x: Column, low: float, side: float, level: int) -> Column:
    n = FANOUT**level
    return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((x - F.lit(low)) / F.lit(side) * F.lit(float(n))))).cast("long")


BOX = ("x0", "x1", "y0", "y1")


def _boxes(cells: DataFrame) -> DataFrame:
    """Cells of one level to those of the level above."""
    up = [F.floor(F.col(c) / FANOUT).alias(c) for c in ("cx", "cy")]
    return cells.groupBy((F.col("level") - 1).alias("level"), *up).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.lit(False).alias("leaf"))


def tree(places: DataFrame, leaf: int = LEAF) -> tuple[DataFrame, DataFrame, int, int]:
    """(cells, places with their leaf, level at which leaves begin, deepest level). places: idx, px, py
    and more, finite. cells: level, cx, cy, box, leaf."""
    low_x, high_x, low_y, high_y, n = places.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py"), F.count(F.lit(1))).first()
    side = max(high_x - low_x, high_y - low_y) or 1.0
    first = level = max(0, min(DEEPEST, math.ceil(math.log(max(1.0, n / leaf), FANOUT**2))))
    rest, done, cells = places, None, None
    while True:
        at = rest.withColumns({"cx": _cell(F.col("px"), low_x, side, level), "cy": _cell(F.col("py"), low_y, side, level)})
        counts = at.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1"))
        counts = written(counts.select(F.lit(level).alias("level"), "cx", "cy", *BOX, (F.lit(level >= DEEPEST) | (F.col("n") <= leaf)).alias("leaf")), "cells")
        cells = counts if cells is None else cells.unionByName(counts)
        dense = counts.where("NOT leaf").select(F.col("cx").alias("_cx"), F.col("cy").alias("_cy"))
        crowded = not dense.isEmpty()
        on = (F.col("cx") == F.col("_cx")) & (F.col("cy") == F.col("_cy"))
        ready = (at.join(dense, on, "left_anti") if crowded else at).withColumn("level", F.lit(level))
        done = ready if done is None else done.unionByName(ready)
        if not crowded:
            break
        rest = written(at.join(dense, on, "left_semi").drop("cx", "cy"), "dense")
        level += 1
    above = cells.where(F.col("level") == first)
    for _ in range(first):
        above = _boxes(above)
        cells = cells.unionByName(above)
    return written(cells, "tree"), written(done, "places"), first, level


def _entered(points: DataFrame, boxes, at_x: int, at_y: int) -> DataFrame:
    """Points with the cells of the entry level that may hold their nearest place."""
    names = [*points.columns, "cx", "cy", "leaf", "most"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cx, cy, x0, x1, y0, y1, leaf = boxes.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                x, y = (b.column(k).to_numpy(zero_copy_only=False).astype(float)[:, None] for k in (at_x, at_y))
                low = np.maximum(np.maximum(x0[None] - x, x - x1[None]), 0.0) ** 2 + np.maximum(np.maximum(y0[None] - y, y - y1[None]), 0.0) ** 2
                ax, bx, ay, by = (np.abs(v - e[None]) for v, e in ((x, x0), (x, x1), (y, y0), (y, y1)))
                high = np.minimum(np.minimum(ax, bx) ** 2 + np.maximum(ay, by) ** 2, np.maximum(ax, bx) ** 2 + np.minimum(ay, by) ** 2)
                most = high.min(1)
                row, cell = np.nonzero(low <= most[:, None])  # NaN meets nothing
                taken = b.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cx[cell]), pa.array(cy[cell]), pa.array(leaf[cell]), pa.array(most[row])], names=names)

    fields = ", ".join(f"`{c}` {t}" for c, t in points.dtypes)
    return points.mapInArrow(run, f"{fields}, cx long, cy long, leaf boolean, most double")


def _low_high(x: Column, y: Column) -> tuple[Column, Column]:
    """Squares of distances: no place of a box is nearer than the first, and one is within the second,
    because each side of a box has a place on it."""
    x0, x1, y0, y1 = (F.col(c) for c in BOX)
    none = F.lit(0.0)
    dx, dy = F.greatest(x0 - x, x - x1, none), F.greatest(y0 - y, y - y1, none)
    near = F.least(F.abs(x - x0), F.abs(x - x1)), F.least(F.abs(y - y0), F.abs(y - y1))
    far = F.greatest(F.abs(x - x0), F.abs(x - x1)), F.greatest(F.abs(y - y0), F.abs(y - y1))
    return dx * dx + dy * dy, F.least(near[0] * near[0] + far[1] * far[1], far[0] * far[0] + near[1] * near[1])


def candidates(points: DataFrame, cells: DataFrame, first: int, deepest: int) -> DataFrame:
    """(_row, _x, _y, level, cx, cy): the leaves that may hold the nearest place of each point (_row, _x, _y).
    Leaves stand in levels from first to deepest."""
    spark = points.sparkSession
    workers.prepare(spark)
    enter = min(first, round(math.log(TOP, FANOUT**2)))
    top = cells.where(F.col("level") == enter).toArrow()  # at most TOP rows
    held = spark.sparkContext.broadcast([top[c].to_numpy() for c in ("cx", "cy", *BOX, "leaf")])
    found = _entered(points, held, points.columns.index("_x"), points.columns.index("_y")).withColumn("level", F.lit(enter))
    kept = None
    for level in range(enter, deepest + 1):
        leaves = found.where("leaf").select("_row", "_x", "_y", "level", "cx", "cy", "most")
        kept = leaves if kept is None else kept.unionByName(leaves)
        if level == deepest:
            break
        below = cells.where(F.col("level") == level + 1).select("level", "cx", "cy", *BOX, "leaf", F.floor(F.col("cx") / FANOUT).alias("_px"), F.floor(F.col("cy") / FANOUT).alias("_py"))
        open_ = found.where("NOT leaf").select("_row", "_x", "_y", "most", F.col("cx").alias("_cx"), F.col("cy").alias("_cy"))
        low, high = _low_high(F.col("_x"), F.col("_y"))
        step = open_.join(below, (F.col("_cx") == F.col("_px")) & (F.col("_cy") == F.col("_py"))).withColumns({"low": low, "high": high}).where("low <= most")
        best = F.min(F.least("high", "most")).over(Window.partitionBy("_row"))
        found = written(step.withColumn("_best", best).where("low <= _best").select("_row", "_x", "_y", "level", "cx", "cy", "leaf", F.col("_best").alias("most")), "descent")
        if level + 1 >= first and found.where("NOT leaf").isEmpty():
            kept = kept.unionByName(found.select(*kept.columns))
            break
    # leaves of several levels: the best of all of them is known only now
    return kept.withColumn("_best", F.min("most").over(Window.partitionBy("_row"))).drop("most")


def nearest_place(points: DataFrame, grid: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """points with longitude and latitude of the nearest grid point (idx, pixel, scan, longitude, latitude),
    ties to the lowest idx; null where the point or the whole grid has no finite place. Of grid
    points at one place only the lowest idx can win, so the others go first."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    px, py = F.col("pixel").cast("double"), F.col("scan").cast("double")
    one = grid.where(finite(px) & finite(py)).groupBy(px.alias("px"), py.alias("py")).agg(F.min(F.struct("idx", "longitude", "latitude")).alias("_g")).select("px", "py", "_g")
    one = written(one, "places")
    rows = written(points.withColumns({"_x": F.col(x).cast("double"), "_y": F.col(y).cast("double")}), "points")
    if one.isEmpty():
        return points.withColumns({"longitude": F.lit(None).cast("double"), "latitude": F.lit(None).cast("double")})
    cells, places, first, deepest = tree(one)
    asked = rows.where(finite(F.col("_x")) & finite(F.col("_y"))).select("_x", "_y").distinct()
    asked = written(asked.select(F.monotonically_increasing_id().alias("_row"), "_x", "_y"), "asked")
    asked = candidates(asked, cells, first, deepest)
    at = places.select(F.col("level").alias("_level"), F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), "px", "py", "_g")
    at = F.broadcast(at) if places.count() <= BROADCAST_PLACES else at.hint("merge")
    met = asked.join(at, (F.col("level") == F.col("_level")) & (F.col("cx") == F.col("_cx")) & (F.col("cy") == F.col("_cy")))
    d = (F.col("_x") - F.col("px")) * (F.col("_x") - F.col("px")) + (F.col("_y") - F.col("py")) * (F.col("_y") - F.col("py"))
    best = met.groupBy(F.col("_x").alias("_ax"), F.col("_y").alias("_ay")).agg(F.min(F.struct(d.alias("d"), F.col("_g")["idx"].alias("idx"), F.col("_g")["longitude"].alias("longitude"), F.col("_g")["latitude"].alias("latitude"))).alias("_best"))
    out = rows.join(best.hint("merge"), (F.col("_x") == F.col("_ax")) & (F.col("_y") == F.col("_ay")), "left")
    return out.select(*points.columns, F.col("_best")["longitude"].cast("double").alias("longitude"), F.col("_best")["latitude"].cast("double").alias("latitude"))
