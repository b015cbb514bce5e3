"""Operators on candidate correspondences: filters, mutual consistency, merging, de-duplication,
grid selection, tiles. A table of correspondences has match_id, pair_id, source_x, source_y,
reference_x, reference_y and confidence; extra columns pass through. Everything is keyed by
pair_id, so many image pairs run in one job.

Ties: the higher confidence wins, then the lower match_id. Rows with a null or NaN coordinate or
confidence fail the filters; elsewhere they match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitweave.functions import geometry as g
from orbitweave.storage import written

POINTS = ("source_x", "source_y", "reference_x", "reference_y")
SHAPE = (1024, 1024)


def points() -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(c) for c in POINTS)  # type: ignore[return-value]


def in_bounds(source: tuple[int, int], reference: tuple[int, int]) -> Column:
    """Both points are numbers inside their images. Shapes are (height, width)."""
    sx, sy, rx, ry = points()
    return F.coalesce(g.finite(sx, sy, rx, ry) & g.inside(sx, sy, source[1], source[0]) & g.inside(rx, ry, reference[1], reference[0]), F.lit(False))


def filter_candidates(matches: DataFrame, source: tuple[int, int] = SHAPE, reference: tuple[int, int] = SHAPE, confidence: float = 0.2) -> DataFrame:
    """Rows inside both images with at least that confidence."""
    return matches.where(in_bounds(source, reference) & g.finite(F.col("confidence")) & (F.col("confidence") >= confidence))


def to_native(matches: DataFrame, source_scale: float, reference_scale: float, source_native: float = 1.0, reference_native: float = 1.0) -> DataFrame:
    sx, sy, rx, ry = points()
    return matches.withColumns({"source_x": g.to_native(sx, source_scale, source_native), "source_y": g.to_native(sy, source_scale, source_native), "reference_x": g.to_native(rx, reference_scale, reference_native), "reference_y": g.to_native(ry, reference_scale, reference_native)})


def bounds_report(matches: DataFrame, source: tuple[int, int], reference: tuple[int, int]) -> DataFrame:
    """Per pair: rows, rows kept by in_bounds, rows removed."""
    ok = in_bounds(source, reference)
    return matches.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("kept"), F.count_if(~ok).alias("removed"))


def with_cell(matches: DataFrame, shape: tuple[int, int] = SHAPE, grid: tuple[int, int] = (8, 8)) -> DataFrame:
    """Adds grid_row and grid_col of the reference point. Shape (height, width), grid (rows, columns)."""
    return matches.withColumns({"grid_row": g.cell(F.col("reference_y"), shape[0], grid[0]), "grid_col": g.cell(F.col("reference_x"), shape[1], grid[1])})


def grid_select(matches: DataFrame, shape: tuple[int, int] = SHAPE, grid: tuple[int, int] = (8, 8), per_cell: int = 4) -> DataFrame:
    """The per_cell best of each cell of each pair; 0 or less keeps all. Spark cuts each task's rows
    to per_cell before the shuffle (WindowGroupLimit)."""
    celled = with_cell(matches, shape, grid)
    if per_cell <= 0:
        return celled
    best = Window.partitionBy("pair_id", "grid_row", "grid_col").orderBy(F.desc("confidence"), "match_id")
    return celled.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= per_cell).drop("_rank")


def grid_histogram(celled: DataFrame, grid: tuple[int, int] = (8, 8)) -> DataFrame:
    """Rows of each cell of each pair, empty cells included."""
    cells = celled.select("pair_id").distinct().select("pair_id", F.explode(F.sequence(F.lit(0), F.lit(grid[0] - 1))).alias("grid_row")).select("pair_id", "grid_row", F.explode(F.sequence(F.lit(0), F.lit(grid[1] - 1))).alias("grid_col"))
    counts = celled.groupBy("pair_id", "grid_row", "grid_col").agg(F.count(F.lit(1)).alias("n"))
    return cells.join(counts, ["pair_id", "grid_row", "grid_col"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def mutual(forward: DataFrame, reverse: DataFrame, radius: float = 3.0) -> DataFrame:
    """forward rows whose nearest reverse row - by the distance of the forward reference point from
    the reverse source point, ties to the lowest rev_id - is within radius, and leads back to
    within radius of the source point. The confidence is the lower of both. reverse: rev_id instead
    of match_id, its source in the forward reference image.

    A nearest row beyond radius drops the forward row whatever it is, so only cells of two radii
    around a point are looked at: an equi-join on cells instead of all pairs. A reverse row stands in the
    four cells that it can reach, a forward row in its own only: all that it meets is in one task, and one row
    of it is left before the next shuffle. Of reverse rows at one place only the lowest rev_id can win.
    """
    size = 2.0 * radius
    left = forward.withColumns({"_i": F.floor(F.col("reference_x") / size), "_j": F.floor(F.col("reference_y") / size)})
    one = reverse.groupBy(F.col("pair_id").alias("_pair"), F.col("source_x").alias("_x"), F.col("source_y").alias("_y")).agg(
        F.min(F.struct(F.col("rev_id").alias("_rev"), F.col("reference_x").alias("_bx"), F.col("reference_y").alias("_by"), F.col("confidence").alias("_conf"))).alias("_to"))
    reach = lambda c: F.sequence(F.floor((F.col(c) - radius) / size), F.floor((F.col(c) + radius) / size))
    one = one.where(g.finite(F.col("_x"), F.col("_y")))
    right = one.select("_pair", "_x", "_y", "_to", F.explode(reach("_x")).alias("_ri")).select("*", F.explode(reach("_y")).alias("_rj"))
    near = left.join(right.hint("merge"), (F.col("pair_id") == F.col("_pair")) & (F.col("_i") == F.col("_ri")) & (F.col("_j") == F.col("_rj")))
    near = near.withColumn("_d", g.distance(F.col("reference_x"), F.col("reference_y"), F.col("_x"), F.col("_y"))).where(F.col("_d") <= radius)
    names = [c for c in forward.columns if c not in ("pair_id", "match_id")]
    best = near.groupBy("pair_id", "match_id").agg(*(F.first(c).alias(c) for c in names), F.min(F.struct("_d", "_to._rev", "_to._bx", "_to._by", "_to._conf")).alias("_best"))
    back = g.distance(F.col("source_x"), F.col("source_y"), F.col("_best")["_bx"], F.col("_best")["_by"])
    return best.where(back <= radius).withColumns({"confidence": F.least("confidence", F.col("_best")["_conf"]), "rev_id": F.col("_best")["_rev"]}).select(*forward.columns, "rev_id")


#: Parts of the radius: rows of one knot are within it of each other at both ends (its diagonal is 0.99
#: of it), and what is within it of a knot's box touches two cells in each direction at most.
KNOT, CELL = 0.7, 3.0


def _spread(rows: DataFrame, low: dict[str, Column], high: dict[str, Column], size: float) -> DataFrame:
    """rows once for each cell (_c0 to _c3) of that size, over both ends, that their box touches."""
    ends = [(F.floor(low[c] / size), F.floor(high[c] / size)) for c in POINTS]
    rows = rows.withColumns({f"_e{k}{j}": e[j] for k, e in enumerate(ends) for j in (0, 1)})
    corners = F.array(*(F.struct(*(F.col(f"_e{k}{j >> k & 1}").alias(f"_c{k}") for k in range(4))) for j in range(16)))
    rows = rows.withColumn("_cell", F.explode(F.array_distinct(corners)))
    return rows.withColumns({f"_c{k}": F.col("_cell")[f"_c{k}"] for k in range(4)}).drop("_cell", *(f"_e{k}{j}" for k in range(4) for j in (0, 1)))


def deduplicate(matches: DataFrame, radius: float = 3.0) -> DataFrame:
    """Greedy by confidence: a row goes if a kept stronger row is within radius at both ends. The
    same as visiting rows one by one, without the order, and without pairs of rows.

    Rows stand in knots, cells over both ends (four dimensions) so small that all rows of one are
    within radius of each other: of a knot at most one row can be kept, and only its strongest row, its
    head, need be looked at. In each round a head is kept if no head of a knot within reach is
    stronger (of a knot of several rows the reach is that of the box around them); rows within radius
    of a kept one go. Knots and rows meet in cells of three radii, heads in each that they can reach,
    so a crowd of any size is one row of a join. The strongest open row is always kept, so every
    round gets on; rounds follow the chains of ever weaker neighbours.

    Rows with a null or NaN coordinate or confidence match nothing and stay.
    """
    ends = [F.col(c) for c in POINTS]
    rows = matches.where(g.finite(*ends, F.col("confidence"))).select("pair_id", "match_id", *POINTS, "confidence")
    size = CELL * radius
    cells = {f"_c{k}": F.floor(F.col(c) / size) for k, c in enumerate(POINTS)}
    open_ = written(rows.withColumns({f"_k{k}": F.floor(F.col(c) / (KNOT * radius)) for k, c in enumerate(POINTS)}), "open")
    knot, cell = ["pair_id", "_k0", "_k1", "_k2", "_k3"], ["pair_id", "_c0", "_c1", "_c2", "_c3"]
    box = {f"{e}_{c}": f(c) for c in POINTS for e, f in (("_lo", F.min), ("_hi", F.max))}
    away = lambda x, lo, hi: F.greatest(lo - x, x - hi, F.lit(0.0))
    dropped = None
    while True:
        head = F.max(F.struct("confidence", (-F.col("match_id")).alias("order"), "match_id", *POINTS))
        heads = open_.groupBy(*knot).agg(head.alias("_h"), *(c.alias(n) for n, c in box.items())).select("pair_id", "_h.*", *box)
        heads = written(heads, "heads")
        near = _spread(heads, {c: F.col(f"_lo_{c}") - radius for c in POINTS}, {c: F.col(f"_hi_{c}") + radius for c in POINTS}, size)
        near = near.select(*cell, F.col("confidence").alias("_conf"), F.col("order").alias("_order"), *box)
        stronger = (F.col("_conf") > F.col("confidence")) | (F.col("_conf") == F.col("confidence")) & (F.col("_order") > F.col("order"))
        gap = [away(F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}")) for c in POINTS]
        reach = (F.sqrt(gap[0] * gap[0] + gap[1] * gap[1]) <= radius) & (F.sqrt(gap[2] * gap[2] + gap[3] * gap[3]) <= radius)
        own = heads.drop(*box).withColumns(cells)
        blocked = own.join(near, cell).where(stronger & reach).select("pair_id", "match_id").distinct()
        kept = written(heads.drop(*box).join(blocked, ["pair_id", "match_id"], "left_anti"), "kept")
        if kept.isEmpty():
            break
        by = _spread(kept, {c: F.col(c) - radius for c in POINTS}, {c: F.col(c) + radius for c in POINTS}, size)
        by = by.select(*cell, F.col("match_id").alias("_by"), *(F.col(c).alias(f"_{c}") for c in POINTS))
        within = [g.distance(*(F.col(n) for n in (x, y, f"_{x}", f"_{y}"))) <= radius for x, y in (POINTS[:2], POINTS[2:])]
        met = open_.select("pair_id", "match_id", *POINTS).withColumns(cells).join(by, cell).where(within[0] & within[1])
        met = written(met.groupBy("pair_id", "match_id").agg(F.max(F.col("match_id") == F.col("_by")).alias("_kept")), "met")
        gone = met.where("NOT _kept").select("pair_id", "match_id")
        dropped = gone if dropped is None else dropped.unionByName(gone)
        open_ = written(open_.join(met, ["pair_id", "match_id"], "left_anti"), "open")
    return matches if dropped is None else matches.join(dropped, ["pair_id", "match_id"], "left_anti")


def without_weaker(matches: DataFrame, radius: float = 3.0) -> DataFrame:
    """Rows without any stronger row within radius at both ends, whether that one is kept or not. A chain of
    ever weaker neighbours leaves its strongest row only, where deduplicate() also keeps those that lost
    their stronger neighbour.

    Only the strongest row of a knot (deduplicate) can be left; it is held against the strongest row of each
    place in the cells that it can reach, so a crowd is looked at by as many heads as there are knots around it.
    Rows with a null or NaN coordinate or confidence match nothing and stay."""
    usable = F.coalesce(g.finite(*(F.col(c) for c in POINTS), F.col("confidence")), F.lit(False))
    size = CELL * radius
    strongest = F.max(F.struct("confidence", (-F.col("match_id")).alias("order"))).alias("_s")
    spots = written(matches.where(usable).groupBy("pair_id", *POINTS).agg(strongest).select("pair_id", *POINTS, "_s.*"), "spots")
    knot = [F.floor(F.col(c) / (KNOT * radius)) for c in POINTS]
    heads = written(spots.groupBy("pair_id", *knot).agg(F.max(F.struct("confidence", "order", *POINTS)).alias("_h")).select("pair_id", "_h.*"), "heads")
    cell = ["pair_id", "_c0", "_c1", "_c2", "_c3"]
    others = spots.select("pair_id", *(F.floor(F.col(c) / size).alias(f"_c{k}") for k, c in enumerate(POINTS)), F.col("confidence").alias("_conf"), F.col("order").alias("_order"), *(F.col(c).alias(f"_{c}") for c in POINTS))
    near = _spread(heads, {c: F.col(c) - radius for c in POINTS}, {c: F.col(c) + radius for c in POINTS}, size)
    within = [g.distance(*(F.col(n) for n in (x, y, f"_{x}", f"_{y}"))) <= radius for x, y in (POINTS[:2], POINTS[2:])]
    stronger = (F.col("_conf") > F.col("confidence")) | (F.col("_conf") == F.col("confidence")) & (F.col("_order") > F.col("order"))
    met = near.join(others.hint("merge"), cell).where(stronger & within[0] & within[1])
    blocked = met.select("pair_id", (-F.col("order")).alias("match_id")).distinct()
    kept = heads.select("pair_id", (-F.col("order")).alias("match_id")).join(blocked.hint("merge"), ["pair_id", "match_id"], "left_anti")
    return matches.where(usable).join(kept.hint("merge"), ["pair_id", "match_id"], "left_semi").select(*matches.columns).unionByName(matches.where(~usable))


def merge(passes: list[DataFrame], radius: float = 2.0, chains: bool = True) -> DataFrame:
    """All passes together, then de-duplicated: greedily, or with chains=False against all stronger rows."""
    rows = passes[0]
    for p in passes[1:]:
        rows = rows.unionByName(p)
    return deduplicate(rows, radius) if chains else without_weaker(rows, radius)


def unscaled(matches: DataFrame, scale: float) -> DataFrame:
    """Points found in images scaled by scale, in the unscaled images."""
    return matches.withColumns({c: F.col(c) / F.lit(float(scale)) for c in POINTS})


def with_fallback(primary: DataFrame, fallback: DataFrame, scale: float = 0.5, least: int = 8, radius: float = 2.0) -> DataFrame:
    """Pairs with fewer than least primary rows get the fallback pass at another scale merged in;
    pairs without any primary row count as having 0."""
    rich = primary.groupBy("pair_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("pair_id")
    again = unscaled(fallback.join(rich, "pair_id", "left_anti"), scale)
    poor = primary.join(rich, "pair_id", "left_anti")
    return primary.join(rich, "pair_id", "left_semi").unionByName(merge([poor, again], radius))


def tiles(spark, height: int, width: int, grid: tuple[int, int] = (2, 2), overlap: float = 0.25, least: int = 32) -> DataFrame:
    """Overlapping tiles (tile, row, col, y0, y1, x0, x1): even edges rounded half to even, padded
    by half the overlap (0 to 0.45) of a tile's length, cut at the image; tiles under least pixels
    are left out."""
    def edges(length: int, n: int, i: Column) -> tuple[Column, Column]:
        share = min(max(overlap, 0.0), 0.45)
        step = F.lit(float(length)) / F.lit(float(n))
        lo, hi = F.bround(i * step, 0), F.bround((i + 1) * step, 0)
        pad = F.bround((hi - lo) * F.lit(share) / F.lit(2.0), 0)
        return F.greatest(F.lit(0), (lo - pad).cast("int")), F.least(F.lit(length), (hi + pad).cast("int"))

    t = spark.range(grid[0] * grid[1]).select(F.col("id").cast("int").alias("tile"), F.floor(F.col("id") / grid[1]).cast("int").alias("row"), (F.col("id") % grid[1]).cast("int").alias("col"))
    y0, y1 = edges(height, grid[0], F.col("row"))
    x0, x1 = edges(width, grid[1], F.col("col"))
    return t.select("tile", "row", "col", y0.alias("y0"), y1.alias("y1"), x0.alias("x0"), x1.alias("x1")).where((F.col("y1") - F.col("y0") >= least) & (F.col("x1") - F.col("x0") >= least))


def assign_tiles(matches: DataFrame, tile_table: DataFrame) -> DataFrame:
    """A row for each tile that holds a row's source point, with the point in tile coordinates. The
    tiles are a fixed small grid and are broadcast."""
    inside = (F.col("source_x") >= F.col("x0")) & (F.col("source_x") < F.col("x1")) & (F.col("source_y") >= F.col("y0")) & (F.col("source_y") < F.col("y1"))
    return matches.join(F.broadcast(tile_table), inside).withColumns({"tile_x": F.col("source_x") - F.col("x0"), "tile_y": F.col("source_y") - F.col("y0")})


def shifted(matches: DataFrame, dx: Column, dy: Column, side: str = "source") -> DataFrame:
    """Tile coordinates back to the image's."""
    return matches.withColumns({f"{side}_x": F.col(f"{side}_x") + dx, f"{side}_y": F.col(f"{side}_y") + dy})


def _corners(h, x0, y0, x1, y1) -> tuple[list[Column], list[Column]]:
    found = [g.project(g.lit(x), g.lit(y), h) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
    return [c[0] for c in found], [c[1] for c in found]


def overlap_box(h, source: tuple[int, int], reference: tuple[int, int]) -> Column:
    """[x0, y0, x1, y1] of where the source image falls in the reference image, cut at it; null where a
    corner is not finite. Shapes are (height, width); corners are the outermost pixels."""
    xs, ys = _corners(h, 0.0, 0.0, source[1] - 1.0, source[0] - 1.0)
    low, high = lambda v: F.greatest(F.lit(0.0), F.least(*v)), lambda v, n: F.least(F.lit(float(n)), F.greatest(*v))
    return F.when(g.finite(*xs, *ys), F.array(low(xs), low(ys), high(xs, reference[1]), high(ys, reference[0])))


def search_boxes(tile_table: DataFrame, source: tuple[int, int], reference: tuple[int, int], h=None, margin: float = 0.15, least_pad: float = 12.0, least: int = 32) -> DataFrame:
    """tiles with rx0, ry0, rx1, ry1: where each tile's matches are looked for in the reference image. With h the
    bounds of the tile's projected outermost pixels, widened by the larger of least_pad and margin times
    the tile's longer side (a tile with a corner that is not finite goes); without, the same share of
    the reference image. Rounded outwards, cut at the image; boxes under least pixels go."""
    tile_table = written(tile_table, "tiles")  # else the tiles' own expressions stand in each of these
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1"))
    if h is not None:
        xs, ys = _corners(h, x0, y0, x1 - 1, y1 - 1)
        pad = F.greatest(F.lit(least_pad), F.lit(margin) * F.greatest(x1 - x0, y1 - y0))
        found = [F.least(*xs) - pad, F.least(*ys) - pad, F.greatest(*xs) + pad, F.greatest(*ys) + pad]
        tile_table = tile_table.where(g.finite(*xs, *ys))
    else:
        found = [v / F.lit(float(max(1, source[k]))) * F.lit(float(reference[k])) for v, k in ((x0, 1), (y0, 0), (x1, 1), (y1, 0))]
    low, high = lambda v: F.greatest(F.lit(0), F.floor(v)).cast("int"), lambda v, n: F.least(F.lit(n), F.ceil(v) + 1).cast("int")
    out = tile_table.withColumns({"rx0": low(found[0]), "ry0": low(found[1]), "rx1": high(found[2], reference[1]), "ry1": high(found[3], reference[0])})
    return out.where((F.col("rx1") - F.col("rx0") >= least) & (F.col("ry1") - F.col("ry0") >= least))
