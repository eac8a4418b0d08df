"""Outlines of any shape on grids: cells inside them, an index of cells of several sizes, and lines cut at them.

A polygon has ``rings`` (array of struct(hole, pts), pts closed). All work is along edges: a grid's rows or cells that an
edge runs through grow with its length, so no box of cells is ever built. A point is inside by the parity of the edges
to its right, as in ``spatial.inside``: half open, so that outlines which share an edge share no cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geo as G
from ..sources.shared import stored

#: Cells of the next size along one side of a cell, as a power of two.
FAN_BITS = 2
_HAIR = 1e-9


def edges(polygons: DataFrame, *keys: str) -> DataFrame:
    """(keys, x1, y1, x2, y2): every edge of every ring; polygons without rings have none."""
    steps = polygons.select(*keys, F.explode("rings").alias("r")).select(*keys, F.explode(G.steps(F.col("r.pts"))).alias("e")).filter("e.b is not null")
    return steps.select(*keys, F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2")).filter("x1 <> x2 or y1 <> y2")


def _span(first: Column, last: Column) -> Column:
    """first..last, nothing if last is smaller."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def _middles(low: Column, high: Column, cell: float) -> tuple[Column, Column]:
    """The first and last cell whose middle lies in [low, high)."""
    return F.ceil(low / cell - 0.5).cast("long"), F.ceil(high / cell - 0.5).cast("long") - 1


def crossings(e: DataFrame, cell: float, *keys: str) -> DataFrame:
    """(keys, cy, xs): where edges cross the middle line of each row of cells, in order."""
    rows = e.withColumn("cy", F.explode(_span(*_middles(F.least("y1", "y2"), F.greatest("y1", "y2"), cell))))
    y = (F.col("cy") + 0.5) * cell
    x = (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    return rows.groupBy(*keys, "cy").agg(F.array_sort(F.collect_list(x)).alias("xs"))


def outline_cells(polygons: DataFrame, cell: float, *keys: str) -> DataFrame:
    """(keys, cx, cy, x, y): the cells whose middle lies inside, by the intervals between crossings of each row. Polygons of one key are one."""
    pair = F.transform(F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1), lambda i: F.struct(F.get("xs", 2 * i).alias("a"), F.get("xs", 2 * i + 1).alias("b")))
    runs = crossings(edges(polygons, *keys), cell, *keys).filter(F.size("xs") > 1).select(*keys, "cy", F.explode(pair).alias("p"))
    cells = runs.select(*keys, F.explode(_span(*_middles(F.col("p.a"), F.col("p.b"), cell))).alias("cx"), "cy")
    return cells.withColumn("x", (F.col("cx") + 0.5) * cell).withColumn("y", (F.col("cy") + 0.5) * cell)


def edge_cells(e: DataFrame, cell: float) -> DataFrame:
    """Each row of x1, y1, x2, y2 once per cell (cx, cy) that its line runs through, a hair's breadth around it included."""
    hair = _HAIR * cell
    at = lambda v: F.floor(v / cell).cast("long")
    left, right = F.least("x1", "x2"), F.greatest("x1", "x2")
    columns = e.withColumn("cx", F.explode(F.sequence(at(left - hair), at(right + hair))))
    y_at = lambda x: F.when(F.col("x1") == F.col("x2"), F.lit(None)).otherwise(F.col("y1") + (F.col("y2") - F.col("y1")) * (x - F.col("x1")) / (F.col("x2") - F.col("x1")))
    a, b = y_at(F.greatest(left, F.col("cx") * cell - hair)), y_at(F.least(right, (F.col("cx") + 1) * cell + hair))
    low, high = F.coalesce(F.least(a, b), F.least("y1", "y2")), F.coalesce(F.greatest(a, b), F.greatest("y1", "y2"))
    return columns.withColumn("cy", F.explode(F.sequence(at(low - hair), at(high + hair))))


def cover(polygons: DataFrame, cell: float, *keys: str) -> DataFrame:
    """(keys, level, cx, cy, rim): cells of level 0 (``cell`` wide) on the rim of each polygon, and cells of all levels inside.

    A cell of a level is four by four of the one below. Cells inside are children of rim cells that are no rim cells
    themselves, so a polygon has a number of cells that grows with its rim, whatever its area.
    """
    e = edges(polygons, *keys)
    at = [*keys, "cx", "cy"]
    wide = e.groupBy(*keys).agg(F.greatest(F.max(F.greatest("x1", "x2")) - F.min(F.least("x1", "x2")), F.max(F.greatest("y1", "y2")) - F.min(F.least("y1", "y2"))).alias("w")).agg(F.max("w")).first()[0] or 0.0
    levels = max(1, math.ceil(math.log(max(wide / cell, 1.0), 1 << FAN_BITS)))
    rim = stored(edge_cells(e, cell).select(*at).distinct())
    out = rim.select(*keys, F.lit(0).alias("level"), "cx", "cy", F.lit(True).alias("rim"))
    for level in range(levels):
        up = rim.select(*keys, F.shiftright("cx", FAN_BITS).alias("cx"), F.shiftright("cy", FAN_BITS).alias("cy")).distinct()
        down = lambda c: F.sequence(F.shiftleft(c, FAN_BITS), F.shiftleft(c, FAN_BITS) + (1 << FAN_BITS) - 1)
        free = up.withColumn("cx", F.explode(down(F.col("cx")))).withColumn("cy", F.explode(down(F.col("cy")))).join(rim, at, "left_anti")
        size = cell * (1 << FAN_BITS * level)
        right = F.filter("xs", lambda x: x > (F.col("cx") + 0.5) * size)
        inside = free.join(crossings(e, size, *keys), [*keys, "cy"]).filter(F.size(right) % 2 == 1)
        out = out.unionByName(inside.select(*keys, F.lit(level).alias("level"), "cx", "cy", F.lit(False).alias("rim")))
        rim = stored(up) if level + 1 < levels else up
    return out


def _odd(x: Column, y: Column, band: Column) -> Column:
    right = lambda e: x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]
    return F.aggregate(band, F.lit(False), lambda s, e: s != F.when((e["y1"] > y) != (e["y2"] > y), right(e)).otherwise(False))


def points_in_outlines(points: DataFrame, polygons: DataFrame, key: str, cell: float, boundary: bool | None = False, same: str | None = None) -> DataFrame:
    """(columns of points, key): every pair of a point and a polygon that holds it, of the same ``same`` if given.

    A point on an edge is in if ``boundary`` and out if not; with None the parity of the edges to its right decides there
    too, half open as for cells, so that of outlines which share an edge one has the point.

    A point meets the cells that hold it, one of each level. In a cell inside it is a hit; in one on the rim the edges
    that reach into its row of cells decide. Points without coordinates are in no polygon.
    """
    keys = [key, *([same] if same and same != key else [])]
    own = polygons.select(*keys, "rings")
    cells = stored(cover(own, cell, *keys))
    levels = [r[0] for r in cells.select("level").distinct().collect()]  # at most some twenty
    c0 = lambda c: F.floor(F.col(c) / cell).cast("long")
    code = F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright(c0("x"), FAN_BITS * n).alias("cx"), F.shiftright(c0("y"), FAN_BITS * n).alias("cy")) for n in levels or [0]])
    p = points.filter("x is not null and y is not null").withColumn("__code", F.explode(code))
    p = p.select(*points.columns, F.col("__code.level").alias("__level"), F.col("__code.cx").alias("__cx"), F.col("__code.cy").alias("__cy"))
    c = cells.withColumnsRenamed({"level": "__level", "cx": "__cx", "cy": "__cy", "rim": "__rim"})
    met = p.join(c, ["__level", "__cx", "__cy", *([same] if same else [])])
    columns = [*points.columns, *([key] if key not in points.columns else [])]
    hits = met.filter("not __rim").select(*columns)
    hair = _HAIR * cell
    at = lambda v: F.floor(v / cell).cast("long")
    e = edges(own, *keys).withColumn("__cy", F.explode(F.sequence(at(F.least("y1", "y2") - hair), at(F.greatest("y1", "y2") + hair))))
    bands = e.groupBy(*keys, "__cy").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("__band"))
    x, y = F.col("x"), F.col("y")
    near = met.filter("__rim").join(bands, [*keys, "__cy"])
    on = F.exists("__band", lambda s: G.segment_distance(x, y, s["x1"], s["y1"], s["x2"], s["y2"]) <= _HAIR)
    odd = _odd(x, y, F.col("__band"))
    return hits.unionByName(near.filter(odd if boundary is None else (odd | on) if boundary else (odd & ~on)).select(*columns))


def clip_lines(lines: DataFrame, polygons: DataFrame, key: str, line: str, cell: float = 500.0) -> DataFrame:
    """(line, key, seq, ax, ay, bx, by): the pieces of each line (line, key, pts) inside the polygon of its ``key``, rim included.

    ``line`` names one row of ``lines``. Every step of a line is cut where it meets an edge; a piece is kept if its middle is inside. Steps and edges meet in
    the cells that both run through.
    """
    step = lines.select(line, key, F.posexplode(G.steps(F.col("pts"))).alias("seq", "s")).filter("s.b is not null")
    step = stored(step.select(line, key, "seq", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2")))
    other = edge_cells(edges(polygons, key), cell).withColumnsRenamed({"x1": "ex", "y1": "ey", "x2": "fx", "y2": "fy"})
    met = edge_cells(step, cell).join(other, [key, "cx", "cy"])
    rx, ry, sx, sy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("fx") - F.col("ex"), F.col("fy") - F.col("ey")
    den, qx, qy = rx * sy - ry * sx, F.col("ex") - F.col("x1"), F.col("ey") - F.col("y1")
    whole = F.when(den != 0, den)
    t, u = (qx * sy - qy * sx) / whole, (qx * ry - qy * rx) / whole
    cuts = met.withColumn("t", t).withColumn("u", u).filter("t > 0 and t < 1 and u >= 0 and u <= 1").groupBy(line, key, "seq").agg(F.collect_set("t").alias("ts"))
    ends = step.join(cuts, [line, key, "seq"], "left").withColumn("ts", F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.coalesce("ts", F.array().cast("array<double>")))))
    piece = F.transform(F.sequence(F.lit(0), F.size("ts") - 2), lambda i: F.struct(F.get("ts", i).alias("a"), F.get("ts", i + 1).alias("b")))
    cut = ends.withColumn("p", F.explode(piece)).filter("p.a < p.b")
    on = lambda c, v: F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * v
    cut = cut.select(line, F.col(key), "seq", on("x", F.col("p.a")).alias("ax"), on("y", F.col("p.a")).alias("ay"), on("x", F.col("p.b")).alias("bx"), on("y", F.col("p.b")).alias("by"))
    middles = cut.withColumn("x", (F.col("ax") + F.col("bx")) / 2).withColumn("y", (F.col("ay") + F.col("by")) / 2)
    return points_in_outlines(middles, polygons, key, cell, boundary=True, same=key).select(line, key, "seq", "ax", "ay", "bx", "by")
