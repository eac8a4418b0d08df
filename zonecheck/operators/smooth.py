"""Smoothing of outlines: buffers outwards and inwards on a raster held as runs of cells.

A shape is its runs (keys, cy, a, b): cells a to b of row cy, in order, none touching another. Growing by a radius
widens each run in the rows around it by the disk's width there; shrinking grows what lies outside. Out and in again
fills gaps and notches narrower than twice the radius, in and out again removes spikes and necks. Work and tables grow
with the number of runs, that is with the rim, not with the area.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import outline


def runs(polygons: DataFrame, cell: float, *keys: str) -> DataFrame:
    """(keys, cy, a, b): the runs of cells whose middle lies inside each polygon."""
    pair = F.transform(F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1), lambda i: F.struct(F.get("xs", 2 * i).alias("a"), F.get("xs", 2 * i + 1).alias("b")))
    found = outline.crossings(outline.edges(polygons, *keys), cell, *keys).filter(F.size("xs") > 1).select(*keys, "cy", F.explode(pair).alias("p"))
    first, last = outline._middles(F.col("p.a"), F.col("p.b"), cell)
    return _merged(found.select(*keys, "cy", first.alias("a"), last.alias("b")).filter("a <= b"), *keys)


def _merged(pieces: DataFrame, *keys: str) -> DataFrame:
    """Pieces of rows that overlap or touch as one run."""
    row = Window.partitionBy(*keys, "cy").orderBy("a", "b")
    before = F.max("b").over(row.rowsBetween(Window.unboundedPreceding, -1))
    new = pieces.withColumn("__new", F.when(F.col("a") <= before + 1, 0).otherwise(1))
    return new.withColumn("__run", F.sum("__new").over(row)).groupBy(*keys, "cy", "__run").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("__run")


def grown(shape: DataFrame, cells: float, *keys: str) -> DataFrame:
    """The cells whose middle is within ``cells`` cell widths of that of a cell of the shape."""
    disk = F.array(*[F.struct(F.lit(dy).cast("long").alias("dy"), F.lit(math.isqrt(int(cells * cells) - dy * dy)).cast("long").alias("w")) for dy in range(-int(cells), int(cells) + 1)])
    wide = shape.withColumn("d", F.explode(disk)).select(*keys, (F.col("cy") + F.col("d.dy")).alias("cy"), (F.col("a") - F.col("d.w")).alias("a"), (F.col("b") + F.col("d.w")).alias("b"))
    return _merged(wide, *keys)


def _outside(shape: DataFrame, box: DataFrame, *keys: str) -> DataFrame:
    """What the shape leaves of its box (keys, y0, y1, x0, x1)."""
    rows = box.select(*keys, "x0", "x1", F.explode(F.sequence("y0", "y1")).alias("cy"))
    held = shape.groupBy(*keys, "cy").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("r"))
    joined = rows.join(held, [*keys, "cy"], "left")
    edge = F.struct((F.col("x0") - 1).alias("a"), (F.col("x0") - 1).alias("b"))
    stop = F.struct((F.col("x1") + 1).alias("a"), (F.col("x1") + 1).alias("b"))
    full = joined.withColumn("r", F.concat(F.array(edge), F.coalesce("r", F.array().cast("array<struct<a: bigint, b: bigint>>")), F.array(stop)))
    gaps = F.transform(F.sequence(F.lit(0), F.size("r") - 2), lambda i: F.struct((F.get("r", i)["b"] + 1).alias("a"), (F.get("r", i + 1)["a"] - 1).alias("b")))
    return full.select(*keys, "cy", F.explode(gaps).alias("g")).select(*keys, "cy", "g.a", "g.b").filter("a <= b")


def _box(shape: DataFrame, margin: int, *keys: str) -> DataFrame:
    return shape.groupBy(*keys).agg((F.min("cy") - margin).alias("y0"), (F.max("cy") + margin).alias("y1"), (F.min("a") - margin).alias("x0"), (F.max("b") + margin).alias("x1"))


def shrunk(shape: DataFrame, cells: float, *keys: str) -> DataFrame:
    """The cells of the shape with nothing that lies outside it within ``cells`` cell widths."""
    margin = int(cells) + 1
    box = _box(shape, margin, *keys)
    # what grows from outside may reach over the box, where nothing of the shape is
    return _outside(grown(_outside(shape, box, *keys), cells, *keys), box, *keys)


def smoothed(shape: DataFrame, cells: float, *keys: str, spikes: bool = True) -> DataFrame:
    """``shape`` grown and shrunk again by ``cells``, then, with ``spikes``, shrunk and grown: gaps, then spikes under twice that width go."""
    closed = shrunk(grown(shape, cells, *keys), cells, *keys)
    return grown(shrunk(closed, cells, *keys), cells, *keys) if spikes else closed


def area(cell: float) -> Column:
    return F.coalesce(F.sum(F.col("b") - F.col("a") + 1), F.lit(0)) * cell * cell


def smooth_report(polygons: DataFrame, radius: float, cell: float, *keys: str, spikes: bool = True) -> DataFrame:
    """(keys, area_before, area_after, drift): areas on the raster before and after smoothing by ``radius`` metres, and their relative difference; nothing left: -1."""
    shape = runs(polygons, cell, *keys)
    after = smoothed(shape, radius / cell, *keys, spikes=spikes).groupBy(*keys).agg(area(cell).alias("area_after"))
    both = shape.groupBy(*keys).agg(area(cell).alias("area_before")).join(after, list(keys), "left").na.fill(0.0, ["area_after"])
    return both.withColumn("drift", F.col("area_after") / F.col("area_before") - 1)


def smoothed_cells(polygons: DataFrame, radius: float, cell: float, *keys: str, spikes: bool = True) -> DataFrame:
    """(keys, cx, cy): the cells of each polygon after smoothing by ``radius`` metres."""
    shape = smoothed(runs(polygons, cell, *keys), radius / cell, *keys, spikes=spikes)
    return shape.select(*keys, F.explode(F.sequence("a", "b")).alias("cx"), "cy")
