"""Nearest-seed tessellation on a raster, and what is done with its parts.

A cell (municipality_id, cx, cy) belongs to the district of the seed nearest to its middle, ties to the smallest
(district_id, x, y). Overlaps cannot occur and coverage is exact at the size of a cell; areas converge with it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import geo as G
from ..sources.shared import stored
from . import outline
from .parts import connect_islands, island_links, join_islands, parts  # noqa: F401  part of this module's surface


def raster(boundaries: DataFrame, cell: float) -> DataFrame:
    """(municipality_id, cx, cy, x, y): cells whose middle lies in the municipality's outline ``rings``, or in its box x0, y0, x1, y1 where there are no rings."""
    if "rings" in boundaries.columns:
        return outline.outline_cells(boundaries, cell, "municipality_id")
    span = lambda a, b: F.sequence(F.ceil(F.col(a) / cell - 0.5).cast("long"), F.ceil(F.col(b) / cell - 0.5).cast("long") - 1)
    cells = boundaries.select("municipality_id", F.explode(span("x0", "x1")).alias("cx"), span("y0", "y1").alias("ys")).select("municipality_id", "cx", F.explode("ys").alias("cy"))
    return cells.withColumn("x", (F.col("cx") + 0.5) * cell).withColumn("y", (F.col("cy") + 0.5) * cell)


def tessellate(cells: DataFrame, seeds: DataFrame, tile: float | None = None) -> DataFrame:
    """(municipality_id, cx, cy, district_id, distance): the owner of each cell of a municipality that has seeds.

    Cells look at the seeds of their own tile and the eight around it; one whose nearest seed may lie further goes to
    the next pass with tiles of four times the size, until all have an owner. A pass joins on the tile, so that no cell
    meets the seeds of a whole municipality; the first tile, unless given, holds about four seeds.
    """
    # read by every pass: written once
    s = stored(seeds.select("municipality_id", "district_id", F.col("x").alias("sx"), F.col("y").alias("sy")).distinct())
    boxes = s.groupBy("municipality_id").agg(F.count("*").alias("n"), ((F.max("sx") - F.min("sx")) * (F.max("sy") - F.min("sy"))).alias("area"), F.max(F.greatest(F.abs("sx"), F.abs("sy"))).alias("extent"))
    boxes = stored(boxes)
    todo = cells.join(boxes.select("municipality_id"), "municipality_id", "left_semi")
    n, area, extent = boxes.agg(F.sum("n"), F.sum("area"), F.max("extent")).first()
    if tile is None:
        tile = math.sqrt(4 * area / n) if n and area else 1000.0
    extent = extent or 0.0
    far = cells.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0] or 0.0
    done = None
    while True:
        at = lambda c, t=tile: F.floor(F.col(c) / t).cast("long")
        around = F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)])
        spread = todo.withColumn("tx", F.explode(F.transform(around, lambda d: at("x") + d))).withColumn("ty", F.explode(F.transform(around, lambda d: at("y") + d)))
        d = F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy"))
        met = spread.join(s.withColumn("tx", at("sx")).withColumn("ty", at("sy")), ["municipality_id", "tx", "ty"], "left")
        best = stored(met.groupBy("municipality_id", "cx", "cy", "x", "y").agg(F.min(F.when(F.col("sx").isNotNull(), F.struct(d.alias("d"), "district_id", "sx", "sy"))).alias("b")))
        last = tile > 2 * (extent + far)
        sure = F.lit(True) if last else F.coalesce(F.col("b.d") <= tile, F.lit(False))
        owned = best.filter(sure & F.col("b").isNotNull()).select("municipality_id", "cx", "cy", F.col("b.district_id").alias("district_id"), F.col("b.d").alias("distance"))
        done = owned if done is None else done.unionByName(owned)
        todo = best.filter(~sure).select("municipality_id", "cx", "cy", "x", "y")
        if last or todo.isEmpty():
            return done
        tile *= 4


def district_cells(owned: DataFrame, cell: float) -> DataFrame:
    """(district_id, cells, area)."""
    return owned.groupBy("district_id").agg(F.count("*").alias("cells"), (F.count("*") * cell * cell).alias("area"))


def part_areas(labelled: DataFrame, cell: float) -> DataFrame:
    return labelled.groupBy("municipality_id", "district_id", "part").agg((F.count("*") * cell * cell).alias("area_m2"))


def part_shares(areas: DataFrame) -> DataFrame:
    """Adds total_m2, parts and share: the part's share of its district."""
    one = Window.partitionBy("district_id")
    return areas.withColumns({"total_m2": F.sum("area_m2").over(one), "parts": F.count("*").over(one)}).withColumn("share", F.col("area_m2") / F.col("total_m2"))


def sliver_parts(areas: DataFrame, max_km2: float = 0.05, max_share: float = 0.02) -> DataFrame:
    """Parts of multi-part districts that are small and a small share."""
    return part_shares(areas).filter((F.col("parts") > 1) & (F.col("area_m2") < max_km2 * 1e6) & (F.col("share") < max_share))


def mark_main_body(areas: DataFrame) -> DataFrame:
    """Adds status, anomaly_type and severity: the largest part is the main body, the others are to be reviewed."""
    rank = F.row_number().over(Window.partitionBy("district_id").orderBy(F.col("area_m2").desc(), "part"))
    main = rank == 1
    return areas.select("*", F.when(main, "main_body").otherwise("unresolved_anomaly").alias("status"), F.when(~main, "multi_part_review").alias("anomaly_type"), F.when(~main, "medium").alias("severity"))


def top_parts(areas: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` largest parts of each district, with their rank."""
    rank = F.row_number().over(Window.partitionBy("district_id").orderBy(F.col("area_m2").desc(), "part"))
    return areas.withColumn("rank", rank).filter(F.col("rank") <= k)


def island_report(areas: DataFrame) -> DataFrame:
    """(district_id, parts, largest, smallest, total)."""
    return areas.groupBy("district_id").agg(F.count("*").alias("parts"), F.max("area_m2").alias("largest"), F.min("area_m2").alias("smallest"), F.sum("area_m2").alias("total"))


def island_summary(islands: DataFrame) -> DataFrame:
    """(district_id, parts, anomalies) from mark_main_body."""
    return islands.groupBy("district_id").agg(F.count("*").alias("parts"), F.count_if(F.col("status") == "unresolved_anomaly").alias("anomalies"))


def neighbour_borders(labelled: DataFrame) -> DataFrame:
    """(municipality_id, district_id, part, other_district, other_part, border): edges between cells of different parts, counted."""
    c = labelled.select("municipality_id", "cx", "cy", "district_id", "part")
    beside = F.array(*[F.struct(F.lit(x).cast("long").alias("dx"), F.lit(y).cast("long").alias("dy")) for x, y in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    steps = c.withColumn("s", F.explode(beside)).select("municipality_id", (F.col("cx") + F.col("s.dx")).alias("cx"), (F.col("cy") + F.col("s.dy")).alias("cy"), F.col("district_id").alias("d"), F.col("part").alias("p"))
    # cells are many, but small as a file, by which Spark would broadcast them
    met = steps.join(c.hint("merge"), ["municipality_id", "cx", "cy"]).filter((F.col("d") != F.col("district_id")) | (F.col("p") != F.col("part")))
    return met.groupBy("municipality_id", F.col("d").alias("district_id"), F.col("p").alias("part"), F.col("district_id").alias("other_district"), F.col("part").alias("other_part")).agg(F.count("*").alias("border"))


def longest_border_neighbour(labelled: DataFrame) -> DataFrame:
    """(district_id, part, to): the other district with which each part shares most edges, ties to the smaller id."""
    per = neighbour_borders(labelled).filter("other_district <> district_id").groupBy("municipality_id", "district_id", "part", "other_district").agg(F.sum("border").alias("border"))
    best = per.groupBy("municipality_id", "district_id", "part").agg(F.min(F.struct((-F.col("border")).alias("b"), "other_district")).alias("m"))
    return best.select("municipality_id", "district_id", "part", F.col("m.other_district").alias("to"))


def absorb(labelled: DataFrame, moving: DataFrame) -> DataFrame:
    """Cells with the owner after the parts in ``moving`` (municipality_id, district_id, part) went to the neighbour with the longest border; a part without neighbour stays."""
    to = longest_border_neighbour(labelled).join(moving.select("municipality_id", "district_id", "part"), ["municipality_id", "district_id", "part"], "left_semi")
    return labelled.join(to, ["municipality_id", "district_id", "part"], "left").select("municipality_id", "cx", "cy", F.coalesce("to", "district_id").alias("district_id"))


def absorb_slivers(owned: DataFrame, cell: float, max_km2: float = 0.05, max_share: float = 0.02) -> DataFrame:
    """Cells after slivers were absorbed by their neighbours; every cell keeps exactly one owner."""
    labelled = stored(parts(owned.select("municipality_id", "cx", "cy", "district_id")))
    return absorb(labelled, sliver_parts(part_areas(labelled, cell), max_km2, max_share))


def part_evidence(labelled: DataFrame, houses: DataFrame, cell: float) -> DataFrame:
    """(municipality_id, district_id, part, houses): houses (municipality_id, district_id, x, y) of the district itself in each of its parts."""
    h = houses.select("municipality_id", "district_id", F.floor(F.col("x") / cell).cast("long").alias("cx"), F.floor(F.col("y") / cell).cast("long").alias("cy"))
    per = h.groupBy("municipality_id", "district_id", "cx", "cy").agg(F.count("*").alias("n"))
    return labelled.join(per.hint("merge"), ["municipality_id", "district_id", "cx", "cy"], "left").groupBy("municipality_id", "district_id", "part").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("houses"))


def island_stats(labelled: DataFrame, houses: DataFrame, cell: float) -> DataFrame:
    """(municipality_id, district_id, part, area_m2, streets, house_numbers, houses) of each part: its area, the sorted distinct streets and house numbers of the district's houses (municipality_id, district_id, street, house_number, x, y) in it, and their count."""
    keys = ["municipality_id", "district_id"]
    h = houses.select(*keys, "street", "house_number", F.floor(F.col("x") / cell).cast("long").alias("cx"), F.floor(F.col("y") / cell).cast("long").alias("cy"))
    inside = h.join(labelled.hint("merge"), [*keys, "cx", "cy"]).groupBy(*keys, "part").agg(F.array_sort(F.collect_set("street")).alias("streets"), F.array_sort(F.collect_set("house_number")).alias("house_numbers"), F.count("*").alias("houses"))
    none = F.array().cast("array<string>")
    filled = part_areas(labelled, cell).join(inside, [*keys, "part"], "left")
    return filled.withColumns({"streets": F.coalesce("streets", none), "house_numbers": F.coalesce("house_numbers", none), "houses": F.coalesce("houses", F.lit(0))})


def keep_non_empty(evidence: DataFrame, areas: DataFrame) -> DataFrame:
    """Parts with houses; of a district whose parts are all empty the largest."""
    one = Window.partitionBy("district_id")
    ranked = evidence.join(areas, ["municipality_id", "district_id", "part"]).withColumn("most", F.max("houses").over(one)).withColumn("rank", F.row_number().over(one.orderBy(F.col("area_m2").desc(), "part")))
    return ranked.filter((F.col("houses") > 0) | ((F.col("most") == 0) & (F.col("rank") == 1))).drop("most", "rank")


def street_points(lines: DataFrame, boundaries: DataFrame, step: float = 60.0) -> DataFrame:
    """(municipality_id, district_id, street_norm, x, y): points of the street lines (line_id, municipality_id, district_id, street_norm, pts), clipped to their municipality's outline and at most ``step`` apart."""
    pieces = outline.clip_lines(lines.select("line_id", "municipality_id", "pts"), boundaries, "municipality_id", "line_id")
    ends = F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))
    dense = pieces.select("line_id", F.explode(G.segmentize(ends, step)).alias("p"))
    return dense.join(lines.select("line_id", "municipality_id", "district_id", "street_norm"), "line_id").select("municipality_id", "district_id", "street_norm", F.col("p.x").alias("x"), F.col("p.y").alias("y")).distinct()


def seeds(lines: DataFrame, fallback: DataFrame, houses: DataFrame, boundaries: DataFrame | None = None, cell: float = 500.0) -> DataFrame:
    """(municipality_id, district_id, x, y): points of the densified street lines, the street's own point where a district's street has no line, and houses.

    ``lines`` and ``fallback`` have municipality_id, district_id, street_norm, x, y; ``houses`` the same without
    street_norm. With ``boundaries`` (municipality_id, rings) fallback points and houses outside their municipality's
    outline are left out, those on an edge by parity, as cells; lines are clipped by ``street_points``. A street with
    lines needs no fallback even if all of them lie outside.
    """
    columns = ["municipality_id", "district_id", "x", "y"]
    missing = fallback.join(lines.select("district_id", "street_norm").distinct(), ["district_id", "street_norm"], "left_anti")
    points = missing.select(*columns).unionByName(houses.select(*columns))
    if boundaries is not None:
        points = outline.points_in_outlines(points, boundaries, "municipality_id", cell, None, same="municipality_id")
    return lines.select(*columns).unionByName(points.select(*columns)).distinct()


def absorb_evidenceless(owned: DataFrame, houses: DataFrame, cell: float, max_km2: float = 0.10, passes: int = 4, dry_run: bool = False) -> DataFrame:
    """Cells after parts without houses of their own went to the neighbour with the longest border, in up to ``passes`` rounds.

    Only parts of districts with several parts move. A candidate above ``max_km2`` refuses the run. With ``dry_run``
    the candidates of the first round are returned.
    """
    cells = owned.select("municipality_id", "cx", "cy", "district_id")
    # each pass asks only which cells have houses: found once
    at = houses.select("municipality_id", "district_id", *[F.floor(F.col(c) / cell).cast("long").alias(f"c{c}") for c in ("x", "y")]).distinct()
    houses = stored(at.select("municipality_id", "district_id", *[((F.col(f"c{c}") + 0.5) * cell).alias(c) for c in ("x", "y")]))
    for _ in range(passes):
        labelled = stored(parts(cells))
        areas = part_shares(part_areas(labelled, cell))
        empty = areas.filter("parts > 1").join(part_evidence(labelled, houses, cell).filter("houses = 0"), ["municipality_id", "district_id", "part"])
        if dry_run:
            return empty
        empty = stored(empty)
        if not empty.filter(F.col("area_m2") > max_km2 * 1e6).isEmpty():
            raise ValueError("a part without evidence is too large to be absorbed")
        if empty.isEmpty():
            break
        cells = stored(absorb(labelled, empty))
    return cells
