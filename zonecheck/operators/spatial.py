"""Points, polygons and raster cells in a plane (metres).

A polygon is one row with ``rings`` (array of struct(hole, pts), pts a closed ring of struct(x, y)) and its box minx,
miny, maxx, maxy. Joins meet on grid cells: a polygon takes the cells of its box, a point lies in one cell. Dense cells
are keys like any other, which Spark splits when they are skewed; a smaller cell thins them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geo as G
from ..sources.shared import stored
from . import outline
from .sweep import shared_area, union_areas, with_shared_area  # noqa: F401  part of this module's surface


def box_polygons(df: DataFrame, x0: str = "x0", y0: str = "y0", x1: str = "x1", y1: str = "y1") -> DataFrame:
    """Adds rings and the box for rows that are boxes."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0))
    return with_box(df.withColumn("rings", F.array(F.struct(F.lit(False).alias("hole"), ring.alias("pts")))))


def with_box(polygons: DataFrame) -> DataFrame:
    points = F.flatten(F.transform("rings", lambda r: r["pts"]))
    low = lambda a: F.array_min(F.transform(points, lambda p: p[a]))
    high = lambda a: F.array_max(F.transform(points, lambda p: p[a]))
    return polygons.withColumns({"minx": low("x"), "miny": low("y"), "maxx": high("x"), "maxy": high("y")})


def _cells(low: str, high: str, cell: float) -> Column:
    return F.sequence(F.floor(F.col(low) / cell).cast("long"), F.floor(F.col(high) / cell).cast("long"))


def cover_cells(polygons: DataFrame, cell: float) -> DataFrame:
    """Each polygon once per grid cell (cx, cy) of its box."""
    return polygons.withColumn("cx", F.explode(_cells("minx", "maxx", cell))).withColumn("cy", F.explode(_cells("miny", "maxy", cell)))


def inside(x: Column, y: Column, rings: Column, boundary: bool) -> Column:
    """Whether the point is in the polygon by the parity of crossings; on an edge it is in if ``boundary``."""
    odd = F.aggregate(rings, F.lit(False), lambda s, r: s != G.in_ring(x, y, r["pts"]))
    edge = F.exists(rings, lambda r: G.on_ring(x, y, r["pts"]))
    return (odd | edge) if boundary else (odd & ~edge)


#: Polygons whose box has more cells than this are met by their covers.
BOX_CELLS = 64


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float = 500.0, boundary: bool = False, same: str | None = "municipality_id") -> DataFrame:
    """Every pair of a point and a polygon that holds it, of the same ``same`` if given. Columns of both; the polygon's are without rings and box.

    Small polygons meet points in the cells of their box, large ones in the cells of their cover (``outline.cover``),
    whose number grows with the rim: the result is the same.
    """
    own = [c for c in polygons.columns if c not in ("rings", "minx", "miny", "maxx", "maxy", same)]
    count = (F.floor(F.col("maxx") / cell) - F.floor(F.col("minx") / cell) + 1) * (F.floor(F.col("maxy") / cell) - F.floor(F.col("miny") / cell) + 1)
    p = points.withColumn("cx", F.floor(F.col("x") / cell).cast("long")).withColumn("cy", F.floor(F.col("y") / cell).cast("long"))
    c = cover_cells(polygons.filter(count <= BOX_CELLS), cell)
    on = ["cx", "cy"] + ([same] if same else [])
    columns = [*points.columns, *[x for x in own if x not in points.columns]]
    met = p.join(c, on).filter((F.col("x") >= F.col("minx")) & (F.col("x") <= F.col("maxx")) & (F.col("y") >= F.col("miny")) & (F.col("y") <= F.col("maxy")))
    hits = met.filter(inside(F.col("x"), F.col("y"), F.col("rings"), boundary)).select(*columns)
    large = polygons.filter(count > BOX_CELLS)
    if large.isEmpty():
        return hits
    large = stored(large.withColumn("__polygon", F.monotonically_increasing_id()))
    more = outline.points_in_outlines(points, large, "__polygon", cell, boundary, same)
    named = large.select("__polygon", *[x for x in own if x not in points.columns])
    return hits.unionByName(more.join(named, "__polygon").select(*columns))


def covering_polygon(points: DataFrame, polygons: DataFrame, key: str, polygon: str = "district_id", **options) -> DataFrame:
    """(key, polygon): the polygon with the lowest id that holds each point, boundary included; null if none does."""
    hits = points_in_polygons(points, polygons, boundary=True, **options).groupBy(key).agg(F.min(polygon).alias(polygon))
    return points.select(key).join(hits, key, "left")


def coverage_failures(points: DataFrame, districts: DataFrame, key: str = "address_id", **options) -> DataFrame:
    """(key, municipality_id, hits, names): points in no district or in several, with the districts' names joined by ' | '."""
    hits = points_in_polygons(points, districts, boundary=True, **options).groupBy(key).agg(F.count("*").alias("hits"), F.array_join(F.array_sort(F.collect_set("name")), " | ").alias("names"))
    joined = points.select(key, "municipality_id").join(hits, key, "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return joined.filter("hits <> 1").withColumn("names", F.coalesce("names", F.lit("")))


# --- overlap areas


def _signed(points: np.ndarray) -> float:
    x, y = points[:, 0], points[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2) if len(points) > 2 else 0.0


def _candidates(a: DataFrame, b: DataFrame, key_a: str, key_b: str, cell: float, on: Column | None) -> DataFrame:
    """Pairs of polygons whose boxes overlap, met once: in the cell of the overlap's lower corner."""
    x = cover_cells(a, cell).select(F.col(key_a).alias("a"), F.struct("*").alias("pa"), "cx", "cy")
    y = cover_cells(b, cell).select(F.col(key_b).alias("b"), F.struct("*").alias("pb"), "cx", "cy")
    met = x.join(y, ["cx", "cy"])
    overlap = (F.col("pa.minx") < F.col("pb.maxx")) & (F.col("pb.minx") < F.col("pa.maxx")) & (F.col("pa.miny") < F.col("pb.maxy")) & (F.col("pb.miny") < F.col("pa.maxy"))
    corner = (F.floor(F.greatest("pa.minx", "pb.minx") / cell) == F.col("cx")) & (F.floor(F.greatest("pa.miny", "pb.miny") / cell) == F.col("cy"))
    met = met.filter(overlap & corner)
    return met if on is None else met.filter(on)


def overlap_pairs(districts: DataFrame, tolerance: float = 1.0, cell: float = 1000.0) -> DataFrame:
    """(a, b, municipality_id, area): districts a < b of one municipality, school type and (null-safe) language that share more than ``tolerance``."""
    same = (F.col("pa.municipality_id") == F.col("pb.municipality_id")) & (F.col("pa.school_type") == F.col("pb.school_type")) & F.col("pa.teaching_language").eqNullSafe(F.col("pb.teaching_language"))
    met = _candidates(districts, districts, "district_id", "district_id", cell, (F.col("a") < F.col("b")) & same)
    return with_shared_area(met.select("a", "b", F.col("pa.municipality_id").alias("municipality_id"), F.col("pa.rings").alias("rings_a"), F.col("pb.rings").alias("rings_b"))).filter(F.col("area") > tolerance)


def overlap_totals(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("pairs"), F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"))


def intersection_area(districts: DataFrame, polygons: DataFrame, key: str, cell: float = 1000.0) -> DataFrame:
    """(district_id, shared_area): what each district shares with the polygons, summed; 0 if nothing."""
    met = _candidates(districts, polygons, "district_id", key, cell, None)
    areas = with_shared_area(met.select(F.col("a").alias("district_id"), F.col("pa.rings").alias("rings_a"), F.col("pb.rings").alias("rings_b"))).groupBy("district_id").agg(F.sum("area").alias("shared_area"))
    return districts.select("district_id").join(areas, "district_id", "left").na.fill(0.0, ["shared_area"])


# --- distances


def nearest_within(points: DataFrame, targets: DataFrame, radius: float, key: str, target: str) -> DataFrame:
    """(key, target, distance) of the nearest target within ``radius`` of each point, ties to the smaller id; points without one are left out. Cells are as wide as the radius, so a point looks at nine."""
    p = points.select(key, "x", "y", F.floor(F.col("x") / radius).cast("long").alias("px"), F.floor(F.col("y") / radius).cast("long").alias("py"))
    near = F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)])
    p = p.withColumn("cx", F.explode(F.transform(near, lambda d: F.col("px") + d))).withColumn("cy", F.explode(F.transform(near, lambda d: F.col("py") + d)))
    t = targets.select(target, F.col("x").alias("tx"), F.col("y").alias("ty"), F.floor(F.col("x") / radius).cast("long").alias("cx"), F.floor(F.col("y") / radius).cast("long").alias("cy"))
    d = F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))
    best = p.join(t, ["cx", "cy"]).withColumn("d", d).filter(F.col("d") <= radius).groupBy(key).agg(F.min(F.struct("d", target)).alias("b"))
    return best.select(key, F.col(f"b.{target}").alias(target), F.col("b.d").alias("distance"))


def corridor_blockers(lines: DataFrame, houses: DataFrame, width: float = 50.0, cell: float = 500.0) -> DataFrame:
    """(line_id, blockers): districts other than the line's with houses within ``width`` of it. ``lines`` has line_id, district_id, ax, ay, bx, by."""
    boxed = lines.withColumns({"minx": F.least("ax", "bx") - width, "maxx": F.greatest("ax", "bx") + width, "miny": F.least("ay", "by") - width, "maxy": F.greatest("ay", "by") + width})
    h = houses.select(F.col("district_id").alias("other"), "x", "y", F.floor(F.col("x") / cell).cast("long").alias("cx"), F.floor(F.col("y") / cell).cast("long").alias("cy"))
    far = G.segment_distance(*[F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")])
    met = cover_cells(boxed, cell).join(h, ["cx", "cy"]).filter((F.col("other") != F.col("district_id")) & (far <= width))
    return met.groupBy("line_id").agg(F.array_sort(F.collect_set("other")).alias("blockers"))


# --- districts and what lies in them


def schools_per_district(schools: DataFrame, districts: DataFrame) -> DataFrame:
    """(district_id, school_count, own_inside): public schools of the district's type inside it, and whether its own school is one."""
    s = schools.filter("is_public").select(F.col("school_id").alias("in_id"), "type", "x", "y")
    hits = points_in_polygons(s, districts.select("district_id", "school_type", F.col("school_id").alias("fk"), "rings", "minx", "miny", "maxx", "maxy"), boundary=True, same=None).filter(F.col("type") == F.col("school_type"))
    per = hits.groupBy("district_id").agg(F.count("*").alias("school_count"), F.bool_or(F.coalesce(F.col("in_id") == F.col("fk"), F.lit(False))).alias("own_inside"))
    return districts.select("district_id").join(per, "district_id", "left").select("district_id", F.coalesce("school_count", F.lit(0)).alias("school_count"), F.coalesce("own_inside", F.lit(False)).alias("own_inside"))


def count_inside(points: DataFrame, districts: DataFrame, name: str, **options) -> DataFrame:
    """(district_id, name): points inside each district, boundary included."""
    per = points_in_polygons(points, districts, boundary=True, **options).groupBy("district_id").agg(F.count("*").alias(name))
    return districts.select("district_id").join(per, "district_id", "left").na.fill(0, [name])


def geometric_consistency(points: DataFrame, streets: DataFrame, districts: DataFrame) -> DataFrame:
    """(address_id, poly_district_id, vzn_districts, result) of points with municipality_id and ulica_norm: does the polygon agree with a district of the street?"""
    covered = covering_polygon(points, districts, "address_id").withColumnRenamed("district_id", "poly_district_id")
    of = streets.groupBy("municipality_id", F.col("street_norm").alias("ulica_norm")).agg(F.array_sort(F.collect_set("district_id")).alias("vzn_districts"))
    joined = points.join(covered, "address_id").join(of, ["municipality_id", "ulica_norm"], "left")
    result = F.when(F.col("vzn_districts").isNull(), "NO_VZN").when(F.col("poly_district_id").isNull(), "NO_POLYGON").when(F.array_contains("vzn_districts", F.col("poly_district_id")), "MATCH").otherwise("MISMATCH")
    return joined.select("address_id", "poly_district_id", "vzn_districts", result.alias("result"))


def mismatch_rows(consistency: DataFrame) -> DataFrame:
    """(address_id, vzn_district_id, poly_district_id): one row per mismatched address and district of its street."""
    return consistency.filter("result = 'MISMATCH'").select("address_id", F.explode("vzn_districts").alias("vzn_district_id"), "poly_district_id")


def hulls(points: DataFrame, key: str, parts: int = 16, most: int = 4096) -> DataFrame:
    """(key, n, hull, area): the convex hull of each group of at least three points; of more than ``most`` points a hull of the hulls of at least ``parts`` parts, so that no task holds all points of a large group."""
    kind = "array<struct<x: double, y: double>>"

    def of_points(f: pd.DataFrame) -> pd.DataFrame:
        corners = convex_hull(f[["x", "y"]].to_numpy(float))
        return pd.DataFrame({key: [f[key].iloc[0]], "n": [len(f)], "pts": [[{"x": x, "y": y} for x, y in corners]]})

    def of_hulls(f: pd.DataFrame) -> pd.DataFrame:
        corners = convex_hull(np.array([(p["x"], p["y"]) for pts in f["pts"] for p in pts], float))
        return pd.DataFrame({key: [f[key].iloc[0]], "n": [int(f["n"].sum())], "hull": [[{"x": x, "y": y} for x, y in corners]], "area": [abs(_signed(np.array(corners)))]})

    # at most one large group for every ``most`` points: a small table
    large = stored(points.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") > most))
    dealt = F.coalesce(F.pmod(F.xxhash64("x", "y"), F.greatest(F.lit(parts), F.ceil(F.col("__n") / most))), F.lit(0)).cast("int")
    partial = points.select(key, "x", "y").join(large, key, "left").select(key, "x", "y", dealt.alias("part")).groupBy(key, "part").applyInPandas(of_points, f"{key} long, n long, pts {kind}")
    return partial.groupBy(key).applyInPandas(of_hulls, f"{key} long, n long, hull {kind}, area double").filter("n >= 3")


def convex_hull(points: np.ndarray) -> list[tuple[float, float]]:
    """Corners of the hull, turning left."""
    ordered = sorted(set(map(tuple, points.tolist())))
    if len(ordered) < 3:
        return ordered

    def half(run):
        out: list[tuple[float, float]] = []
        for p in run:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    lower, upper = half(ordered), half(reversed(ordered))
    return lower[:-1] + upper[:-1]


def hull_point_counts(points: DataFrame, key: str = "district_id", least: int = 3) -> DataFrame:
    """(key, street_points, house_points, points) of the groups with at least ``least`` points; ``points`` has source, street or house."""
    per = points.groupBy(key).agg(F.count_if(F.col("source") == "street").alias("street_points"), F.count_if(F.col("source") == "house").alias("house_points"), F.count("*").alias("points"))
    return per.filter(F.col("points") >= least)


def area_totals(districts: DataFrame, boundaries: DataFrame | None = None, drift: float = 0.01) -> DataFrame:
    """(municipality_id, districts, area): areas summed, overlaps twice. With ``boundaries`` (municipality_id, rings) also boundary_area and within: whether the two differ by at most the share ``drift``."""
    out = districts.groupBy("municipality_id").agg(F.count("*").alias("districts"), F.sum(G.area_m2(F.col("rings"))).alias("area"))
    if boundaries is None:
        return out
    bounds = boundaries.groupBy("municipality_id").agg(F.sum(G.area_m2(F.col("rings"))).alias("boundary_area"))
    return out.join(bounds, "municipality_id", "left").withColumn("within", F.abs(F.col("area") - F.col("boundary_area")) <= drift * F.col("boundary_area"))


def overlays_in_scope(polygons: DataFrame, districts: DataFrame, key: str, cell: float = 1000.0) -> DataFrame:
    """The polygons that share area with at least one district."""
    met = _candidates(polygons, districts, key, "district_id", cell, None)
    shared = with_shared_area(met.select(F.col("a").alias("__a"), F.col("pa.rings").alias("rings_a"), F.col("pb.rings").alias("rings_b"))).filter("area > 0")
    return polygons.join(shared.select("__a").distinct(), polygons[key] == F.col("__a"), "left_semi")


def all_overlaps(detected: DataFrame, stored: DataFrame) -> DataFrame:
    """Detected and stored overlaps (a, b, municipality_id, area) in one table, with their origin."""
    columns = ["a", "b", "municipality_id", "area"]
    return detected.select(*columns, F.lit("detected").alias("origin")).unionByName(stored.select(*columns, F.lit("stored").alias("origin")))


def coverage_gap_area(cells: DataFrame, districts: DataFrame, cell: float) -> DataFrame:
    """(municipality_id, cells, uncovered, gap_m2, gap_share) on a raster of cell middles (municipality_id, cx, cy, x, y)."""
    hits = points_in_polygons(cells.withColumnsRenamed({"cx": "gx", "cy": "gy"}), districts, boundary=True).select("municipality_id", F.col("gx").alias("cx"), F.col("gy").alias("cy")).distinct().withColumn("hit", F.lit(True))
    per = cells.join(hits, ["municipality_id", "cx", "cy"], "left").groupBy("municipality_id").agg(F.count("*").alias("cells"), F.count_if(F.col("hit").isNull()).alias("uncovered"))
    return per.withColumn("gap_m2", F.col("uncovered") * cell * cell).withColumn("gap_share", F.col("uncovered") / F.col("cells"))


def hausdorff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, distance): the largest distance from a corner of one outline to the nearest corner of the other, either way. Both have key and rings; keys with corners in only one are left out.

    Corners look for the nearest one of the other outline in tiles, as cells for seeds, so that they don't meet all of it.
    """
    from .tessellate import tessellate

    corners = lambda df: df.select(F.col(key).alias("municipality_id"), F.explode(F.flatten(F.transform("rings", lambda r: r["pts"]))).alias("p")).select("municipality_id", "p.x", "p.y").distinct()
    one, two = stored(corners(a)), stored(corners(b))
    zero = F.lit(0).cast("long")
    far = lambda x, y: tessellate(x.withColumns({"cx": zero, "cy": zero}), y.withColumn("district_id", zero)).select("municipality_id", "distance")
    return far(one, two).unionByName(far(two, one)).groupBy(F.col("municipality_id").alias(key)).agg(F.max("distance").alias("distance"))


#: Metres outside a polygon that still count as near it.
NEAR = 50.0


def polygon_distance(x: Column, y: Column, rings: Column) -> Column:
    """Distance of a point from a polygon: 0 inside and on the rim, else to the nearest edge; null without rings."""
    to_ring = lambda r: F.array_min(F.transform(G.steps(r["pts"]), lambda e: F.when(e["b"].isNotNull(), G.segment_distance(x, y, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]))))
    return F.when(inside(x, y, rings, True), F.lit(0.0)).otherwise(F.array_min(F.transform(rings, to_ring)))


def school_distances(schools: DataFrame, districts: DataFrame, near: float = NEAR) -> DataFrame:
    """(district_id, school_id, distance, place) of each district with a school of its own: inside, near (within ``near`` metres) or far; unknown without coordinates or outline."""
    s = schools.select("school_id", "x", "y")
    joined = districts.filter("school_id is not null").select("district_id", "school_id", "rings").join(s, "school_id")
    d = joined.withColumn("distance", polygon_distance(F.col("x"), F.col("y"), F.col("rings")))
    place = F.when(F.col("distance").isNull(), "unknown").when(F.col("distance") == 0, "inside").when(F.col("distance") <= near, "near").otherwise("far")
    return d.select("district_id", "school_id", "distance", place.alias("place"))


def ring_fault(points: list[tuple[float, float]]) -> str | None:
    """Why a ring is not valid: empty, too few points, unclosed or crossing itself."""
    if not points:
        return "empty"
    if len(points) < 4:
        return "fewer than 4 points"
    if points[0] != points[-1]:
        return "unclosed"
    p = np.array(points)
    a, b = p[:-1], p[1:]
    turn = lambda o, q, r: np.sign((q[..., 0] - o[..., 0]) * (r[..., 1] - o[..., 1]) - (q[..., 1] - o[..., 1]) * (r[..., 0] - o[..., 0]))
    n = len(a)
    for i in range(n - 1):
        j = np.arange(i + 2, n if i else n - 1)
        if len(j) and ((turn(a[i], b[i], a[j]) * turn(a[i], b[i], b[j]) < 0) & (turn(a[j], b[j], a[i]) * turn(a[j], b[j], b[i]) < 0)).any():
            return "self-intersection"
    return None


def validity(polygons: DataFrame, key: str) -> DataFrame:
    """(key, valid, reason): the first fault of the rings; no rings: empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            faults = [next((x for r in (rings if rings is not None else []) if (x := ring_fault([(p["x"], p["y"]) for p in r["pts"]]))), None) if rings is not None and len(rings) else "empty" for rings in f["rings"]]
            yield pd.DataFrame({key: f[key], "valid": [x is None for x in faults], "reason": faults})

    return polygons.select(key, "rings").mapInPandas(run, f"{key} {dict(polygons.dtypes)[key]}, valid boolean, reason string")


def thinned(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """The line without points that are nearer than ``tolerance`` to the line without them; the ends stay."""
    keep, stack = {0, len(points) - 1}, [(0, len(points) - 1)]
    p = np.array(points, float).reshape(-1, 2)
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        span, off = p[j] - p[i], p[i + 1 : j] - p[i]
        far = np.hypot(*off.T) if not span.any() else np.abs(span[0] * off[:, 1] - span[1] * off[:, 0]) / np.hypot(*span)
        k = int(far.argmax())
        if far[k] > tolerance:
            keep.add(i + 1 + k)
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return [points[i] for i in sorted(keep)] if points else []


def simplify(polygons: DataFrame, tolerance: float) -> DataFrame:
    """``polygons`` with thinned rings; a ring that would fall below a triangle stays as it is."""
    schema = polygons.schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for rings in f["rings"]:
                thin = []
                for r in rings if rings is not None else []:
                    line = [(p["x"], p["y"]) for p in r["pts"]]
                    less = thinned(line, tolerance)
                    thin.append({"hole": r["hole"], "pts": [{"x": x, "y": y} for x, y in (less if len(less) > 3 else line)]})
                out.append(thin)
            yield f.assign(rings=out)

    return polygons.mapInPandas(run, schema)


def topology_report(districts: DataFrame, points: DataFrame, schools: DataFrame) -> DataFrame:
    """(check, failures): invalid outlines, points not in exactly one district, overlapping pairs, districts without a school of theirs inside, districts whose own school is near them, and far."""
    placed = stored(school_distances(schools, districts))
    n = lambda name, df: df.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check"), "failures")
    return (
        n("T1 validity", validity(districts, "district_id").filter("not valid")).unionByName(n("T2 coverage", coverage_failures(points, districts)))
        .unionByName(n("T3 overlaps", overlap_pairs(districts))).unionByName(n("T4 school inside", schools_per_district(schools, districts).filter("school_count = 0")))
        .unionByName(n("T5 school near", placed.filter("place = 'near'"))).unionByName(n("T6 school far", placed.filter("place = 'far'")))
    )
