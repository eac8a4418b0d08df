import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapes import box, frame, inside, star
from zonecheck.operators import parts, spatial, sweep, tessellate
from zonecheck.sources.shared import stored

CELLS = "municipality_id long, cx long, cy long, district_id long"


def flooded(cells):
    """The pieces of {(x, y): district}, numbered by their lowest cell."""
    seen, out, number = {}, {}, {}
    for at in sorted(cells):
        if at in seen:
            continue
        d = cells[at]
        n = number[d] = number.get(d, -1) + 1
        stack = [at]
        seen[at] = True
        while stack:
            x, y = stack.pop()
            out[x, y] = (d, n)
            for near in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if near not in seen and cells.get(near) == d:
                    seen[near] = True
                    stack.append(near)
    return out


def blobs(seed, n, kinds, holes=0.1):
    r = random.Random(seed)
    seeds = [(r.uniform(0, n), r.uniform(0, n), r.randrange(kinds)) for _ in range(3 * kinds)]
    own = lambda x, y: min(seeds, key=lambda s: (s[0] - x) ** 2 + (s[1] - y) ** 2)[2]
    return {(x - 7, y - 9): own(x, y) for x in range(n) for y in range(n) if r.random() > holes}


@pytest.mark.parametrize("tile_bits", [1, 3, 8])
def test_parts_do_not_depend_on_tiles(spark, tile_bits):
    cells = blobs(1, 24, 4) | {(100 + k, 0): 9 for k in range(40)} | {(x, 60 + x % 2 * 8 + y): 8 for x in range(30) for y in range(9 if x % 2 == 0 else 1)}
    df = spark.createDataFrame([(1, x, y, d) for (x, y), d in cells.items()] + [(2, 0, 0, 4)], CELLS)
    got = {(r["cx"], r["cy"]): (r["district_id"], r["part"]) for r in parts.parts(df, tile_bits).collect() if r["municipality_id"] == 1}
    assert got == flooded(cells)
    assert parts.parts(df.limit(0)).count() == 0


def test_components():
    r = random.Random(2)
    a, b = (np.array([r.randrange(300) for _ in range(220)]) for _ in range(2))
    low = parts.components(300, a, b)
    assert all(low[i] == low[j] for i, j in zip(a, b)) and all(low[low] == low) and len(set(low)) >= 80


def test_island_links_equal_all_pairs(spark):
    cells = blobs(3, 40, 3, 0.15) | {(400, 400): 0, (401, 400): 0}
    labelled = parts.parts(spark.createDataFrame([(1, x, y, d) for (x, y), d in cells.items()], CELLS))
    counted = []
    got = {(r["district_id"], r["part"]): ((r["ax"], r["ay"]), (r["bx"], r["by"])) for r in parts.island_links(labelled, 1.0, counted).collect()}
    own = {}
    for at, (d, p) in flooded(cells).items():
        own.setdefault(d, {}).setdefault(p, []).append(at)
    want, pairs = {}, 0
    for d, ps in own.items():
        main = min(ps, key=lambda p: (-len(ps[p]), p))
        for p in ps:
            if p != main:
                pairs += len(ps[p]) * len(ps[main])
                _, a, b = min(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2, a, b) for a in ps[p] for b in ps[main])
                want[d, p] = ((a[0] + 0.5, a[1] + 0.5), (b[0] + 0.5, b[1] + 0.5))
    assert got == want and len(counted) > 2 and sum(counted) < pairs / 2


def test_islands_are_joined_by_their_corridors(spark):
    rows = ["1111", "1111", "....", "1...", "2222", "1111"]
    cells = {(x, y): int(c) for y, row in enumerate(rows) for x, c in enumerate(row) if c != "."}
    labelled = parts.parts(spark.createDataFrame([(1, x, y, d) for (x, y), d in cells.items()], CELLS))
    houses = spark.createDataFrame([(1, 1, 5.0, 35.0), (1, 1, 5.0, 55.0)], "municipality_id long, district_id long, x double, y double")
    got = {(r["district_id"], r["part"]): (r["status"], r["conflicts"]) for r in parts.connect_islands(labelled, houses, 10.0, near=2.0, half=3.0).collect()}
    # district 1: rows 0-1 are the main body, the cell of row 3 is linked over row 2, row 5 only through district 2
    assert sorted(got.values(), key=str) == sorted([("main_body", None), ("connected_to_main", None), ("unresolved_anomaly", [2]), ("main_body", None)], key=str)
    joined = {(r["cx"], r["cy"]): r["district_id"] for r in parts.join_islands(labelled, houses, 10.0, near=2.0, half=3.0).collect()}
    assert joined == cells | {(0, 2): 1}
    after = parts.parts(spark.createDataFrame([(1, x, y, d) for (x, y), d in joined.items()], CELLS))
    assert after.filter("district_id = 1").select("part").distinct().count() == 2
    wide = {(r["cx"], r["cy"]) for r in parts.join_islands(labelled, houses, 10.0, near=2.0, half=10.0).collect()}
    assert wide == set(cells)  # a corridor of ten metres reaches into district 2


# --- areas


def test_shared_areas_against_points():
    r = np.random.default_rng(1)
    for seed in range(25):
        rings = [[{"hole": i > 0, "pts": [{"x": x, "y": y} for x, y in ring]} for i, ring in enumerate(p)] for p in ([star(seed, 3 + seed, 100)], [star(seed + 50, 12, 90, 30, -20), star(seed + 90, 5, 20, 30, -20)])]
        points = r.uniform(-140, 140, (4000, 2))
        pts = [[[(q["x"], q["y"]) for q in ring["pts"]] for ring in p] for p in rings]
        share = sum(inside(pts[0], x, y) and inside(pts[1], x, y) for x, y in points) / 4000 * 280**2
        got = sweep.shared_area(*rings)
        assert abs(got - share) < 5 * math.sqrt(max(share, 100) * 280**2 / 4000)
        assert abs(got - sweep.shared_area(*rings[::-1])) < 1e-6
    ring = lambda n, at: [{"hole": False, "pts": [{"x": at + 1000 * math.cos(0.001 + 2 * math.pi * k / n), "y": 1000 * math.sin(0.001 + 2 * math.pi * k / n)} for k in [*range(n), 0]]}]
    lens = 2 * 1000**2 * math.acos(0.35) - 350 * math.sqrt(4 * 1000**2 - 700**2)
    assert abs(sweep.shared_area(ring(2000, 0), ring(2000, 700)) / lens - 1) < 1e-5
    square = [{"hole": False, "pts": [{"x": x, "y": y} for x, y in box(0, 0, 10, 10)]}, {"hole": True, "pts": [{"x": x, "y": y} for x, y in box(2, 2, 4, 4)]}]
    assert abs(sweep.shared_area(square, square) - 96) < 1e-9 and sweep.shared_area(square, []) == 0.0 and sweep.shared_area(square, None) == 0.0


@pytest.mark.parametrize("strip", [7.0, 40.0, 2000.0])
def test_union_areas_against_inclusion_and_exclusion(spark, strip):
    boundary = frame(spark, {1: [box(0, 0, 100, 100)], 2: [box(0, 0, 10, 10)], 3: [star(5, 30, 50)]})
    boxes = [(1, 1, box(-5, -5, 60, 60)), (2, 1, box(40, 40, 90, 110)), (3, 1, box(50, 50, 70, 70)), (4, 3, box(-60, -60, 60, 0))]
    pts = lambda ring: [(False, [{"x": float(x), "y": float(y)} for x, y in ring])]
    polygons = spark.createDataFrame([(k, m, pts(ring)) for k, m, ring in boxes], "district_id long, municipality_id long, rings array<struct<hole: boolean, pts: array<struct<x: double, y: double>>>>")
    got = {r["municipality_id"]: r for r in sweep.union_areas(polygons, boundary, "district_id", "municipality_id", strip).collect()}
    a, b, both = 60 * 60, 50 * 60, 20 * 20
    many = both + 20 * 20 - 10 * 10  # the third box lies in the first two or in one of them
    assert [round(got[1][c], 6) for c in ("boundary_area", "covered_area", "gap_area", "multi_area")] == [10000, a + b - both, 10000 - (a + b - both), many]
    assert (got[2]["boundary_area"], got[2]["covered_area"], got[2]["gap_area"]) == (100.0, 0.0, 100.0)
    ring = [{"hole": False, "pts": [{"x": x, "y": y} for x, y in star(5, 30, 50)]}]
    half = [{"hole": False, "pts": [{"x": float(x), "y": float(y)} for x, y in box(-60, -60, 60, 0)]}]
    assert abs(got[3]["covered_area"] - sweep.shared_area(ring, half)) < 1e-6 and abs(got[3]["boundary_area"] - sweep.shared_area(ring, ring)) < 1e-6


def test_large_polygons_meet_points_by_their_cover(spark, monkeypatch):
    polygons = spatial.with_box(frame(spark, {1: [star(1, 25, 4000)], 2: [box(0, 0, 900, 900)]})).withColumnRenamed("municipality_id", "district_id")
    r = random.Random(1)
    points = spark.createDataFrame([(i, r.uniform(-4000, 4000), r.uniform(-4000, 4000)) for i in range(1500)] + [(9000, 900.0, 450.0)], "p long, x double, y double")
    found = []
    for cells in (0, 4, 10**9):
        monkeypatch.setattr(spatial, "BOX_CELLS", cells)
        found.append(sorted((x["p"], x["district_id"]) for x in spatial.points_in_polygons(points, polygons, 200.0, boundary=True, same=None).collect()))
    assert found[0] == found[1] == found[2] and (9000, 2) in found[0]


def test_raster_and_seeds_inside_an_outline(spark):
    bounds = frame(spark, {1: [box(0, 0, 400, 400), box(100, 100, 200, 200)]})
    assert tessellate.raster(bounds, 100.0).count() == 15
    columns = "municipality_id long, district_id long, street_norm string, x double, y double"
    lines = tessellate.street_points(spark.createDataFrame([(1, 1, 5, "a", [(-50.0, 50.0), (450.0, 50.0)])], "line_id long, municipality_id long, district_id long, street_norm string, pts array<struct<x: double, y: double>>"), bounds, 100.0)
    assert sorted(r["x"] for r in lines.collect()) == [0.0, 100.0, 200.0, 300.0, 400.0]
    fallback = spark.createDataFrame([(1, 5, "a", 10.0, 10.0), (1, 6, "b", 150.0, 150.0), (1, 6, "c", 10.0, 300.0)], columns)
    houses = spark.createDataFrame([(1, 7, 50.0, 50.0), (1, 7, 500.0, 50.0), (2, 7, 50.0, 50.0)], "municipality_id long, district_id long, x double, y double")
    got = sorted((r["district_id"], r["x"], r["y"]) for r in tessellate.seeds(lines, fallback, houses, bounds).collect())
    assert got == [(5, 0.0, 50.0), (5, 100.0, 50.0), (5, 200.0, 50.0), (5, 300.0, 50.0), (5, 400.0, 50.0), (6, 10.0, 300.0), (7, 50.0, 50.0)]


def test_seeds_on_an_edge_are_held_by_parity(spark):
    bounds = frame(spark, {1: [box(0, 0, 400, 400)]})
    lines = spark.createDataFrame([], "municipality_id long, district_id long, street_norm string, x double, y double")
    fallback = spark.createDataFrame([(1, 5, "a", 0.0, 10.0), (1, 5, "b", 400.0, 10.0)], lines.schema)
    houses = spark.createDataFrame([(1, 7, 10.0, 0.0), (1, 7, 10.0, 400.0), (1, 7, 0.0, 200.0), (1, 7, 400.0, 400.0)], "municipality_id long, district_id long, x double, y double")
    got = sorted((r["district_id"], r["x"], r["y"]) for r in tessellate.seeds(lines, fallback, houses, bounds).collect())
    assert got == [(5, 0.0, 10.0), (7, 0.0, 200.0), (7, 10.0, 0.0)]


def cells_as_a_file(spark):
    cells = spark.range(0, 400).select(F.lit(1).cast("long").alias("municipality_id"), (F.col("id") % 7).alias("district_id"), F.lit(0).alias("part"), (F.col("id") / 20).cast("long").alias("cx"), (F.col("id") % 20).alias("cy"))
    return stored(cells)


def joins(df):
    return re.findall(r"BroadcastHashJoin|BroadcastNestedLoopJoin|SortMergeJoin", df._jdf.queryExecution().executedPlan().toString())


def test_borders_do_not_broadcast_cells(spark):
    assert joins(tessellate.neighbour_borders(cells_as_a_file(spark))) == ["SortMergeJoin"]


def test_joined_islands_do_not_broadcast_cells(spark):
    cells = cells_as_a_file(spark)
    corridors = cells.select(F.lit("a").alias("line_id"), "municipality_id", F.lit(50).cast("long").alias("district_id"), "cx", "cy").limit(3).localCheckpoint()
    assert joins(parts.corridor_conflicts(corridors, cells)) == ["SortMergeJoin"]
    free = stored(corridors.select("line_id").distinct())
    assert joins(parts.joined_cells(cells, corridors, free)).count("SortMergeJoin") >= 1
    assert joins(parts.rim_cells(cells)) == []


def test_evidence_does_not_broadcast_cells(spark):
    cells = cells_as_a_file(spark)
    houses = stored(cells.select("municipality_id", "district_id", (F.col("cx") * 10.0 + 5).alias("x"), (F.col("cy") * 10.0 + 5).alias("y")))
    assert joins(tessellate.part_evidence(cells, houses, 10.0)) == ["SortMergeJoin"]
