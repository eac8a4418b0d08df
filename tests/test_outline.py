import random

import pytest
from pyspark.sql import functions as F

from shapes import box, frame, inside, star
from zonecheck.operators import outline

POLYGONS = {1: [star(1, 40, 5000), star(2, 9, 900)], 2: [star(3, 7, 300, 8000, -2000)], 3: [box(-700, 300, 900, 1900), box(-100, 900, 300, 1300)], 4: [box(10, 10, 20, 20)], 5: []}


@pytest.mark.parametrize("cell", [100.0, 37.0])
def test_outline_cells_are_the_middles_inside(spark, cell):
    got = {(r["municipality_id"], r["cx"], r["cy"]) for r in outline.outline_cells(frame(spark, POLYGONS), cell, "municipality_id").collect()}
    want = set()
    for k, rings in POLYGONS.items():
        if rings:
            xs, ys = [p[0] for p in rings[0]], [p[1] for p in rings[0]]
            for i in range(int(min(xs) // cell) - 1, int(max(xs) // cell) + 2):
                for j in range(int(min(ys) // cell) - 1, int(max(ys) // cell) + 2):
                    if inside(rings, (i + 0.5) * cell, (j + 0.5) * cell):
                        want.add((k, i, j))
    assert got == want and any(k == 1 for k, _, _ in want)


def test_boxes_side_by_side_share_no_cell(spark):
    polygons = frame(spark, {1: [box(0, 0, 150, 150)], 2: [box(150, 0, 300, 150)]})
    cells = [(r["cx"], r["cy"]) for r in outline.outline_cells(polygons, 100.0, "municipality_id").collect()]
    assert sorted(cells) == [(0, 0), (1, 0), (2, 0)]


def test_points_in_outlines_against_parity(spark):
    rnd = random.Random(5)
    points = [(i, rnd.uniform(-6000, 9000), rnd.uniform(-6000, 6000)) for i in range(4000)] + [(9001, 10.0, 15.0), (9002, 15.0, 20.0), (9003, -700.0, 300.0), (9004, None, 1.0)]
    df = spark.createDataFrame(points, "p long, x double, y double")
    for boundary in (False, True):
        got = sorted((r["p"], r["municipality_id"]) for r in outline.points_in_outlines(df, frame(spark, POLYGONS), "municipality_id", 120.0, boundary).collect())
        want = sorted((i, k) for i, x, y in points if x is not None and (i < 9000 or i == 9003) for k, rings in POLYGONS.items() if inside(rings, x, y))
        rim = {(9001, 4), (9002, 4), (9003, 3)}
        assert set(got) == (set(want) | rim if boundary else set(want) - rim) and len(got) == len(set(got))
    same = df.withColumn("municipality_id", F.lit(1).cast("long"))
    got = {r["p"] for r in outline.points_in_outlines(same, frame(spark, POLYGONS), "municipality_id", 120.0, same="municipality_id").collect()}
    assert got == {i for i, x, y in points if x is not None and inside(POLYGONS[1], x, y)}


def test_points_on_edges_by_parity(spark):
    polygons = {1: [box(0, 0, 150, 150), box(50, 50, 100, 100)], 2: [box(150, 0, 300, 150)], 3: [[(0.0, 0.0), (90.0, 30.0), (0.0, 60.0), (0.0, 0.0)]]}
    points = [(i * 100 + j, i * 10.0, j * 10.0) for i in range(-1, 32) for j in range(-1, 17)] + [(9001, 45.0, 15.0), (9002, 45.0, 45.0)]
    df = spark.createDataFrame(points, "p long, x double, y double")
    got = sorted((r["p"], r["municipality_id"]) for r in outline.points_in_outlines(df, frame(spark, polygons), "municipality_id", 40.0, None).collect())
    assert got == sorted((p, k) for p, x, y in points for k, rings in polygons.items() if inside(rings, x, y))
    # of boxes side by side one has the points of their common edge
    assert [(1507, k) in got for k in (1, 2)] == [False, True]


def test_cover_grows_with_the_rim(spark):
    small, large = (outline.cover(frame(spark, {1: [box(0.5, 0.5, w, w)]}), 10.0, "municipality_id").groupBy("rim").count().collect() for w in (1000.0, 16000.0))
    n = lambda rows: sum(r["count"] for r in rows)
    assert n(large) < 20 * n(small) and n(large) < 1600 * 1600 / 50


def test_clip_lines(spark):
    polygons = frame(spark, {1: [box(0, 0, 1000, 1000), box(400, 400, 600, 600)], 2: [box(0, 0, 10, 10)]})
    pt = lambda *c: [{"x": float(x), "y": float(y)} for x, y in c]
    lines = spark.createDataFrame(
        [(1, 1, pt((-100, 500), (1100, 500))), (2, 1, pt((100, 100), (200, 100), (200, 2000))), (3, 1, pt((5000, 5000), (6000, 6000))), (4, 2, pt((5, 5), (5, 6))), (5, 1, pt((0, 0), (1000, 0))), (6, 1, pt((3, 3)))],
        "line_id long, municipality_id long, pts array<struct<x: double, y: double>>",
    )
    got = outline.clip_lines(lines, polygons, "municipality_id", "line_id", 130.0)
    length = {r["line_id"]: round(r["m"], 6) for r in got.groupBy("line_id").agg(F.sum(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).alias("m")).collect()}
    assert length == {1: 800.0, 2: 1000.0, 4: 1.0, 5: 1000.0}


def test_empty(spark):
    none = frame(spark, {}).limit(0)
    assert outline.outline_cells(none, 10.0, "municipality_id").count() == 0
    points = spark.createDataFrame([(1, 1.0, 1.0)], "p long, x double, y double")
    assert outline.points_in_outlines(points, none, "municipality_id", 10.0).count() == 0
