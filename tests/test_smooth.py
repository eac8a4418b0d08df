import random

import pytest

from shapes import box, frame, star
from zonecheck.operators import smooth

KEY = "municipality_id"


def cells(df):
    return {(r[KEY], x, r["cy"]) for r in df.collect() for x in range(r["a"], r["b"] + 1)}


def disk(r):
    return [(x, y) for x in range(-9, 10) for y in range(-9, 10) if x * x + y * y <= r * r]


@pytest.mark.parametrize("radius", [1.0, 2.5, 3.0])
def test_grown_and_shrunk_against_cells(spark, radius):
    rnd = random.Random(1)
    own = {(k, x, y) for k in (1, 2) for x in range(18) for y in range(14) if rnd.random() < (0.9 if k == 1 else 0.5)}
    shape = smooth._merged(spark.createDataFrame([(k, y, x, x) for k, x, y in own], f"{KEY} long, cy long, a long, b long"), KEY)
    assert cells(shape) == own
    more = {(k, x + i, y + j) for k, x, y in own for i, j in disk(radius)}
    assert cells(smooth.grown(shape, radius, KEY)) == more
    less = {(k, x, y) for k, x, y in own if all((k, x + i, y + j) in own for i, j in disk(radius))}
    assert cells(smooth.shrunk(shape, radius, KEY)) == less
    closed = {(k, x, y) for k, x, y in more if all((k, x + i, y + j) in more for i, j in disk(radius))}
    assert cells(smooth.smoothed(shape, radius, KEY, spikes=False)) == closed and closed >= own


def test_spikes_and_gaps_go(spark):
    comb = [(0, 0), (100, 0), (100, 60), (52, 60), (52, 20), (48, 20), (48, 60), (20, 60), (20, 90), (18, 90), (18, 60), (0, 60), (0, 0)]  # a notch and a spike
    polygons = frame(spark, {1: [[(float(x), float(y)) for x, y in comb]], 2: [box(0, 0, 30, 30)], 3: [box(0, 0, 3, 3)], 4: []})
    got = {r[KEY]: r for r in smooth.smooth_report(polygons, 5.0, 1.0, KEY).collect()}
    assert set(got) == {1, 2, 3} and got[3]["area_after"] == 0.0 and got[3]["drift"] == -1.0
    assert abs(got[2]["drift"]) < 0.05
    kept = {(r["cx"], r["cy"]) for r in smooth.smoothed_cells(polygons, 5.0, 1.0, KEY).collect() if r[KEY] == 1}
    assert (50, 40) in kept and (19, 80) not in kept and (30, 30) in kept and (50, 70) not in kept
    only = {(r["cx"], r["cy"]) for r in smooth.smoothed_cells(polygons, 5.0, 1.0, KEY, spikes=False).collect() if r[KEY] == 1}
    assert (50, 40) in only and (19, 80) in only
    assert smooth.smooth_report(polygons.limit(0), 5.0, 1.0, KEY).count() == 0


def test_runs_are_the_cells_of_the_outline(spark):
    from zonecheck.operators import outline

    polygons = frame(spark, {1: [star(1, 21, 900), star(2, 5, 150)]})
    want = {(r[KEY], r["cx"], r["cy"]) for r in outline.outline_cells(polygons, 20.0, KEY).collect()}
    assert cells(smooth.runs(polygons, 20.0, KEY)) == want
