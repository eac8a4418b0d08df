import math
import random

RINGS = "municipality_id long, rings array<struct<hole: boolean, pts: array<struct<x: double, y: double>>>>"


def star(seed, n, r, cx=0.0, cy=0.0):
    rnd = random.Random(seed)
    pts = [(cx + r * rnd.uniform(0.3, 1) * math.cos(2 * math.pi * k / n), cy + r * rnd.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    return pts + pts[:1]


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def inside(rings, x, y):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def frame(spark, polygons):
    return spark.createDataFrame([(k, [(i > 0, [{"x": float(x), "y": float(y)} for x, y in ring]) for i, ring in enumerate(rings)]) for k, rings in polygons.items()], RINGS)
