"""Column functions over coordinates and rings; lengths in metres, areas in square metres."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# The ellipsoid, the zone's central meridian, scale and false easting, and the sphere's radius.
_A, _FLAT, _LON0, _K0, _EAST, _RADIUS = 6378137.0, 1 / 298.257223563, 21.0, 0.9996, 500000.0, 6371008.8


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance of two points in degrees."""
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * _RADIUS * F.asin(F.sqrt(F.least(half, F.lit(1.0))))


def utm34n(lon: Column, lat: Column) -> Column:
    """struct(x, y): degrees projected to UTM zone 34 north, by the Krüger series."""
    n = _FLAT / (2 - _FLAT)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, dl = F.radians(lat), F.radians(lon - _LON0)
    atanh = lambda x: 0.5 * F.log((1 + x) / (1 - x))
    t = F.sinh(atanh(F.sin(phi)) - e * atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(dl)), atanh(F.sin(dl) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((_EAST + _K0 * radius * east).alias("x"), (_K0 * radius * north).alias("y"))


# The national grid's ellipsoid, the centre's latitude, the cone axis' co-latitude, the pseudo standard
# parallel, its scale and the grid's meridian, in degrees; then the shift to WGS 84 in metres and seconds of arc.
_GRID = {"a": 6377397.155, "flat": 1 / 299.1528128, "centre": 49.5, "axis": 30 + 17 / 60 + 17.30311 / 3600, "parallel": 78.5, "scale": 0.9999, "meridian": 24 + 50 / 60}
_SHIFT, _TURN = (485.021, 169.465, 483.839), (7.786342, 4.397554, 4.102655)


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def grid_to_bessel(x: Column, y: Column) -> Column:
    """struct(lon, lat), in degrees on the grid's own ellipsoid, of easting and northing (both negative) in the national grid: the inverse of the oblique conic projection."""
    g = _GRID
    e2 = g["flat"] * (2 - g["flat"])
    e, centre, axis, parallel = math.sqrt(e2), *(math.radians(g[k]) for k in ("centre", "axis", "parallel"))
    big_a = g["a"] * math.sqrt(1 - e2) / (1 - e2 * math.sin(centre) ** 2)
    big_b = math.sqrt(1 + e2 * math.cos(centre) ** 4 / (1 - e2))
    gamma = math.asin(math.sin(centre) / big_b)
    t0 = math.tan(math.pi / 4 + gamma / 2) * ((1 + e * math.sin(centre)) / (1 - e * math.sin(centre))) ** (e * big_b / 2) / math.tan(math.pi / 4 + centre / 2) ** big_b
    n, r0 = math.sin(parallel), g["scale"] * big_a / math.tan(parallel)
    south, west = -y, -x
    d = F.atan2(west, south) / n
    t = 2 * (F.atan(F.pow(r0 / F.hypot(south, west), F.lit(1 / n)) * math.tan(math.pi / 4 + parallel / 2)) - math.pi / 4)
    better = lambda sphere, phi: 2 * (F.atan(sphere * F.pow((1 + e * F.sin(phi)) / (1 - e * F.sin(phi)), F.lit(e / 2))) - math.pi / 4)

    def degrees(c: Column, u: Column) -> Column:
        v = F.asin(F.cos(c["t"]) * F.sin(c["d"]) / F.cos(u))
        sphere = t0 ** (-1 / big_b) * F.pow(F.tan(u / 2 + math.pi / 4), F.lit(1 / big_b))
        # each pass brings some 150 times more accuracy
        phi = _let(sphere, lambda s: F.aggregate(F.sequence(F.lit(1), F.lit(6)), u, lambda p, _: better(s, p)))
        return F.struct((F.lit(g["meridian"]) - F.degrees(v / big_b)).alias("lon"), F.degrees(phi).alias("lat"))

    sphere_latitude = lambda c: F.asin(math.cos(axis) * F.sin(c["t"]) - math.sin(axis) * F.cos(c["t"]) * F.cos(c["d"]))
    return _let(F.struct(t.alias("t"), d.alias("d")), lambda c: _let(sphere_latitude(c), lambda u: degrees(c, u)))


def bessel_to_wgs84(lon: Column, lat: Column) -> Column:
    """struct(lon, lat) in WGS 84 of degrees on the grid's ellipsoid at height 0, by three shifts and three small turns; good to about a metre."""
    e2, f2, b = _GRID["flat"] * (2 - _GRID["flat"]), _FLAT * (2 - _FLAT), _A * (1 - _FLAT)
    rx, ry, rz = (math.radians(s / 3600) for s in _TURN)

    def place(n: Column) -> Column:
        phi, lam = F.radians(lat), F.radians(lon)
        return F.struct((n * F.cos(phi) * F.cos(lam)).alias("x"), (n * F.cos(phi) * F.sin(lam)).alias("y"), (n * (1 - e2) * F.sin(phi)).alias("z"))

    def shifted(p: Column) -> Column:
        x, y, z = p["x"], p["y"], p["z"]
        return F.struct((x - rz * y + ry * z + _SHIFT[0]).alias("x"), (rz * x + y - rx * z + _SHIFT[1]).alias("y"), (-ry * x + rx * y + z + _SHIFT[2]).alias("z"))

    def degrees(p: Column) -> Column:
        across = F.hypot(p["x"], p["y"])
        latitude = lambda theta: F.atan2(p["z"] + f2 / (1 - f2) * b * F.pow(F.sin(theta), 3), across - f2 * _A * F.pow(F.cos(theta), 3))
        return F.struct(F.degrees(F.atan2(p["y"], p["x"])).alias("lon"), F.degrees(_let(F.atan2(p["z"] * _A, across * b), latitude)).alias("lat"))

    normal = _GRID["a"] / F.sqrt(1 - e2 * F.pow(F.sin(F.radians(lat)), 2))
    return _let(_let(_let(normal, place), shifted), degrees)


def grid_to_degrees(x: Column, y: Column) -> Column:
    """struct(lon, lat) in WGS 84 of easting and northing in the national grid (5514)."""
    return _let(grid_to_bessel(x, y), lambda own: bessel_to_wgs84(own["lon"], own["lat"]))


def steps(points: Column) -> Column:
    """struct(a, b) of successive points; a closed ring repeats its first point at its end."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(points) - 2, F.lit(0))), lambda i: F.struct(F.get(points, i).alias("a"), F.get(points, i + 1).alias("b")))


def length_m(points: Column) -> Column:
    """Length of a line of struct(x, y) points; fewer than two points: 0."""
    total = F.aggregate(steps(points), F.lit(0.0), lambda s, e: s + F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]))
    return F.when(F.size(points) < 2, F.lit(0.0)).otherwise(total)


def ring_area(points: Column) -> Column:
    """Signed area of a closed ring, positive if it turns left."""
    return F.aggregate(steps(points), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def area_m2(rings: Column) -> Column:
    """Area of rings struct(hole, pts): holes count negative."""
    return F.aggregate(rings, F.lit(0.0), lambda s, r: s + F.when(r["hole"], -F.abs(ring_area(r["pts"]))).otherwise(F.abs(ring_area(r["pts"]))))


def centroid(points: Column) -> Column:
    """struct(x, y): the centroid of a closed ring's area; the mean of its points where it has no area."""
    moment = lambda axis: F.aggregate(steps(points), F.lit(0.0), lambda s, e: s + (e["a"][axis] + e["b"][axis]) * (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))
    mean = lambda axis: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[axis]) / F.size(points)
    area = ring_area(points)
    return F.struct(*[F.when(area == 0, mean(axis)).otherwise(moment(axis) / (6 * area)).alias(axis) for axis in ("x", "y")])


def segmentize(points: Column, step: float) -> Column:
    """The line with points put in so that no step is longer than ``step``."""

    def between(e: Column) -> Column:
        far = F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])
        n = F.greatest(F.ceil(far / step).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((e["a"]["x"] + (e["b"]["x"] - e["a"]["x"]) * i / n).alias("x"), (e["a"]["y"] + (e["b"]["y"] - e["a"]["y"]) * i / n).alias("y")))

    last = F.struct(F.element_at(points, -1)["x"].alias("x"), F.element_at(points, -1)["y"].alias("y"))
    return F.when(F.size(points) < 2, points).otherwise(F.concat(F.flatten(F.transform(steps(points), between)), F.array(last)))


def in_ring(x: Column, y: Column, points: Column) -> Column:
    """Whether a ray from the point crosses the ring an odd number of times."""
    crosses = lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y)
    right = lambda e: x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]
    return F.aggregate(steps(points), F.lit(False), lambda s, e: s != F.when(crosses(e), right(e)).otherwise(False))


def on_ring(x: Column, y: Column, points: Column, tolerance: float = 1e-9) -> Column:
    """Whether the point lies on an edge of the ring."""
    return F.exists(steps(points), lambda e: segment_distance(x, y, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]) <= tolerance)


def segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment."""
    span = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    at = F.when(span == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / F.when(span == 0, F.lit(1.0)).otherwise(span))))
    return F.hypot(x - (ax + at * (bx - ax)), y - (ay + at * (by - ay)))


def next_monday_0530(ts: Column | str) -> Column:
    """05:30 of the Monday after the day of ``ts``."""
    return F.to_timestamp(F.next_day(F.to_date(ts), "Mon")) + F.expr("interval 5 hours 30 minutes")
