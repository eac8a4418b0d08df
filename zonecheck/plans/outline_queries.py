"""Registered queries over outlines that are no boxes: rasters, covers, clipped lines, exact areas, joined islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import outline, smooth, spatial, tessellate
from .part_queries import CORRIDORS, LINKS, RANKED, SEED_CELLS, SHOTS, evidence_sql, labelled
from .queries import query
from .spatial_queries import BOUNDS, CELL, OWNED, addresses, districts
from .views import Views

EDGES = "edge AS (SELECT * FROM (SELECT municipality_id, x AS x1, y AS y1, lead(x) OVER (PARTITION BY municipality_id, ring ORDER BY seq) AS x2, lead(y) OVER (PARTITION BY municipality_id, ring ORDER BY seq) AS y2 FROM f_outline) e WHERE x2 IS NOT NULL)"


def held_sql(points: str, columns: str) -> str:
    """Rows of ``points`` inside their municipality's outline: those with an odd number of edges to their right."""
    on = "e.municipality_id = p.municipality_id AND (e.y1 > p.y) <> (e.y2 > p.y) AND p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1"
    return f"SELECT {columns} FROM {points} p JOIN edge e ON {on} GROUP BY {columns} HAVING count(*) % 2 = 1"


RASTER = f"{EDGES}, {OWNED.split(' owned AS')[0].rstrip().rstrip(',')}, held AS ({held_sql('cells', 'p.municipality_id, p.cx, p.cy, p.x, p.y')})"


def outlines(v: Views) -> DataFrame:
    """(municipality_id, rings)."""
    ring = v("f_outline").groupBy("municipality_id", "ring").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    pts = F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))
    return ring.groupBy("municipality_id").agg(F.array_sort(F.collect_list(F.struct((F.col("ring") > 0).alias("hole"), pts.alias("pts")))).alias("rings"))


@query(f"WITH {RASTER} SELECT municipality_id, cx, cy FROM held")
def outline_cells(v: Views) -> DataFrame:
    return outline.outline_cells(outlines(v), CELL, "municipality_id").select("municipality_id", "cx", "cy")


@query(f"WITH {EDGES} {held_sql('f_address', 'p.address_id, p.municipality_id')}")
def points_in_outlines(v: Views) -> DataFrame:
    return outline.points_in_outlines(addresses(v), outlines(v), "municipality_id", CELL, None, same="municipality_id").select("address_id", "municipality_id")


@query(f"""WITH {RASTER}, inner_seeds AS ({held_sql('f_seed', 'p.municipality_id, p.district_id, p.x, p.y, p.l_orderkey, p.l_linenumber')}),
 near AS (SELECT c.municipality_id, c.cx, c.cy, min(CAST((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y) AS BIGINT) * 1000000 + s.district_id) % 1000000 AS district_id
  FROM held c JOIN (SELECT DISTINCT municipality_id, district_id, x, y FROM inner_seeds) s ON s.municipality_id = c.municipality_id GROUP BY 1, 2, 3)
 SELECT district_id, count(*) AS cells, count(*) * {CELL * CELL}e0 AS area FROM near GROUP BY 1""")
def tessellate_outline(v: Views) -> DataFrame:
    bounds = outlines(v)
    seeds = outline.points_in_outlines(v("f_seed").select("municipality_id", "district_id", "x", "y"), bounds, "municipality_id", 500.0, None, same="municipality_id")
    return tessellate.district_cells(tessellate.tessellate(tessellate.raster(bounds, CELL), seeds), CELL)


@query(f"""WITH {EDGES}, s AS (SELECT *, 's' || (l_partkey % 400) AS street_norm FROM f_seed), f AS (SELECT * FROM s WHERE l_linenumber = 2 AND NOT EXISTS (SELECT 1 FROM s o WHERE o.l_linenumber = 1 AND o.district_id = s.district_id AND o.street_norm = s.street_norm)),
 p AS (SELECT municipality_id, district_id, x, y FROM s WHERE l_linenumber > 2 UNION ALL SELECT municipality_id, district_id, x, y FROM f), u AS (SELECT DISTINCT * FROM p)
 SELECT municipality_id, district_id, x, y FROM s WHERE l_linenumber = 1 UNION {held_sql('u', 'p.municipality_id, p.district_id, p.x, p.y')}""")
def seeds(v: Views) -> DataFrame:
    s = v("f_seed").withColumn("street_norm", F.concat(F.lit("s"), (F.col("l_partkey") % 400).cast("string")))
    return tessellate.seeds(s.filter("l_linenumber = 1"), s.filter("l_linenumber = 2"), s.filter("l_linenumber > 2"), outlines(v))


# a line's cuts by all edges of the outline; a piece counts if its middle is inside
@query(f"""WITH {EDGES}, cut AS (SELECT l.line_id, l.municipality_id, ((e.x1 - ax) * (e.y2 - e.y1) - (e.y1 - ay) * (e.x2 - e.x1)) / den AS t, ((e.x1 - ax) * (bz - ay) - (e.y1 - ay) * (bx - ax)) / den AS u
  FROM (SELECT *, (bx - ax) * (y2 - y1) - (bz - ay) * (x2 - x1) AS den FROM f_line l JOIN edge USING (municipality_id)) l JOIN LATERAL (SELECT l.x1, l.y1, l.x2, l.y2) e ON true WHERE den <> 0),
 ts AS (SELECT line_id, municipality_id, list_sort(list_concat([0e0, 1e0], list_distinct(list(t) FILTER (t > 0 AND t < 1 AND u >= 0 AND u <= 1)))) AS ts FROM cut GROUP BY 1, 2),
 piece AS (SELECT line_id, municipality_id, ts[i] AS a, ts[i + 1] AS b FROM (SELECT *, unnest(range(1, len(ts))) AS i FROM ts) x),
 mid AS (SELECT p.line_id, p.municipality_id, a, b, sqrt(pow(bx - ax, 2) + pow(bz - ay, 2)) AS far, ax + (bx - ax) * (a + b) / 2 AS x, ay + (bz - ay) * (a + b) / 2 AS y FROM piece p JOIN f_line l USING (line_id)),
 held AS ({held_sql('mid', 'p.line_id, p.municipality_id, p.a, p.b, p.far')})
 SELECT line_id, count(*) AS pieces, round(sum((b - a) * far), 4) AS length FROM held GROUP BY 1""")
def clip_lines(v: Views) -> DataFrame:
    end = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    lines = v("f_line").select("line_id", "municipality_id", F.array(end("ax", "ay"), end("bx", "bz")).alias("pts"))
    pieces = outline.clip_lines(lines, outlines(v), "municipality_id", "line_id")
    return pieces.groupBy("line_id").agg(F.count("*").alias("pieces"), F.round(F.sum(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))), 4).alias("length"))


# the area of an outline in a box: what lies between the box's floor and each edge, held in the box, signed by the edge's direction
HELD = "CASE WHEN {y} <= y0 THEN 0 WHEN {y} <= y1 THEN ({y} - y0) * ({y} - y0) / 2 ELSE (y1 - y0) * (y1 - y0) / 2 + (y1 - y0) * ({y} - y1) END"


@query(f"""WITH {EDGES}, met AS (SELECT d.district_id, d.x0, d.y0, d.x1, d.y1, e.municipality_id, e.x1 AS ax, e.y1 AS ay, e.x2 AS bx, e.y2 AS bz, greatest(d.x0, least(e.x1, e.x2)) AS xa, least(d.x1, greatest(e.x1, e.x2)) AS xb FROM f_district d JOIN edge e ON e.x1 <> e.x2),
 slope AS (SELECT *, (bz - ay) / (bx - ax) AS m, ay + (bz - ay) / (bx - ax) * (xa - ax) AS ya, ay + (bz - ay) / (bx - ax) * (xb - ax) AS yb FROM met WHERE xa < xb),
 part AS (SELECT district_id, municipality_id, sign(bx - ax) * (({HELD.format(y='yb')}) - ({HELD.format(y='ya')})) / m AS area FROM slope),
 shared AS (SELECT district_id, municipality_id, abs(sum(area)) AS area FROM part GROUP BY 1, 2)
 SELECT d.district_id, round(coalesce(sum(area), 0e0), 3) AS shared_area FROM f_district d LEFT JOIN shared s ON s.district_id = d.district_id GROUP BY 1""")
def outline_shares(v: Views) -> DataFrame:
    shared = spatial.intersection_area(districts(v), spatial.with_box(outlines(v)), "municipality_id")
    return shared.select("district_id", F.round("shared_area", 3).alias("shared_area"))


# all boxes of a municipality cut the plane into cells, which each lie wholly inside or outside of each box
@query(f"""WITH {BOUNDS}, px AS (SELECT DISTINCT municipality_id, x FROM (SELECT municipality_id, x0 AS x FROM f_district UNION ALL SELECT municipality_id, x1 FROM f_district) u), py AS (SELECT DISTINCT municipality_id, y FROM (SELECT municipality_id, y0 AS y FROM f_district UNION ALL SELECT municipality_id, y1 FROM f_district) u),
 sx AS (SELECT municipality_id, x AS xa, lead(x) OVER (PARTITION BY municipality_id ORDER BY x) AS xb FROM px), sy AS (SELECT municipality_id, y AS ya, lead(y) OVER (PARTITION BY municipality_id ORDER BY y) AS yb FROM py),
 cell AS (SELECT sx.municipality_id, (xb - xa) * (yb - ya) AS area, (SELECT count(*) FROM f_district d WHERE d.municipality_id = sx.municipality_id AND d.x0 <= xa AND d.x1 >= xb AND d.y0 <= ya AND d.y1 >= yb) AS n FROM sx JOIN sy ON sy.municipality_id = sx.municipality_id WHERE xb IS NOT NULL AND yb IS NOT NULL)
 SELECT municipality_id, round(sum(area), 3) AS boundary_area, round(coalesce(sum(area) FILTER (n > 0), 0e0), 3) AS covered_area, round(coalesce(sum(area) FILTER (n = 0), 0e0), 3) AS gap_area, round(coalesce(sum(area) FILTER (n > 1), 0e0), 3) AS multi_area FROM cell GROUP BY 1""")
def gap_areas(v: Views) -> DataFrame:
    bounds = v("f_district").groupBy("municipality_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    areas = spatial.union_areas(districts(v), spatial.box_polygons(bounds), "district_id", "municipality_id")
    return areas.select("municipality_id", *[F.round(c, 3).alias(c) for c in ("boundary_area", "covered_area", "gap_area", "multi_area")])


@query(f"""WITH RECURSIVE {RANKED}, {SEED_CELLS}, {evidence_sql('lab', 'ev', 'seed_cells')}, {LINKS}, {SHOTS}, {CORRIDORS},
 free AS (SELECT l.municipality_id, l.district_id, l.part FROM lines l JOIN ev e ON e.municipality_id = l.municipality_id AND e.district_id = l.district_id AND e.part = l.part WHERE e.houses > 0
  AND NOT EXISTS (SELECT 1 FROM blocked b WHERE b.municipality_id = l.municipality_id AND b.district_id = l.district_id AND b.part = l.part)
  AND NOT EXISTS (SELECT 1 FROM corridors c JOIN lab o ON o.municipality_id = c.municipality_id AND o.cx = c.cx AND o.cy = c.cy AND o.district_id <> c.district_id WHERE c.municipality_id = l.municipality_id AND c.district_id = l.district_id AND c.part = l.part)),
 new AS (SELECT c.municipality_id, c.cx, c.cy, min(c.district_id) AS district_id FROM corridors c JOIN free USING (municipality_id, district_id, part) WHERE NOT EXISTS (SELECT 1 FROM lab o WHERE o.municipality_id = c.municipality_id AND o.cx = c.cx AND o.cy = c.cy) GROUP BY 1, 2, 3)
 SELECT district_id, count(*) AS cells FROM (SELECT district_id FROM lab UNION ALL SELECT district_id FROM new) u GROUP BY 1""")
def join_islands(v: Views) -> DataFrame:
    joined = tessellate.join_islands(labelled(v), v("f_seed").select("municipality_id", "district_id", "x", "y"), CELL)
    return joined.groupBy("district_id").agg(F.count("*").alias("cells"))


DISK = "disk AS (SELECT dx, dy FROM (SELECT unnest(range(-2, 3)) AS dx) a, (SELECT unnest(range(-2, 3)) AS dy) b WHERE dx * dx + dy * dy <= 4)"


def _grown_sql(cells: str, name: str) -> str:
    return f"{name} AS (SELECT DISTINCT municipality_id, cx + dx AS cx, cy + dy AS cy FROM {cells}, disk)"


def _shrunk_sql(cells: str, name: str) -> str:
    """Cells of which all thirteen of the disk are there."""
    return f"{name} AS (SELECT c.municipality_id, c.cx, c.cy FROM {cells} c, disk JOIN {cells} o ON o.municipality_id = c.municipality_id AND o.cx = c.cx + dx AND o.cy = c.cy + dy GROUP BY 1, 2, 3 HAVING count(*) = 13)"


SMOOTH = f"{RASTER}, {DISK}, {_grown_sql('held', 'g1')}, {_shrunk_sql('g1', 'g2')}, {_shrunk_sql('g2', 'g3')}, {_grown_sql('g3', 'g4')}"


@query(f"WITH {SMOOTH} SELECT municipality_id, cx, cy FROM g4")
def smoothed_cells(v: Views) -> DataFrame:
    return smooth.smoothed_cells(outlines(v), 2 * CELL, CELL, "municipality_id")


@query(f"""WITH {SMOOTH}, a AS (SELECT municipality_id, count(*) * {CELL * CELL}e0 AS area_before FROM held GROUP BY 1), b AS (SELECT municipality_id, count(*) * {CELL * CELL}e0 AS area_after FROM g4 GROUP BY 1)
 SELECT a.municipality_id, area_before, coalesce(area_after, 0e0) AS area_after, coalesce(area_after, 0e0) / area_before - 1 AS drift FROM a LEFT JOIN b ON b.municipality_id = a.municipality_id""")
def smooth_report(v: Views) -> DataFrame:
    return smooth.smooth_report(outlines(v), 2 * CELL, CELL, "municipality_id")
