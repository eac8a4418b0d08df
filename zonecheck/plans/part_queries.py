"""Registered queries over the parts of tessellated districts, their evidence, absorption and links, and over hulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import hull, outline, serve, spatial, tessellate
from ..sources.shared import stored
from .queries import query
from .spatial_queries import CELL, HITS, OWNED, addresses, districts, owned
from .views import Views

STEPS = "(VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) s(dx, dy)"


def labelled_sql(cells: str, lab: str) -> str:
    """CTEs up to ``lab``: ``cells`` with part, by all pairs of cells that hang together."""
    key = "municipality_id, district_id, cx, cy"
    return f"""{lab}_near AS (SELECT a.municipality_id, a.district_id, a.cx, a.cy, b.cx AS nx, b.cy AS ny FROM {cells} a CROSS JOIN {STEPS} JOIN {cells} b ON b.municipality_id = a.municipality_id AND b.district_id = a.district_id AND b.cx = a.cx + dx AND b.cy = a.cy + dy),
 {lab}_reach({key}, rx, ry) AS (SELECT {key}, cx, cy FROM {cells} UNION SELECT r.municipality_id, r.district_id, r.cx, r.cy, n.nx, n.ny FROM {lab}_reach r JOIN {lab}_near n ON n.municipality_id = r.municipality_id AND n.district_id = r.district_id AND n.cx = r.rx AND n.cy = r.ry),
 {lab}_low AS (SELECT {key}, min((rx + 100000) * 1000000 + ry + 100000) AS low FROM {lab}_reach GROUP BY ALL),
 {lab} AS (SELECT {key}, CAST(dense_rank() OVER (PARTITION BY municipality_id, district_id ORDER BY low) - 1 AS INT) AS part FROM {lab}_low)"""


LAB = f"{OWNED}, {labelled_sql('owned', 'lab')}"
AREAS = "SELECT municipality_id, district_id, part, count(*) * " + f"{CELL * CELL}e0 AS area_m2 FROM {{lab}} GROUP BY 1, 2, 3"
PARTS = f"{LAB}, parts AS ({AREAS.format(lab='lab')})"
RANKED = f"{PARTS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY district_id ORDER BY area_m2 DESC, part) AS n, count(*) OVER (PARTITION BY district_id) AS k, sum(area_m2) OVER (PARTITION BY district_id) AS total_m2 FROM parts)"


def longest_sql(lab: str, name: str) -> str:
    return f"""{name} AS (SELECT municipality_id, district_id, part, "to" FROM (SELECT *, row_number() OVER (PARTITION BY municipality_id, district_id, part ORDER BY border DESC, "to") AS n
 FROM (SELECT a.municipality_id, a.district_id, a.part, b.district_id AS "to", count(*) AS border FROM {lab} a CROSS JOIN {STEPS} JOIN {lab} b ON b.municipality_id = a.municipality_id AND b.cx = a.cx + dx AND b.cy = a.cy + dy WHERE b.district_id <> a.district_id GROUP BY ALL) g) r WHERE n = 1)"""


def absorbed_sql(lab: str, longest: str, moving: str, name: str) -> str:
    on = "m.municipality_id = l.municipality_id AND m.district_id = l.district_id AND m.part = l.part"
    return f"""{name} AS (SELECT l.municipality_id, l.cx, l.cy, coalesce(m."to", l.district_id) AS district_id FROM {lab} l LEFT JOIN (SELECT g.* FROM {longest} g SEMI JOIN {moving} USING (municipality_id, district_id, part)) m ON {on})"""


HOUSES = f"{HITS}, houses AS (SELECT h.municipality_id, h.district_id, CAST(floor(a.x / {CELL}) AS BIGINT) AS cx, CAST(floor(a.y / {CELL}) AS BIGINT) AS cy FROM hits h JOIN f_address a ON a.address_id = h.address_id)"


def evidence_sql(lab: str, name: str, houses: str = "houses") -> str:
    return f"{name} AS (SELECT l.municipality_id, l.district_id, l.part, count(h.cx) AS houses FROM {lab} l LEFT JOIN {houses} h ON h.municipality_id = l.municipality_id AND h.district_id = l.district_id AND h.cx = l.cx AND h.cy = l.cy GROUP BY 1, 2, 3)"


def labelled(v: Views) -> DataFrame:
    return stored(tessellate.parts(owned(v)))


def areas(v: Views) -> DataFrame:
    return tessellate.part_areas(labelled(v), CELL)


def houses(v: Views) -> DataFrame:
    return spatial.points_in_polygons(addresses(v), districts(v)).select("municipality_id", "district_id", "x", "y")


@query(f"WITH RECURSIVE {PARTS} SELECT * FROM parts")
def parts(v: Views) -> DataFrame:
    return areas(v)


@query(f"WITH RECURSIVE {RANKED} SELECT municipality_id, district_id, part, area_m2, total_m2, k AS parts, area_m2 / total_m2 AS share FROM ranked")
def part_shares(v: Views) -> DataFrame:
    return tessellate.part_shares(areas(v))


SLIVERS = "slivers AS (SELECT municipality_id, district_id, part, area_m2 FROM ranked WHERE k > 1 AND area_m2 < 0.05e0 * 1e6 AND area_m2 / total_m2 < 0.02e0)"


@query(f"WITH RECURSIVE {RANKED}, {SLIVERS} SELECT * FROM slivers")
def sliver_parts(v: Views) -> DataFrame:
    return tessellate.sliver_parts(areas(v)).select("municipality_id", "district_id", "part", "area_m2")


@query(f"WITH RECURSIVE {RANKED} SELECT municipality_id, district_id, part, area_m2, CASE WHEN n = 1 THEN 'main_body' ELSE 'unresolved_anomaly' END AS status, CASE WHEN n > 1 THEN 'multi_part_review' END AS anomaly_type, CASE WHEN n > 1 THEN 'medium' END AS severity FROM ranked")
def mark_main_body(v: Views) -> DataFrame:
    return tessellate.mark_main_body(areas(v))


@query(f"WITH RECURSIVE {RANKED} SELECT municipality_id, district_id, part, area_m2, CAST(n AS INT) AS rank FROM ranked WHERE n <= 3")
def top_parts(v: Views) -> DataFrame:
    return tessellate.top_parts(areas(v))


@query(f"WITH RECURSIVE {PARTS} SELECT district_id, count(*) AS parts, max(area_m2) AS largest, min(area_m2) AS smallest, sum(area_m2) AS total FROM parts GROUP BY 1")
def island_report(v: Views) -> DataFrame:
    return tessellate.island_report(areas(v))


@query(f"WITH RECURSIVE {RANKED} SELECT district_id, count(*) AS parts, count(*) FILTER (n > 1) AS anomalies FROM ranked GROUP BY 1")
def island_summary(v: Views) -> DataFrame:
    return tessellate.island_summary(tessellate.mark_main_body(areas(v)))


@query(f"""WITH RECURSIVE {PARTS}, m AS (SELECT district_id FROM parts GROUP BY 1 HAVING count(*) > 1), l AS (SELECT district_id, verdict_id FROM (SELECT *, row_number() OVER (PARTITION BY district_id ORDER BY computed_at DESC, verdict_id DESC) AS n FROM f_verdict WHERE condition_code = 'S2') t WHERE n = 1)
 SELECT m.district_id, l.verdict_id, 'S2' AS condition_code, 'medium' AS severity, 'open' AS status, 'geo:multipart:' || m.district_id AS tag FROM m LEFT JOIN l ON l.district_id = m.district_id""")
def multipart_findings(v: Views) -> DataFrame:
    return serve.multipart_findings(areas(v), v("f_verdict"))


@query(f"""WITH RECURSIVE {LAB}, {longest_sql('lab', 'longest')} SELECT * FROM longest""")
def longest_border_neighbour(v: Views) -> DataFrame:
    return tessellate.longest_border_neighbour(labelled(v))


@query(f"""WITH RECURSIVE {RANKED}, {SLIVERS}, {longest_sql('lab', 'longest')}, {absorbed_sql('lab', 'longest', 'slivers', 'absorbed')} SELECT district_id, count(*) AS cells, count(*) * {CELL * CELL}e0 AS area FROM absorbed GROUP BY 1""")
def absorb_slivers(v: Views) -> DataFrame:
    return tessellate.district_cells(tessellate.absorb_slivers(owned(v), CELL), CELL)


def _pass_sql(cells: str, n: int) -> str:
    lab = f"lab{n}"
    empty = f"empty{n} AS (SELECT e.* FROM ev{n} e JOIN (SELECT district_id FROM ({AREAS.format(lab=lab)}) a GROUP BY 1 HAVING count(*) > 1) m ON m.district_id = e.district_id WHERE e.houses = 0)"
    return f"{labelled_sql(cells, lab)}, {evidence_sql(lab, f'ev{n}')}, {empty}, {longest_sql(lab, f'long{n}')}, {absorbed_sql(lab, f'long{n}', f'empty{n}', f'cells{n}')}"


@query(f"""WITH RECURSIVE {PARTS}, {HOUSES}, {evidence_sql('lab', 'ev')}, k AS (SELECT district_id, count(*) AS k, sum(area_m2) AS total_m2 FROM parts GROUP BY 1)
 SELECT p.municipality_id, p.district_id, p.part, p.area_m2, p.area_m2 / k.total_m2 AS share, p.area_m2 > 0.1e0 * 1e6 AS refused FROM parts p JOIN k ON k.district_id = p.district_id AND k.k > 1 JOIN ev ON ev.municipality_id = p.municipality_id AND ev.district_id = p.district_id AND ev.part = p.part AND ev.houses = 0""")
def evidenceless_candidates(v: Views) -> DataFrame:
    found = tessellate.absorb_evidenceless(owned(v), houses(v), CELL, max_km2=0.10, passes=4, dry_run=True)
    return found.select("municipality_id", "district_id", "part", "area_m2", "share", (F.col("area_m2") > 0.10 * 1e6).alias("refused"))


@query(f"""WITH RECURSIVE {OWNED}, {HOUSES}, {_pass_sql('owned', 1)}, {_pass_sql('cells1', 2)} SELECT district_id, count(*) AS cells, count(*) * {CELL * CELL}e0 AS area FROM cells2 GROUP BY 1""")
def absorb_evidenceless(v: Views) -> DataFrame:
    return tessellate.district_cells(tessellate.absorb_evidenceless(owned(v), houses(v), CELL, max_km2=10.0, passes=2), CELL)


SEED_CELLS = f"seed_cells AS (SELECT municipality_id, district_id, CAST(floor(x / {CELL}) AS BIGINT) AS cx, CAST(floor(y / {CELL}) AS BIGINT) AS cy FROM f_seed)"


@query(f"WITH RECURSIVE {LAB}, {SEED_CELLS}, {evidence_sql('lab', 'ev', 'seed_cells')} SELECT * FROM ev")
def part_evidence(v: Views) -> DataFrame:
    return tessellate.part_evidence(labelled(v), v("f_seed"), CELL)


@query(f"""WITH RECURSIVE {RANKED}, {HOUSES}, {evidence_sql('lab', 'ev')}, e AS (SELECT r.municipality_id, r.district_id, r.part, area_m2, ev.houses, max(ev.houses) OVER (PARTITION BY r.district_id) AS most, n FROM ranked r JOIN ev USING (municipality_id, district_id, part))
 SELECT municipality_id, district_id, part, area_m2, houses FROM e WHERE houses > 0 OR (most = 0 AND n = 1)""")
def keep_non_empty(v: Views) -> DataFrame:
    lab = labelled(v)
    return tessellate.keep_non_empty(tessellate.part_evidence(lab, houses(v), CELL), tessellate.part_areas(lab, CELL)).select("municipality_id", "district_id", "part", "area_m2", "houses")


@query(f"""WITH RECURSIVE {PARTS}, h AS (SELECT municipality_id, district_id, 'S' || (l_partkey % 50) AS street, CAST(l_linenumber AS VARCHAR) AS house_number, CAST(floor(x / {CELL}) AS BIGINT) AS cx, CAST(floor(y / {CELL}) AS BIGINT) AS cy FROM f_seed),
 i AS (SELECT l.municipality_id, l.district_id, l.part, array_to_string(list_sort(list_distinct(list(street))), '|') AS streets, array_to_string(list_sort(list_distinct(list(house_number))), '|') AS house_numbers, count(*) AS houses FROM lab l JOIN h USING (municipality_id, district_id, cx, cy) GROUP BY 1, 2, 3)
 SELECT p.municipality_id, p.district_id, p.part, area_m2, coalesce(streets, '') AS streets, coalesce(house_numbers, '') AS house_numbers, coalesce(houses, 0) AS houses FROM parts p LEFT JOIN i ON i.municipality_id = p.municipality_id AND i.district_id = p.district_id AND i.part = p.part""")
def island_stats(v: Views) -> DataFrame:
    h = v("f_seed").select("municipality_id", "district_id", F.concat(F.lit("S"), (F.col("l_partkey") % 50).cast("string")).alias("street"), F.col("l_linenumber").cast("string").alias("house_number"), "x", "y")
    joined = lambda c: F.array_join(c, "|").alias(c)
    return tessellate.island_stats(labelled(v), h, CELL).select("municipality_id", "district_id", "part", "area_m2", joined("streets"), joined("house_numbers"), "houses")


LINKS = f"""body AS (SELECT l.* FROM lab l JOIN ranked r ON r.municipality_id = l.municipality_id AND r.district_id = l.district_id AND r.part = l.part WHERE r.n = 1),
 pairs AS (SELECT l.municipality_id, l.district_id, l.part, l.cx, l.cy, b.cx AS mx, b.cy AS my, row_number() OVER (PARTITION BY l.municipality_id, l.district_id, l.part ORDER BY (l.cx - b.cx) * (l.cx - b.cx) + (l.cy - b.cy) * (l.cy - b.cy), l.cx, l.cy, b.cx, b.cy) AS i
  FROM lab l JOIN ranked r ON r.municipality_id = l.municipality_id AND r.district_id = l.district_id AND r.part = l.part AND r.n > 1 JOIN body b ON b.municipality_id = l.municipality_id AND b.district_id = l.district_id),
 lines AS (SELECT municipality_id, district_id, part, (cx + 0.5e0) * {CELL} AS ax, (cy + 0.5e0) * {CELL} AS ay, (mx + 0.5e0) * {CELL} AS bx, (my + 0.5e0) * {CELL} AS bz FROM pairs WHERE i = 1)"""
# the line clipped by a cell's sides, a hair wider: it runs through the cell if the clips overlap
_SLAB = lambda a, d, lo: f"CASE WHEN {d} = 0 THEN CASE WHEN {a} BETWEEN {lo} - 1e-7 AND {lo} + {CELL} + 1e-7 THEN [0e0, 1e0] ELSE [2e0, -1e0] END ELSE [least(({lo} - 1e-7 - {a}) / {d}, ({lo} + {CELL} + 1e-7 - {a}) / {d}), greatest(({lo} - 1e-7 - {a}) / {d}, ({lo} + {CELL} + 1e-7 - {a}) / {d})] END"
CORRIDORS = f"""grid AS (SELECT l.municipality_id, l.district_id, l.part, ax, ay, bx - ax AS dx, bz - ay AS dy, cx, unnest(range(CAST(floor(least(ay, bz) / {CELL}) AS BIGINT) - 1, CAST(floor(greatest(ay, bz) / {CELL}) AS BIGINT) + 2)) AS cy
  FROM (SELECT *, unnest(range(CAST(floor(least(ax, bx) / {CELL}) AS BIGINT) - 1, CAST(floor(greatest(ax, bx) / {CELL}) AS BIGINT) + 2)) AS cx FROM lines) l),
 clip AS (SELECT *, {_SLAB('ax', 'dx', f'cx * {CELL}')} AS tx, {_SLAB('ay', 'dy', f'cy * {CELL}')} AS ty, greatest(0, least(1, (((cx + 0.5) * {CELL} - ax) * dx + ((cy + 0.5) * {CELL} - ay) * dy) / (dx * dx + dy * dy))) AS t FROM grid),
 corridors AS (SELECT municipality_id, district_id, part, cx, cy FROM clip WHERE greatest(tx[1], ty[1], 0) <= least(tx[2], ty[2], 1)
  OR sqrt(pow((cx + 0.5) * {CELL} - ax - t * dx, 2) + pow((cy + 0.5) * {CELL} - ay - t * dy, 2)) <= 30)"""
SHOTS = """shots AS (SELECT l.municipality_id, l.district_id, l.part, h.district_id AS other, h.x - ax AS px, h.y - ay AS py, bx - ax AS dx, bz - ay AS dy FROM lines l JOIN (SELECT DISTINCT district_id, x, y FROM f_seed) h
  ON h.district_id <> l.district_id AND h.x BETWEEN least(ax, bx) - 50 AND greatest(ax, bx) + 50 AND h.y BETWEEN least(ay, bz) - 50 AND greatest(ay, bz) + 50),
 blocked AS (SELECT municipality_id, district_id, part, CAST(count(DISTINCT other) AS INT) AS blockers FROM (SELECT *, greatest(0, least(1, (px * dx + py * dy) / (dx * dx + dy * dy))) AS t FROM shots) s WHERE sqrt(pow(px - t * dx, 2) + pow(py - t * dy, 2)) <= 50 GROUP BY 1, 2, 3)"""


@query(f"WITH RECURSIVE {RANKED}, {LINKS} SELECT municipality_id, district_id, part, ax, ay, bx, bz FROM lines")
def island_links(v: Views) -> DataFrame:
    return tessellate.island_links(labelled(v), CELL).select("municipality_id", "district_id", "part", "ax", "ay", "bx", F.col("by").alias("bz"))


@query(f"""WITH RECURSIVE {RANKED}, {SEED_CELLS}, {evidence_sql('lab', 'ev', 'seed_cells')}, {LINKS}, {SHOTS}, {CORRIDORS},
 taken AS (SELECT c.municipality_id, c.district_id, c.part, string_agg(DISTINCT CAST(l.district_id AS VARCHAR), ',' ORDER BY CAST(l.district_id AS VARCHAR)) AS conflicts FROM corridors c JOIN lab l ON l.municipality_id = c.municipality_id AND l.cx = c.cx AND l.cy = c.cy AND l.district_id <> c.district_id GROUP BY 1, 2, 3)
 SELECT r.municipality_id, r.district_id, r.part, area_m2, ev.houses, b.blockers, t.conflicts, CASE WHEN r.n = 1 THEN 'main_body' WHEN ev.houses > 0 AND blockers IS NULL AND conflicts IS NULL THEN 'connected_to_main' ELSE 'unresolved_anomaly' END AS status
 FROM ranked r JOIN ev USING (municipality_id, district_id, part) LEFT JOIN blocked b ON b.municipality_id = r.municipality_id AND b.district_id = r.district_id AND b.part = r.part
 LEFT JOIN taken t ON t.municipality_id = r.municipality_id AND t.district_id = r.district_id AND t.part = r.part""")
def connect_islands(v: Views) -> DataFrame:
    out = tessellate.connect_islands(labelled(v), v("f_seed").select("municipality_id", "district_id", "x", "y"), CELL)
    conflicts = F.array_join(F.array_sort(F.transform("conflicts", lambda x: x.cast("string"))), ",").alias("conflicts")
    return out.select("municipality_id", "district_id", "part", "area_m2", "houses", F.when(F.col("blockers").isNotNull(), F.size("blockers")).alias("blockers"), conflicts, "status")


# --- hulls


# corners in turn: from the lowest point always the next by the angle, the furthest of equals
@query("""WITH RECURSIVE p AS (SELECT DISTINCT district_id, x, y FROM f_seed), n AS (SELECT district_id, count(*) AS n FROM f_seed GROUP BY 1),
 first AS (SELECT district_id, x, y FROM (SELECT *, row_number() OVER (PARTITION BY district_id ORDER BY y, x) AS i FROM p) t WHERE i = 1),
 walk(district_id, k, x, y, angle) AS (SELECT district_id, 0, x, y, 0e0 FROM first UNION ALL
  SELECT district_id, k + 1, nx, ny, a FROM (SELECT w.district_id, w.k, p.x AS nx, p.y AS ny, w.angle, (atan2(p.y - w.y, p.x - w.x) + 2 * pi()) % (2 * pi()) AS a,
   row_number() OVER (PARTITION BY w.district_id ORDER BY CASE WHEN (atan2(p.y - w.y, p.x - w.x) + 2 * pi()) % (2 * pi()) >= w.angle - 1e-9 THEN 0 ELSE 1 END, round((atan2(p.y - w.y, p.x - w.x) + 2 * pi()) % (2 * pi()), 11), pow(p.x - w.x, 2) + pow(p.y - w.y, 2) DESC) AS i
   FROM walk w JOIN p ON p.district_id = w.district_id AND (p.x <> w.x OR p.y <> w.y) JOIN first f ON f.district_id = w.district_id WHERE w.k = 0 OR w.x <> f.x OR w.y <> f.y) t WHERE i = 1),
 corners AS (SELECT *, lead(x) OVER (PARTITION BY district_id ORDER BY k) AS x2, lead(y) OVER (PARTITION BY district_id ORDER BY k) AS y2 FROM walk)
 SELECT c.district_id, any_value(n.n) AS n, CAST(count(*) - 1 AS INT) AS corners, sum(CASE WHEN x2 IS NULL THEN 0 ELSE x * y2 - x2 * y END) / 2 AS area FROM corners c JOIN n ON n.district_id = c.district_id GROUP BY 1 HAVING any_value(n.n) >= 3""")
def hulls(v: Views) -> DataFrame:
    return spatial.hulls(v("f_seed"), "district_id").select("district_id", "n", F.size("hull").alias("corners"), "area")


@query("SELECT district_id, count(*) FILTER (l_linenumber <= 2) AS street_points, count(*) FILTER (l_linenumber > 2) AS house_points, count(*) AS points FROM f_seed GROUP BY 1 HAVING count(*) >= 3")
def hull_point_counts(v: Views) -> DataFrame:
    return spatial.hull_point_counts(v("f_seed").withColumn("source", F.when(F.col("l_linenumber") <= 2, "street").otherwise("house")))


# the ring's corners follow from a triangulation, which SQL is no means for; that each holds all points of its group is what SQL tells
@query("""WITH p AS (SELECT district_id, count(*) AS n, count(DISTINCT x) AS nx, count(DISTINCT y) AS ny FROM f_seed GROUP BY 1) SELECT district_id, n, n AS held, true AS closed, true AS not_above_convex FROM p WHERE n >= 3 AND nx > 1 AND ny > 1""")
def concave_hulls(v: Views) -> DataFrame:
    points = v("f_seed").select("district_id", "x", "y")
    rings = stored(hull.concave_hulls(points, "district_id", ratio=0.3))
    outlines = rings.select("district_id", F.array(F.struct(F.lit(False).alias("hole"), F.col("ring").alias("pts"))).alias("rings"))
    held = outline.points_in_outlines(points, outlines, "district_id", CELL, boundary=True, same="district_id").groupBy("district_id").agg(F.count("*").alias("held"))
    convex = spatial.hulls(points, "district_id").select("district_id", F.col("area").alias("convex"))
    closed = (F.element_at("ring", 1) == F.element_at("ring", -1)) & (F.size("ring") >= 4)
    return rings.join(held, "district_id").join(convex, "district_id").select("district_id", "n", "held", closed.alias("closed"), (F.col("area") <= F.col("convex") * (1 + 1e-9)).alias("not_above_convex"))
