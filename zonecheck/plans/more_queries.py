"""Registered queries over work lists, map views, outlines and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import assign, clean, serve, spatial, tessellate
from .queries import CLEAN, COMPOSED, STREETS, composed, neat, query, streets
from .spatial_queries import CELL, FAILURES, OWNED, PAIRS, addresses, districts
from .views import Views


@query("""WITH s AS (SELECT DISTINCT street FROM f_street), n AS (SELECT DISTINCT p_name AS name FROM part),
 e AS (SELECT street, min(name) AS name, 'exact' AS how FROM s JOIN n ON lower(street) = lower(name) GROUP BY 1), r AS (SELECT street FROM s WHERE street NOT IN (SELECT street FROM e)),
 c AS (SELECT street, min(name) AS name, 'contained' AS how FROM r JOIN n ON contains(lower(street), lower(name)) OR contains(lower(name), lower(street)) GROUP BY 1)
 SELECT * FROM e UNION ALL SELECT * FROM c UNION ALL SELECT street, NULL, 'none' FROM r WHERE street NOT IN (SELECT street FROM c)""")
def containment_match(v: Views) -> DataFrame:
    return assign.containment_match(v("f_street"), v("part").select(F.col("p_name").alias("name")))


@query("SELECT DISTINCT district_id, trim(street) AS street FROM f_street_range r WHERE trim(street) <> '' AND NOT EXISTS (SELECT 1 FROM f_house_geocode g WHERE g.status = 'OK' AND g.district_id = r.district_id AND g.street = trim(r.street))")
def street_worklist(v: Views) -> DataFrame:
    listed = v("f_street_range").groupBy("district_id").agg(F.collect_set("street").alias("streets"))
    return assign.street_worklist(listed, v("f_house_geocode").filter("status = 'OK'").select("district_id", "street"))


@query(f"""WITH {CLEAN}, {STREETS}, an AS (SELECT register_id, municipality_id, ulica_norm FROM (SELECT *, row_number() OVER (PARTITION BY municipality_id, ulica_norm
 ORDER BY CAST(nullif(regexp_replace(orientacne_cislo, '\\D', '', 'g'), '') AS INT) ASC NULLS LAST, orientacne_cislo ASC NULLS LAST, register_id) AS n FROM clean) t WHERE n = 1),
 b AS (SELECT municipality_id, street_norm FROM streets GROUP BY 1, 2 HAVING count(DISTINCT district_id) > 1),
 w AS (SELECT 'a' || (register_id // 2) AS adresa, register_id, 1 AS tier FROM an UNION ALL SELECT 'a' || (c.register_id // 2), c.register_id, 2 FROM clean c WHERE EXISTS (SELECT 1 FROM b WHERE b.municipality_id = c.municipality_id AND b.street_norm = c.ulica_norm) AND c.register_id NOT IN (SELECT register_id FROM an)),
 f AS (SELECT adresa, min(tier) AS tier, arg_min(register_id, tier * 1000000000 + register_id) AS register_id FROM w GROUP BY 1)
 SELECT * FROM f WHERE adresa NOT IN (SELECT 'a' || (register_id // 2) FROM f_register WHERE obyvatelna = false) ORDER BY tier, adresa LIMIT 2000""")
def register_worklist(v: Views) -> DataFrame:
    named = neat(v).withColumn("adresa", F.concat(F.lit("a"), F.floor(F.col("register_id") / 2).cast("string")))
    cache = v("f_register").filter("obyvatelna = false").select(F.concat(F.lit("a"), F.floor(F.col("register_id") / 2).cast("string")).alias("adresa"))
    return assign.register_worklist(named, clean.street_anchors(named), assign.border_streets(streets(v)), cache)


@query(f"WITH {COMPOSED} SELECT d.district_id, d.name, d.municipality_id, d.school_id, coalesce(c.composition_color, 'NONE') AS composition_color, s.x AS school_x FROM f_district d LEFT JOIN composed c ON c.district_id = d.district_id LEFT JOIN f_school s ON s.school_id = d.school_id")
def map_features(v: Views) -> DataFrame:
    out = serve.map_features(districts(v), v("f_school"), composed(v))
    return out.select("district_id", "name", "municipality_id", "school_id", "composition_color", F.col("school_point.x").alias("school_x"))


@query("SELECT district_id, CAST(count(*) AS BIGINT) AS house_count, CAST(count(DISTINCT street) AS BIGINT) AS street_count FROM f_house_geocode GROUP BY 1")
def islands_view(v: Views) -> DataFrame:
    islands = v("f_house_geocode").groupBy("district_id").agg(F.collect_set("street").alias("streets"), F.collect_list("house_number").alias("house_numbers")).withColumns({"street_count": F.lit(None).cast("long"), "house_count": F.lit(None).cast("long")})
    return serve.islands_view(islands).select("district_id", "street_count", "house_count")


@query("""WITH b AS (SELECT municipality_id, (max(x1) - min(x0)) * (max(y1) - min(y0)) AS boundary_area FROM f_district GROUP BY 1), a AS (SELECT municipality_id, count(*) AS districts, sum((x1 - x0) * (y1 - y0)) AS area FROM f_district GROUP BY 1)
 SELECT a.municipality_id, districts, area, boundary_area, abs(area - boundary_area) <= 0.02 * boundary_area AS within FROM a JOIN b ON b.municipality_id = a.municipality_id""")
def area_totals(v: Views) -> DataFrame:
    bounds = v("f_district").groupBy("municipality_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return spatial.area_totals(districts(v), spatial.box_polygons(bounds), drift=0.02)


@query(f"""WITH {OWNED}, h AS (SELECT c.municipality_id, c.cx, c.cy, count(d.district_id) AS n FROM cells c LEFT JOIN f_district d ON d.municipality_id = c.municipality_id AND c.x >= d.x0 AND c.x <= d.x1 AND c.y >= d.y0 AND c.y <= d.y1 GROUP BY 1, 2, 3)
 SELECT municipality_id, count(*) AS cells, count(*) FILTER (n = 0) AS uncovered, count(*) FILTER (n = 0) * {CELL * CELL}e0 AS gap_m2, count(*) FILTER (n = 0) / count(*) AS gap_share FROM h GROUP BY 1""")
def coverage_gap_area(v: Views) -> DataFrame:
    bounds = v("f_district").groupBy("municipality_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return spatial.coverage_gap_area(tessellate.raster(bounds, CELL), districts(v), CELL)


# the municipality's outline against the corners of all its districts, all pairs of corners
@query("""WITH a AS (SELECT DISTINCT municipality_id, x, y FROM f_outline), b AS (SELECT municipality_id, x0 AS x, y0 AS y FROM f_district UNION SELECT municipality_id, x1, y0 FROM f_district UNION SELECT municipality_id, x1, y1 FROM f_district UNION SELECT municipality_id, x0, y1 FROM f_district),
 d AS (SELECT a.municipality_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bz, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM a JOIN b ON b.municipality_id = a.municipality_id),
 m AS (SELECT municipality_id, min(d) AS d FROM d GROUP BY municipality_id, ax, ay UNION ALL SELECT municipality_id, min(d) FROM d GROUP BY municipality_id, bx, bz) SELECT municipality_id, round(max(d), 6) AS distance FROM m GROUP BY 1""")
def hausdorff(v: Views) -> DataFrame:
    from .outline_queries import outlines

    boxes = districts(v).select("municipality_id", F.explode("rings").alias("r")).groupBy("municipality_id").agg(F.collect_list("r").alias("rings"))
    return spatial.hausdorff(outlines(v), boxes, "municipality_id").withColumn("distance", F.round("distance", 6))


PLACED = """placed AS (SELECT d.district_id, d.school_id, sqrt(pow(greatest(0, d.x0 - s.x, s.x - d.x1), 2) + pow(greatest(0, d.y0 - s.y, s.y - d.y1), 2)) AS distance FROM f_district d JOIN f_school s ON s.school_id = d.school_id)"""


@query(f"WITH {PLACED} SELECT district_id, school_id, round(distance, 6) AS distance, CASE WHEN distance = 0 THEN 'inside' WHEN distance <= 50 THEN 'near' ELSE 'far' END AS place FROM placed")
def school_distances(v: Views) -> DataFrame:
    return spatial.school_distances(v("f_school"), districts(v)).withColumn("distance", F.round("distance", 6))


# outlines with each fault: crossing itself, unclosed, too short, without points; the rest are fine
@query("SELECT district_id, CASE WHEN district_id % 6 IN (1, 2, 3, 4) THEN false ELSE true END AS valid, CASE district_id % 6 WHEN 1 THEN 'self-intersection' WHEN 2 THEN 'unclosed' WHEN 3 THEN 'fewer than 4 points' WHEN 4 THEN 'empty' END AS reason FROM f_district")
def validity(v: Views) -> DataFrame:
    p = [F.col("rings")[0]["pts"][i] for i in range(5)]
    k = F.col("district_id") % 6
    ring = F.when(k == 1, F.array(p[0], p[2], p[1], p[3], p[0])).when(k == 2, F.array(*p[:4])).when(k == 3, F.array(p[0], p[1], p[0])).when(k == 4, F.array_except(F.array(p[0]), F.array(p[0]))).otherwise(F.array(*p))
    return spatial.validity(districts(v).select("district_id", F.array(F.struct(F.lit(False).alias("hole"), ring.alias("pts"))).alias("rings")), "district_id")


# outlines with a point every 60 m and, on the lower side, one that stands off by 0 to 3 m: from more than 1 m on it stays
@query("SELECT district_id, CAST(CASE WHEN district_id % 4 > 1 THEN 6 ELSE 5 END AS BIGINT) AS points, (x1 - x0) * (y1 - y0) + CASE WHEN district_id % 4 > 1 THEN (district_id % 4) * (x1 - x0) / 2 ELSE 0 END AS area FROM f_district")
def simplify(v: Views) -> DataFrame:
    from ..functions import geo as G

    p = [F.col("rings")[0]["pts"][i] for i in range(5)]
    off = F.struct(((F.col("x0") + F.col("x1")) / 2).alias("x"), (F.col("y0") - F.col("district_id") % 4).alias("y"))
    ring = G.segmentize(F.array(p[0], off, *p[1:]), 60.0)
    dense = districts(v).select("district_id", F.array(F.struct(F.lit(False).alias("hole"), ring.alias("pts"))).alias("rings"))
    thin = spatial.simplify(dense, 1.0)
    return thin.select("district_id", F.size(F.col("rings")[0]["pts"]).cast("long").alias("points"), G.area_m2(F.col("rings")).alias("area"))


@query(f"""WITH {FAILURES}, {PAIRS}, {PLACED}, s AS (SELECT d.district_id, count(a.school_id) AS n FROM f_district d LEFT JOIN f_school a ON a.is_public AND a.type = d.school_type AND a.x >= d.x0 AND a.x <= d.x1 AND a.y >= d.y0 AND a.y <= d.y1 GROUP BY 1)
 SELECT 'T1 validity' AS "check", CAST(0 AS BIGINT) AS failures UNION ALL SELECT 'T2 coverage', count(*) FROM fails UNION ALL SELECT 'T3 overlaps', count(*) FROM pairs UNION ALL SELECT 'T4 school inside', count(*) FROM s WHERE n = 0 UNION ALL SELECT 'T5 school near', count(*) FROM placed WHERE distance > 0 AND distance <= 50 UNION ALL SELECT 'T6 school far', count(*) FROM placed WHERE distance > 50""")
def topology_report(v: Views) -> DataFrame:
    return spatial.topology_report(districts(v), addresses(v), v("f_school"))
