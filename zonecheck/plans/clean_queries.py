"""Registered queries over cleaning operators, small column functions and display filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import geo as G, text as T
from ..operators import clean, rules, serve, spatial
from ..sources.shared import stored
from .queries import LATEST, query
from .spatial_queries import CONSISTENT, HITS, PAIRS, SHARED, addresses, consistency, districts
from .views import Views

KIND_TEXT = "CASE s_suppkey % 5 WHEN 0 THEN 'Základná škola Horná' WHEN 1 THEN 'Materská škola Dolná' WHEN 2 THEN 'Základná umelecká škola' WHEN 3 THEN 'Špeciálna základná škola' ELSE 'Gymnázium' END"
FOUNDED = "CASE s_suppkey % 3 WHEN 0 THEN 'Súkromná' WHEN 1 THEN 'Cirkevná' ELSE '' END"
TYPE = "CASE WHEN contains(lower(t), 'základná škola') THEN 'ZS' WHEN contains(lower(t), 'materská škola') THEN 'MS' WHEN contains(lower(t), 'základná umelecká') THEN 'ZUS' ELSE 'OTHER' END"


def _features(v: Views) -> DataFrame:
    """Schools as an atlas describes them, one per supplier."""
    return v.sql(f"SELECT s_suppkey AS school_id, CAST(CAST(floor(s_suppkey / 20) AS BIGINT) AS STRING) AS code, {KIND_TEXT} AS type_text, {FOUNDED} AS founder, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'slovenský' ELSE 'hu' END AS language FROM supplier")


def _codes(v: Views) -> DataFrame:
    """Known municipalities by code: three of four."""
    return v("f_municipality").filter("municipality_id % 4 <> 3").select(F.col("municipality_id").cast("string").alias("code"), "municipality_id")


@query(f"SELECT s_suppkey AS school_id, {TYPE.replace('lower(t)', 'lower(' + KIND_TEXT + ')')} AS type FROM supplier")
def school_type(v: Views) -> DataFrame:
    return _features(v).select("school_id", clean.school_type("type_text").alias("type"))


@query("SELECT s_suppkey AS school_id, s_suppkey % 3 = 2 AS public FROM supplier")
def is_public(v: Views) -> DataFrame:
    return _features(v).select("school_id", clean.is_public("founder").alias("public"))


@query(f"""WITH f AS (SELECT s_suppkey AS school_id, CAST(floor(s_suppkey / 20) AS BIGINT) AS municipality_id, {KIND_TEXT} AS t, CASE s_suppkey % 4 WHEN 0 THEN 'SK' WHEN 1 THEN 'SLOVE' ELSE 'HU' END AS teaching_language FROM supplier)
 SELECT school_id, municipality_id, {TYPE} AS type, teaching_language FROM f WHERE {TYPE} <> 'OTHER' AND municipality_id % 4 <> 3""")
def load_schools(v: Views) -> DataFrame:
    return clean.load_schools(_features(v), _codes(v)).select("school_id", "municipality_id", "type", "teaching_language")


@query("""WITH p AS (SELECT municipality_id, CASE WHEN municipality_id % 7 = 6 THEN NULL ELSE count(*) % 900 END AS population FROM f_address GROUP BY 1)
 SELECT CAST(municipality_id AS VARCHAR) AS code, population, CASE WHEN population > 500 THEN 'large' WHEN population > 100 THEN 'medium' WHEN population > 0 THEN 'small' ELSE 'unknown' END AS category,
 CASE WHEN municipality_id % 4 <> 3 AND municipality_id IN (SELECT municipality_id FROM f_municipality) THEN municipality_id END AS municipality_id FROM p""")
def community_category(v: Views) -> DataFrame:
    per = v("f_address").groupBy("municipality_id").agg(F.count("*").alias("n"))
    per = per.select(F.col("municipality_id").cast("string").alias("code"), F.when(F.col("municipality_id") % 7 != 6, F.col("n") % 900).alias("population"))
    return clean.community_category(per, _codes(v)).select("code", "population", "category", "municipality_id")


@query("""SELECT lpad(CAST(municipality_id AS VARCHAR), 6, '0') AS code, municipality_id, CASE WHEN municipality_id % 3 <> 0 THEN 10 * municipality_id ELSE 7 + municipality_id END AS children,
 CASE WHEN municipality_id % 2 = 0 THEN 2022 WHEN municipality_id % 3 <> 1 THEN 2021 ELSE 2020 END AS year FROM f_municipality""")
def children_latest(v: Views) -> DataFrame:
    m, code = F.col("municipality_id"), F.lpad(F.col("municipality_id").cast("string"), 6, "0")
    counts = v("f_municipality").select(F.concat(F.lit("SK03"), code).alias("nuts"), F.when(m % 3 != 0, 10 * m).otherwise(F.lit(0)).alias("last"), (7 + m).alias("y2020"), F.when(m % 3 != 1, m).alias("y2021"), F.when(m % 2 == 0, m).alias("y2022"))
    return clean.children_latest(counts, v("f_municipality").select(code.alias("code"), "municipality_id"))


WAYS = "ways AS (SELECT a.address_id AS id, CASE WHEN a.address_id % 9 <> 0 THEN s.street END AS name, CASE a.address_id % 4 WHEN 0 THEN 'residential' WHEN 1 THEN 'footway' WHEN 2 THEN 'primary' END AS highway, a.x, a.y FROM (SELECT f_address.*, address_id % np AS street_id FROM f_address CROSS JOIN (SELECT count(*) AS np FROM part) c) a JOIN f_street s ON s.street_id = a.street_id)"
BOX = (2000.0, 1000.0, 7000.0, 6000.0)
MEETS = "x + 50 >= 2000 AND x <= 7000 AND y + 20 >= 1000 AND y <= 6000"


def _ways(v: Views) -> DataFrame:
    """Ways of two points with tags, one per address."""
    w = v.sql(f"WITH {WAYS} SELECT * FROM ways")
    point = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    tags = F.map_filter(F.create_map(F.lit("name"), F.col("name"), F.lit("highway"), F.col("highway"), F.lit("addr:street"), F.col("name"), F.lit("addr:housenumber"), (F.col("id") % 60).cast("string"), F.lit("building"), F.when(F.col("id") % 5 < 2, "yes")), lambda _, x: x.isNotNull())
    return w.select("id", tags.alias("tags"), F.array(point(0, 0), point(50, 20)).alias("pts"))


@query(f"WITH {WAYS} SELECT lower(name) AS name_key, array_to_string(list_sort(list(id)), ',') AS ways FROM ways WHERE name IS NOT NULL AND highway IN ('residential', 'primary') AND {MEETS} GROUP BY 1")
def named_streets(v: Views) -> DataFrame:
    return clean.named_streets(_ways(v), BOX).select("name_key", F.array_join(F.transform("ways", lambda x: x.cast("string")), ",").alias("ways"))


@query(f"WITH {WAYS} SELECT id, name AS street, CAST(id % 60 AS VARCHAR) AS house_number, x + 25 AS x, y + 10 AS y FROM ways WHERE name IS NOT NULL AND id % 5 < 2 AND {MEETS}")
def address_buildings(v: Views) -> DataFrame:
    return clean.address_buildings(_ways(v), BOX)


@query("""WITH t AS (SELECT CAST(municipality_id + 1000 AS VARCHAR) AS code, 'Mesto ' || municipality_id AS name FROM f_municipality WHERE municipality_id % 3 = 1),
 p AS (SELECT address_id, CAST(municipality_id + 999 AS VARCHAR) AS c, 'MESTO ' || municipality_id AS n FROM f_address) SELECT address_id FROM p WHERE EXISTS (SELECT 1 FROM t WHERE t.code = p.c OR contains(lower(p.n), lower(t.name)))""")
def scope_filter(v: Views) -> DataFrame:
    m = F.col("municipality_id")
    targets = v("f_municipality").filter("municipality_id % 3 = 1").select((m + 1000).cast("string").alias("code"), F.concat(F.lit("Mesto "), m.cast("string")).alias("name"))
    points = v("f_address").select("address_id", (m + 999).cast("string").alias("municipality_code"), F.concat(F.lit("MESTO "), m.cast("string")).alias("municipality_name"))
    return clean.scope_filter(points, targets).select("address_id")


@query("""SELECT district_id AS road_id, school_type AS class, unnest([0, 2]) AS line_no, unnest([2, 3]) AS points, unnest([x0, x1]) AS first_x FROM f_district""")
def road_segments(v: Views) -> DataFrame:
    p = lambda x, y: F.array(x, y, F.lit(0.0))
    lines = F.array(F.array(p("x0", "y0"), p("x1", "y0")), F.array(p("x0", "y0")), F.array(p("x1", "y1"), p("x0", "y1"), p("x0", "y0")))
    roads = v("f_district").select(F.col("district_id").alias("road_id"), F.col("school_type").alias("class"), lines.alias("lines"))
    return clean.road_segments(roads).select("road_id", "class", "line_no", F.size("line").alias("points"), F.col("line")[0]["x"].alias("first_x"))


@query("SELECT school_id AS stop_id, CASE type WHEN 'ZS' THEN 'bus' ELSE 'rail' END AS kind, CASE type WHEN 'ZS' THEN x END AS x FROM f_school")
def transit_stops(v: Views) -> DataFrame:
    s = v("f_school")
    return clean.transit_stops(s.filter("type = 'ZS'").select(F.col("school_id").alias("stop_id"), "x"), s.filter("type = 'MS'").select(F.col("school_id").alias("stop_id"))).select("stop_id", "kind", "x")


@query("SELECT district_id, g AS geometry_type FROM (SELECT district_id, CASE district_id % 5 WHEN 0 THEN 'Point' WHEN 1 THEN NULL WHEN 2 THEN 'MultiPolygon' ELSE 'Polygon' END AS g FROM f_district) t WHERE g IS NULL OR g = 'Point'")
def validate_geom_type(v: Views) -> DataFrame:
    kind = F.when(F.col("district_id") % 5 == 0, "Point").when(F.col("district_id") % 5 == 2, "MultiPolygon").when(F.col("district_id") % 5 > 2, "Polygon")
    return clean.validate_geom_type(v("f_district").select("district_id", kind.alias("geometry_type")), "district_id")


GRID = """g AS (SELECT *, -(gy - 1250000) AS south, -(gx - 520000) AS west FROM (SELECT address_id, x AS gx, y AS gy FROM f_address WHERE address_id % 3 = 2) q),
 e AS (SELECT sqrt(6.67437223180214e-3) AS e, radians(49.5e0) AS fc, radians(30 + 17 / 60e0 + 17.30311e0 / 3600) AS ax, radians(78.5e0) AS fp),
 k AS (SELECT *, sqrt(1 + e * e * pow(cos(fc), 4) / (1 - e * e)) AS b, 6377397.155e0 * sqrt(1 - e * e) / (1 - e * e * pow(sin(fc), 2)) AS a FROM e),
 k2 AS (SELECT *, tan(pi() / 4 + asin(sin(fc) / b) / 2) * pow((1 + e * sin(fc)) / (1 - e * sin(fc)), e * b / 2) / pow(tan(pi() / 4 + fc / 2), b) AS t0, 0.9999e0 * a / tan(fp) AS r0 FROM k),
 s1 AS (SELECT g.address_id, k2.*, atan2(west, south) / sin(fp) AS d, 2 * (atan(pow(r0 / sqrt(south * south + west * west), 1 / sin(fp)) * tan(pi() / 4 + fp / 2)) - pi() / 4) AS t FROM g, k2),
 s2 AS (SELECT *, asin(cos(ax) * sin(t) - sin(ax) * cos(t) * cos(d)) AS u FROM s1),
 p0 AS (SELECT *, u AS p, 24 + 50 / 60e0 - degrees(asin(cos(t) * sin(d) / cos(u)) / b) AS lon FROM s2),
 """ + ",\n ".join(f"p{i + 1} AS (SELECT * REPLACE (2 * (atan(pow(t0, -1 / b) * pow(tan(u / 2 + pi() / 4), 1 / b) * pow((1 + e * sin(p)) / (1 - e * sin(p)), e / 2)) - pi() / 4) AS p) FROM p{i})" for i in range(8)) + """,
 xyz AS (SELECT address_id, n * cos(p) * cos(radians(lon)) AS x, n * cos(p) * sin(radians(lon)) AS y, n * (1 - e * e) * sin(p) AS z FROM (SELECT *, 6377397.155e0 / sqrt(1 - e * e * pow(sin(p), 2)) AS n FROM p8) q),
 turned AS (SELECT address_id, x - radians(4.102655e0 / 3600) * y + radians(4.397554e0 / 3600) * z + 485.021e0 AS x, radians(4.102655e0 / 3600) * x + y - radians(7.786342e0 / 3600) * z + 169.465e0 AS y, -radians(4.397554e0 / 3600) * x + radians(7.786342e0 / 3600) * y + z + 483.839e0 AS z FROM xyz),
 w0 AS (SELECT *, 6.694379990141316e-3 AS f2, atan2(z, sqrt(x * x + y * y)) AS q FROM turned),
 """ + ",\n ".join(f"w{i + 1} AS (SELECT * REPLACE (atan2(z + f2 * 6378137e0 / sqrt(1 - f2 * pow(sin(q), 2)) * sin(q), sqrt(x * x + y * y)) AS q) FROM w{i})" for i in range(6)) + """,
 grid AS (SELECT address_id, degrees(atan2(y, x)) AS lon, degrees(q) AS lat FROM w6)"""


# points in degrees, in Mercator and in the national grid; the last by another way back to degrees, of more passes
@query(f"""WITH {GRID} SELECT f.address_id, CASE f.address_id % 3 WHEN 0 THEN '4326' WHEN 1 THEN '3857' ELSE '5514' END AS crs,
 round(CASE f.address_id % 3 WHEN 0 THEN x / 1000 WHEN 1 THEN degrees((x + 2300000) / 6378137.0) ELSE grid.lon END, 7) AS x, round(CASE f.address_id % 3 WHEN 0 THEN 40 + y / 10000 WHEN 1 THEN degrees(2 * atan(exp((y + 6200000) / 6378137.0)) - pi() / 2) ELSE grid.lat END, 7) AS y FROM f_address f LEFT JOIN grid ON grid.address_id = f.address_id""")
def normalise_crs(v: Views) -> DataFrame:
    k = F.col("address_id") % 3
    x = F.when(k == 0, F.col("x") / 1000).when(k == 1, F.col("x") + 2300000).otherwise(F.col("x") - 520000)
    y = F.when(k == 0, 40 + F.col("y") / 10000).when(k == 1, F.col("y") + 6200000).otherwise(F.col("y") - 1250000)
    out = clean.normalise_crs(v("f_address").select("address_id", F.array(F.struct(x.alias("x"), y.alias("y"))).alias("pts")))
    return out.select("address_id", "crs", F.round(F.col("pts")[0]["x"], 7).alias("x"), F.round(F.col("pts")[0]["y"], 7).alias("y"))


# --- display filters and bases


@query("SELECT l_orderkey, l_linenumber, street, house_number FROM f_house_geocode WHERE (status = 'OK' OR partial_match) AND l_partkey % 7 <> 0")
def house_dots(v: Views) -> DataFrame:
    # found valid, found invalid and not looked at; one of seven parts has no coordinates
    valid = F.when(F.col("status") != "OK", F.when(F.col("partial_match"), F.lit(None)).otherwise(False)).otherwise(True)
    lon = F.when(F.col("l_partkey") % 7 != 0, F.col("l_partkey") / 100)
    return clean.house_dots(v("f_house_geocode").withColumns({"valid": valid, "lon": lon, "lat": lon})).select("l_orderkey", "l_linenumber", "street", "house_number")


@query("SELECT school_id, type, x, CASE WHEN school_id % 4 < 3 THEN n_name END AS founder_name, CASE WHEN school_id % 4 < 3 THEN 'region ' || n_regionkey END AS founder_type FROM f_school LEFT JOIN nation ON n_nationkey = school_id % 25 WHERE school_id % 6 <> 0")
def school_markers(v: Views) -> DataFrame:
    founders = v("nation").select(F.col("n_nationkey").alias("founder_id"), F.col("n_name").alias("name"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("type"))
    id_ = F.col("school_id")
    schools = v("f_school").withColumn("x", F.when(id_ % 6 != 0, F.col("x"))).withColumn("founder_id", F.when(id_ % 4 < 3, id_ % 25))
    return clean.school_markers(schools, founders).select("school_id", "type", "x", "founder_name", "founder_type")


@query("""SELECT finding_id, severity, is_demo, row_number() OVER (ORDER BY is_demo DESC, CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 ELSE 3 END DESC, finding_id) AS place
FROM f_finding f JOIN f_district d ON d.district_id = f.district_id WHERE severity IN ('critical', 'high', 'medium')""")
def findings_panel_order(v: Views) -> DataFrame:
    public = serve.findings_public(v("f_finding"), v("f_verdict"), v("f_district"), v("f_municipality"))
    return serve.findings_panel_places(public.select("finding_id", "severity", "severity_rank", "is_demo")).select("finding_id", "severity", "is_demo", "place")


@query("SELECT d.district_id, d.name, d.municipality_id, s.type AS own_school_type, s.is_public AS own_school_public, s.x AS school_x FROM f_district d LEFT JOIN f_school s ON s.school_id = d.school_id")
def district_base(v: Views) -> DataFrame:
    return serve.district_base(v("f_district"), v("f_school")).select("district_id", "name", "municipality_id", "own_school_type", "own_school_public", "school_x")


@query(f"WITH {LATEST} SELECT l.district_id, l.condition_code, l.value, m.demo_value FROM latest l LEFT JOIN (SELECT district_id, condition_code, 'demo ' || value AS demo_value FROM latest WHERE is_illustrative) m ON m.district_id = l.district_id AND m.condition_code = l.condition_code")
def with_demo_values(v: Views) -> DataFrame:
    # without the evidence, whose texts would go through the shuffle; read twice: written once
    latest = stored(serve.latest_verdicts(v("f_verdict").select("verdict_id", "district_id", "condition_code", "computed_at", "value", "is_illustrative")))
    mock = latest.filter("is_illustrative").select("district_id", "condition_code", F.concat(F.lit("demo "), "value").alias("demo_value"))
    return serve.with_demo_values(latest.select("district_id", "condition_code", "value"), mock)


@query("""WITH t AS (SELECT district_id, CASE WHEN median(duration_s) <= 1560 THEN 'OK' ELSE 'LONG' END AS status FROM f_route GROUP BY 1)
 SELECT d.district_id, CASE WHEN school_id IS NOT NULL AND status = 'OK' THEN 'ILUSTRATIVE_AVAILABLE' ELSE 'ILUSTR_NO_DATA' END AS value, CASE WHEN school_id IS NOT NULL AND status = 'OK' THEN 0.5e0 ELSE 0.0e0 END AS confidence,
 CASE WHEN school_id IS NULL THEN 0.0e0 ELSE 0.3e0 END AS data_completeness, true AS is_illustrative FROM f_district d LEFT JOIN t ON t.district_id = d.district_id""")
def check_pc(v: Views) -> DataFrame:
    transit = serve.route_stats(v("f_route")).select("district_id", F.when(F.col("median_s") <= 1560, "OK").otherwise("LONG").alias("status"))
    return rules.check_pc(v("f_district"), transit).select("district_id", "value", "confidence", "data_completeness", "is_illustrative")


@query(f"""WITH {PAIRS}, st AS (SELECT district_id AS a, district_id + 1 AS b, municipality_id, 7.5e0 AS area FROM f_district WHERE district_id % 10 = 0)
 SELECT a, b, municipality_id, round(area, 3) AS area, 'detected' AS origin FROM pairs UNION ALL SELECT a, b, municipality_id, area, 'stored' FROM st""")
def all_overlaps(v: Views) -> DataFrame:
    kept = v("f_district").filter("district_id % 10 = 0").select(F.col("district_id").alias("a"), (F.col("district_id") + 1).alias("b"), "municipality_id", F.lit(7.5).alias("area"))
    return spatial.all_overlaps(spatial.overlap_pairs(districts(v)), kept).withColumn("area", F.round("area", 3))


SHIFT = "(SELECT school_id, x + 1500 * (school_id % 3) - 800 AS x0, x + 1500 * (school_id % 3) + 700 AS x1, y - 4000 * (school_id % 4) AS y0, y - 4000 * (school_id % 4) + 300 AS y1 FROM f_school)"


@query(f"SELECT a.school_id FROM {SHIFT} a WHERE EXISTS (SELECT 1 FROM f_district b WHERE b.school_type = 'ZS' AND {SHARED} > 0)")
def overlays_in_scope(v: Views) -> DataFrame:
    overlays = spatial.box_polygons(v.sql(f"SELECT * FROM {SHIFT}"))
    return spatial.overlays_in_scope(overlays, districts(v).filter("school_type = 'ZS'"), "school_id").select("school_id")


@query(f"""WITH {CONSISTENT}, m AS (SELECT address_id, unnest(vzn_districts) AS vzn_district_id, poly_district_id FROM cons WHERE result = 'MISMATCH') SELECT m.address_id, m.vzn_district_id, m.poly_district_id, a.x, a.y FROM m JOIN f_address a ON a.address_id = m.address_id WHERE m.address_id % 5 <> 0""")
def mismatch_points(v: Views) -> DataFrame:
    points = addresses(v).withColumn("x", F.when(F.col("address_id") % 5 != 0, F.col("x")))
    return clean.mismatch_points(spatial.mismatch_rows(consistency(v)), points)


@query(f"""WITH l AS (SELECT d.district_id, s.x AS ax, s.y AS ay, d.x1 + 600 AS bx, d.y1 + 300 AS bz FROM f_district d JOIN f_school s ON s.school_id = d.district_id),
 p AS (SELECT l.*, h.district_id AS other, h.x, h.y, greatest(0, least(1, ((h.x - l.ax) * (l.bx - l.ax) + (h.y - l.ay) * (l.bz - l.ay)) / (pow(l.bx - l.ax, 2) + pow(l.bz - l.ay, 2)))) AS t
  FROM l JOIN (SELECT DISTINCT district_id, x, y FROM f_seed) h ON h.district_id <> l.district_id AND h.x BETWEEN least(l.ax, l.bx) - 50 AND greatest(l.ax, l.bx) + 50 AND h.y BETWEEN least(l.ay, l.bz) - 50 AND greatest(l.ay, l.bz) + 50)
 SELECT district_id AS line_id, array_to_string(list_sort(list(DISTINCT other)), ',') AS blockers FROM p WHERE sqrt(pow(x - (ax + t * (bx - ax)), 2) + pow(y - (ay + t * (bz - ay)), 2)) <= 50 GROUP BY 1""")
def corridor_blockers(v: Views) -> DataFrame:
    s = v("f_school").select(F.col("school_id").alias("district_id"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    lines = v("f_district").join(s, "district_id").select("district_id", F.col("district_id").alias("line_id"), "ax", "ay", (F.col("x1") + 600).alias("bx"), (F.col("y1") + 300).alias("by"))
    out = spatial.corridor_blockers(lines, v("f_seed").select("district_id", "x", "y").distinct())
    return out.select("line_id", F.array_join(F.transform("blockers", lambda x: x.cast("string")), ",").alias("blockers"))


# --- column functions


@query("SELECT street_id, trim(regexp_replace(lower(strip_accents(regexp_replace(regexp_replace('Ul. ' || street || ' č. 12', 'č\\.\\s*\\d*', '', 'g'), '\\b[uU]l\\.\\s*', '', 'g'))), '\\s+', ' ', 'g')) AS key FROM f_street")
def norm_building_street(v: Views) -> DataFrame:
    return v("f_street").select("street_id", T.norm_building_street(F.concat(F.lit("Ul. "), "street", F.lit(" č. 12"))).alias("key"))


@query("""SELECT conv_id, turn, '{"kept":"' || role || '","turn":"' || CASE WHEN turn % 2 = 0 THEN 'even' ELSE turn::VARCHAR END || '"' || CASE WHEN turn % 2 = 0 THEN ',"more":"x"' ELSE '' END || '}' AS merged FROM conversations""")
def json_merge(v: Views) -> DataFrame:
    c = v("conversations")
    turn = F.col("turn").cast("string")
    own = F.create_map(F.lit("kept"), F.col("role"), F.lit("turn"), turn)
    new = F.when(F.col("turn") % 2 == 0, F.create_map(F.lit("turn"), F.lit("even"), F.lit("more"), F.lit("x"))).otherwise(F.create_map(F.lit("turn"), turn))
    return c.select("conv_id", "turn", T.json_merge(own, new).alias("merged"))


@query("SELECT verdict_id, coalesce(condition_code IN ('S1', 'S2', CASE WHEN verdict_id % 4 = 0 THEN 'Pa' END), false) AND verdict_id % 10 <> 0 AS legal FROM f_verdict")
def any_of(v: Views) -> DataFrame:
    codes = F.when(F.col("verdict_id") % 10 != 0, F.array_compact(F.array(F.lit("S1"), F.lit("S2"), F.when(F.col("verdict_id") % 4 == 0, "Pa"))))
    return v("f_verdict").select("verdict_id", T.any_of("condition_code", codes).alias("legal"))


_N = 1 / 298.257223563 / (2 - 1 / 298.257223563)
_A1 = 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_E = 2 * _N**0.5 / (1 + _N)
_AL = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)


@query(f"""WITH p AS (SELECT address_id, radians(48.9 + y / 100000) AS phi, radians(x / 100000 - 0.05) AS dl FROM f_address), t AS (SELECT *, sinh(atanh(sin(phi)) - {_E!r} * atanh({_E!r} * sin(phi))) AS t FROM p),
 u AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM t)
 SELECT address_id, round(500000e0 + 0.9996e0 * {_A1!r}e0 * (eta + {" + ".join(f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(_AL, 1))}), 3) AS x,
 round(0.9996e0 * {_A1!r}e0 * (xi + {" + ".join(f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(_AL, 1))}), 3) AS y FROM u""")
def utm34n(v: Views) -> DataFrame:
    p = G.utm34n(20.95 + F.col("x") / 100000, 48.9 + F.col("y") / 100000)
    return v("f_address").select("address_id", p.alias("p")).select("address_id", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))
