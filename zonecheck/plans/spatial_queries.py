"""Registered queries over points, polygons, cells, windows of parts, checks and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import assign, clean, rules, serve, spatial, tessellate
from .queries import CLEAN, STREETS, neat, query, streets
from .views import Views

CELL = 100.0


def districts(v: Views) -> DataFrame:
    return spatial.box_polygons(v("f_district"))


def addresses(v: Views) -> DataFrame:
    return v("f_address")


IN = "a.x >= d.x0 AND a.x <= d.x1 AND a.y >= d.y0 AND a.y <= d.y1"
HITS = f"hits AS (SELECT a.address_id, a.municipality_id, d.district_id, d.name FROM f_address a JOIN f_district d ON d.municipality_id = a.municipality_id AND {IN})"
KIND = "a.municipality_id = b.municipality_id AND a.school_type = b.school_type AND a.teaching_language IS NOT DISTINCT FROM b.teaching_language"
SHARED = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
PAIRS = f"pairs AS (SELECT a.district_id AS a, b.district_id AS b, a.municipality_id, {SHARED} AS area FROM f_district a JOIN f_district b ON a.district_id < b.district_id AND {KIND} WHERE {SHARED} > 1)"


@query(f"WITH {HITS} SELECT address_id, district_id FROM hits")
def points_in_polygons(v: Views) -> DataFrame:
    return spatial.points_in_polygons(addresses(v), districts(v)).select("address_id", "district_id")


@query(f"WITH {HITS} SELECT a.address_id, min(h.district_id) AS district_id FROM f_address a LEFT JOIN hits h ON h.address_id = a.address_id GROUP BY 1")
def covering_polygon(v: Views) -> DataFrame:
    return spatial.covering_polygon(addresses(v), districts(v), "address_id")


FAILURES = f"{HITS}, fails AS (SELECT a.address_id, a.municipality_id, count(h.district_id) AS hits, coalesce(string_agg(h.name, ' | ' ORDER BY h.name), '') AS names FROM f_address a LEFT JOIN hits h ON h.address_id = a.address_id GROUP BY 1, 2 HAVING count(h.district_id) <> 1)"


@query(f"WITH {FAILURES} SELECT * FROM fails")
def coverage_failures(v: Views) -> DataFrame:
    return spatial.coverage_failures(addresses(v), districts(v))


@query(f"WITH {FAILURES} SELECT address_id, municipality_id, 'uncovered' AS kind FROM fails WHERE hits = 0 UNION ALL SELECT address_id, municipality_id, 'multi' FROM fails WHERE hits > 1")
def all_failures(v: Views) -> DataFrame:
    f = spatial.coverage_failures(addresses(v), districts(v))
    part = lambda c, kind: f.filter(c).select("address_id", "municipality_id", F.lit(kind).alias("kind"))
    return part("hits = 0", "uncovered").unionByName(part("hits > 1", "multi"))


@query(f"WITH {PAIRS} SELECT a, b, municipality_id, round(area, 3) AS area FROM pairs")
def overlap_pairs(v: Views) -> DataFrame:
    return spatial.overlap_pairs(districts(v)).withColumn("area", F.round("area", 3))


@query(f"WITH {PAIRS} SELECT count(*) AS pairs, round(coalesce(sum(area), 0.0), 3) AS area FROM pairs")
def overlap_totals(v: Views) -> DataFrame:
    return spatial.overlap_totals(spatial.overlap_pairs(districts(v))).withColumn("area", F.round("area", 3))


@query(f"SELECT a.district_id, round(coalesce(sum({SHARED}) FILTER (b.district_id IS NOT NULL), 0.0), 3) AS shared_area FROM f_district a LEFT JOIN f_district b ON b.school_type = 'MS' AND {SHARED} > 0 GROUP BY 1")
def intersection_area(v: Views) -> DataFrame:
    d = districts(v)
    return spatial.intersection_area(d, d.filter("school_type = 'MS'"), "district_id").withColumn("shared_area", F.round("shared_area", 3))


@query("""WITH p AS (SELECT a.address_id, s.school_id, sqrt((a.x - s.x) * (a.x - s.x) + (a.y - s.y) * (a.y - s.y)) AS d FROM f_address a JOIN f_school s ON abs(a.x - s.x) <= 500 AND abs(a.y - s.y) <= 500)
 SELECT address_id, arg_min(school_id, d * 1000000 + school_id / 1000000.0) AS school_id, min(d) AS distance FROM p WHERE d <= 500 GROUP BY 1""")
def nearest_within(v: Views) -> DataFrame:
    return spatial.nearest_within(addresses(v), v("f_school"), 500.0, "address_id", "school_id")


@query(f"""SELECT d.district_id, count(a.school_id) AS school_count, coalesce(bool_or(a.school_id = d.school_id), false) AS own_inside FROM f_district d LEFT JOIN f_school a ON a.is_public AND a.type = d.school_type AND {IN} GROUP BY 1""")
def schools_per_district(v: Views) -> DataFrame:
    return spatial.schools_per_district(v("f_school"), districts(v))


@query(f"WITH {HITS} SELECT d.district_id, count(h.address_id) AS buildings FROM f_district d LEFT JOIN hits h ON h.district_id = d.district_id GROUP BY 1")
def buildings_per_district(v: Views) -> DataFrame:
    return spatial.count_inside(addresses(v), districts(v), "buildings")


POINTS = f"{CLEAN}, pts AS (SELECT a.address_id, a.municipality_id, c.ulica_norm, a.x, a.y FROM f_address a JOIN clean c ON c.register_id = a.address_id)"
CONSISTENT = f"""{POINTS}, {STREETS}, cov AS (SELECT a.address_id, min(d.district_id) AS poly FROM f_address a LEFT JOIN f_district d ON d.municipality_id = a.municipality_id AND {IN} GROUP BY 1),
 st AS (SELECT municipality_id, street_norm, list_sort(list(DISTINCT district_id)) AS vz FROM streets GROUP BY 1, 2),
 cons AS (SELECT p.address_id, cov.poly AS poly_district_id, st.vz AS vzn_districts, CASE WHEN st.vz IS NULL THEN 'NO_VZN' WHEN cov.poly IS NULL THEN 'NO_POLYGON' WHEN list_contains(st.vz, cov.poly) THEN 'MATCH' ELSE 'MISMATCH' END AS result
  FROM pts p JOIN cov ON cov.address_id = p.address_id LEFT JOIN st ON st.municipality_id = p.municipality_id AND st.street_norm = p.ulica_norm)"""


def consistency(v: Views) -> DataFrame:
    points = addresses(v).join(neat(v).select(F.col("register_id").alias("address_id"), "ulica_norm"), "address_id")
    return spatial.geometric_consistency(points, streets(v), districts(v))


@query(f"WITH {CONSISTENT} SELECT address_id, poly_district_id, result FROM cons")
def geometric_consistency(v: Views) -> DataFrame:
    return consistency(v).select("address_id", "poly_district_id", "result")


@query(f"WITH {CONSISTENT}, m AS (SELECT address_id, unnest(vzn_districts) AS vzn_district_id, poly_district_id FROM cons WHERE result = 'MISMATCH') SELECT vzn_district_id, count(*) AS mismatch_count FROM m GROUP BY 1")
def mismatch_counts(v: Views) -> DataFrame:
    return assign.mismatch_counts(spatial.mismatch_rows(consistency(v)), "vzn_district_id")


@query(f"""WITH {CONSISTENT}, m AS (SELECT address_id, unnest(vzn_districts) AS vzn_district_id, poly_district_id FROM cons WHERE result = 'MISMATCH')
SELECT *, row_number() OVER (ORDER BY vzn_district_id DESC NULLS LAST, address_id) AS place FROM m""")
def ordered_mismatches(v: Views) -> DataFrame:
    return serve.numbered(spatial.mismatch_rows(consistency(v)), F.col("vzn_district_id").desc_nulls_last(), F.col("address_id"))


# --- tessellation

# coordinates of seeds and of the middles of cells are whole metres, so squared distances are whole numbers
BOUNDS = "bounds AS (SELECT municipality_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM f_district GROUP BY 1)"
OWNED = f"""{BOUNDS}, cx AS (SELECT municipality_id, y0, y1, unnest(range(CAST(ceil(x0 / {CELL} - 0.5) AS BIGINT), CAST(ceil(x1 / {CELL} - 0.5) AS BIGINT))) AS cx FROM bounds),
 cells AS (SELECT municipality_id, cx, cy, (cx + 0.5) * {CELL} AS x, (cy + 0.5) * {CELL} AS y FROM (SELECT municipality_id, cx, unnest(range(CAST(ceil(y0 / {CELL} - 0.5) AS BIGINT), CAST(ceil(y1 / {CELL} - 0.5) AS BIGINT))) AS cy FROM cx) t),
 owned AS (SELECT c.municipality_id, c.cx, c.cy, min(CAST((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y) AS BIGINT) * 1000000 + s.district_id) % 1000000 AS district_id
  FROM cells c JOIN (SELECT DISTINCT municipality_id, district_id, x, y FROM f_seed) s ON s.municipality_id = c.municipality_id GROUP BY 1, 2, 3)"""


def owned(v: Views) -> DataFrame:
    bounds = v("f_district").groupBy("municipality_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return tessellate.tessellate(tessellate.raster(bounds, CELL), v("f_seed").select("municipality_id", "district_id", "x", "y")).select("municipality_id", "cx", "cy", "district_id")


@query(f"WITH {OWNED} SELECT municipality_id, cx, cy, district_id FROM owned")
def tessellate_cells(v: Views) -> DataFrame:
    return owned(v)


@query(f"WITH {OWNED} SELECT district_id, count(*) AS cells, count(*) * {CELL * CELL}e0 AS area FROM owned GROUP BY 1")
def district_cells(v: Views) -> DataFrame:
    return tessellate.district_cells(owned(v), CELL)


# --- samples, work lists, upserts, counts


@query(f"""WITH {HITS}, o AS (SELECT district_id, CAST(NULL AS BIGINT) AS address_id, 0 AS k FROM f_district UNION ALL SELECT district_id, address_id, 1 FROM hits UNION ALL SELECT district_id, address_id + 1000000, 2 FROM hits WHERE address_id % 3 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY district_id ORDER BY k, md5('0:' || CAST(address_id AS VARCHAR)), address_id) AS n FROM o) SELECT district_id, address_id, CASE k WHEN 0 THEN 'centroid' WHEN 1 THEN 'address' ELSE 'building' END AS kind FROM r WHERE n <= 20""")
def sample_origins(v: Views) -> DataFrame:
    inside = spatial.points_in_polygons(addresses(v), districts(v)).select("district_id", "address_id")
    centroids = v("f_district").select("district_id", F.lit(None).cast("long").alias("address_id"))
    buildings = inside.filter("address_id % 3 = 0").withColumn("address_id", F.col("address_id") + 1000000)
    return serve.sample_origins(inside, centroids=centroids, buildings=buildings).select("district_id", "address_id", "kind")


@query("SELECT ulica AS adresa, min(register_id % 3) AS tier, arg_min(register_id, (register_id % 3) * 1000000000 + register_id) AS register_id FROM f_register GROUP BY 1")
def first_tier(v: Views) -> DataFrame:
    return assign.first_tier(v("f_register").select(F.col("ulica").alias("adresa"), (F.col("register_id") % 3).alias("tier"), "register_id"))


@query(f"WITH {CLEAN} SELECT register_id, ulica_norm FROM clean ORDER BY ulica_norm, register_id LIMIT 2000")
def budget_cut(v: Views) -> DataFrame:
    return assign.budget_cut(neat(v).select("register_id", "ulica_norm"), 2000, ["ulica_norm", "register_id"])


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("f_district", "f_school", "f_address", "f_register", "f_verdict", "f_finding")))
def row_counts(v: Views) -> DataFrame:
    out = None
    for t in ("f_district", "f_school", "f_address", "f_register", "f_verdict", "f_finding"):
        one = v(t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT school_type AS type, count(*) AS before, count(*) FILTER (school_type IN ('ZS')) AS after, count(*) FILTER (school_type NOT IN ('ZS')) AS deleted FROM f_district GROUP BY 1")
def filter_school_types(v: Views) -> DataFrame:
    return clean.filter_school_types(v("f_district").withColumnRenamed("school_type", "type"), ("ZS",))


@query("SELECT register_id, f AS field, 'error' AS severity FROM (SELECT register_id, unnest(list_filter([CASE WHEN orientacne_cislo IS NULL OR trim(orientacne_cislo) = '' THEN 'orientacne_cislo' END, CASE WHEN obyvatelna IS NULL THEN 'obyvatelna' END], lambda x: x IS NOT NULL)) AS f FROM f_register) t")
def validate_required(v: Views) -> DataFrame:
    return clean.validate_required(v("f_register"), ["orientacne_cislo", "obyvatelna"], "register_id")


@query("SELECT district_id, 'school_type' AS field, school_type AS value, 'warning' AS severity FROM f_district WHERE school_type NOT IN ('ZS')")
def validate_domain(v: Views) -> DataFrame:
    return clean.validate_domain(v("f_district"), {"school_type": ["ZS"]}, "district_id")


@query("SELECT verdict_id, 'confidence' AS rule FROM f_verdict WHERE NOT (confidence BETWEEN 0 AND 0.3) UNION ALL SELECT verdict_id, 'value' FROM f_verdict WHERE value NOT IN ('PASS', 'FAIL', 'RISK')")
def check_constraints(v: Views) -> DataFrame:
    return clean.check_constraints(v("f_verdict"), "verdict_id", {"confidence": F.col("confidence").between(0, 0.3), "value": F.col("value").isin("PASS", "FAIL", "RISK")})


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM f_house_geocode GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(v: Views) -> DataFrame:
    return clean.duplicate_keys(v("f_house_geocode"), ["l_orderkey", "l_linenumber"])


@query("SELECT verdict_id FROM f_verdict f WHERE NOT EXISTS (SELECT 1 FROM f_district d WHERE d.district_id = f.district_id)")
def orphans(v: Views) -> DataFrame:
    return clean.orphans(v("f_verdict"), v("f_district"), "district_id", "district_id").select("verdict_id")


# --- checks

S1 = f"""{FAILURES}, t AS (SELECT municipality_id, count(*) AS n FROM f_address GROUP BY 1), b AS (SELECT municipality_id, count(*) AS bad FROM fails GROUP BY 1),
 s1 AS (SELECT d.district_id, n IS NOT NULL AND coalesce(bad, 0) = 0 AS fine FROM f_district d LEFT JOIN t ON t.municipality_id = d.municipality_id LEFT JOIN b ON b.municipality_id = d.municipality_id)"""


@query(f"WITH {S1} SELECT district_id, 'S1' AS condition_code, CASE WHEN fine THEN 'PASS' ELSE 'INCOMPLETE' END AS value, CASE WHEN fine THEN 0.8e0 ELSE 0.4e0 END AS confidence, CASE WHEN fine THEN 0.9e0 ELSE 0.3e0 END AS data_completeness, NOT fine AS is_proxy, false AS is_illustrative FROM s1")
def check_s1(v: Views) -> DataFrame:
    return rules.check_s1(districts(v), addresses(v))


@query(f"""WITH {PAIRS}, n AS (SELECT district_id, count(*) AS k FROM (SELECT a AS district_id FROM pairs UNION ALL SELECT b FROM pairs) u GROUP BY 1)
 SELECT d.district_id, 'S2' AS condition_code, CASE WHEN k IS NULL THEN 'PASS' WHEN geometry_confidence IN ('low','medium') THEN 'INCOMPLETE' ELSE 'FAIL' END AS value,
 CASE WHEN k IS NULL THEN 0.7e0 WHEN geometry_confidence IN ('low','medium') THEN 0.3e0 ELSE 0.7e0 END AS confidence FROM f_district d LEFT JOIN n ON n.district_id = d.district_id""")
def check_s2(v: Views) -> DataFrame:
    return rules.check_s2(districts(v), spatial.overlap_pairs(districts(v))).select("district_id", "condition_code", "value", "confidence")


@query(f"""WITH s AS (SELECT d.district_id, d.school_id, d.geometry_confidence, count(a.school_id) AS n, coalesce(bool_or(a.school_id = d.school_id), false) AS own FROM f_district d LEFT JOIN f_school a ON a.is_public AND a.type = d.school_type AND {IN} GROUP BY 1, 2, 3),
 w AS (SELECT *, coalesce(geometry_confidence IN ('low','medium'), false) AS weak FROM s)
 SELECT district_id, CASE WHEN school_id IS NULL THEN 'INCOMPLETE' WHEN n = 1 THEN 'PASS' WHEN n = 0 THEN CASE WHEN weak THEN 'INCOMPLETE' ELSE 'FAIL' END ELSE CASE WHEN own AND weak THEN 'INCOMPLETE' ELSE 'FAIL' END END AS value,
 CASE WHEN school_id IS NULL THEN 0.0e0 WHEN n = 1 THEN CASE WHEN own THEN 0.75e0 ELSE 0.55e0 END WHEN n = 0 THEN CASE WHEN weak THEN 0.3e0 ELSE 0.6e0 END ELSE CASE WHEN own AND weak THEN 0.4e0 ELSE 0.7e0 END END AS confidence FROM w""")
def check_s3(v: Views) -> DataFrame:
    return rules.check_s3(districts(v), v("f_school")).select("district_id", "value", "confidence")


@query("""WITH r AS (SELECT district_id, median(distance_m) AS m, median(duration_s) AS s, count(distance_m) AS n FROM f_route GROUP BY 1), j AS (SELECT d.district_id, d.school_id, m, s, coalesce(n, 0) AS n FROM f_district d LEFT JOIN r ON r.district_id = d.district_id)
 SELECT district_id, CASE WHEN school_id IS NULL OR n = 0 THEN 'INCOMPLETE' WHEN m <= 2000 AND s <= 1800 THEN 'PASS' WHEN m <= 4000 THEN 'RISK' ELSE 'FAIL' END AS value,
 CASE WHEN school_id IS NULL OR n = 0 THEN 0.0e0 WHEN n >= 10 THEN 0.7e0 WHEN n >= 5 THEN 0.55e0 ELSE 0.3e0 END AS confidence FROM j""")
def check_pb(v: Views) -> DataFrame:
    return rules.check_pb(v("f_district"), v("f_route")).select("district_id", "value", "confidence")


@query(f"""WITH s AS (SELECT a.district_id, (a.x1 - a.x0) * (a.y1 - a.y0) AS area, coalesce(sum({SHARED}) FILTER (b.district_id IS NOT NULL), 0.0) AS shared FROM f_district a LEFT JOIN f_district b ON b.school_type = 'MS' AND {SHARED} > 0 GROUP BY 1, 2), {HITS},
 h AS (SELECT district_id, count(*) AS n FROM hits GROUP BY 1)
 SELECT s.district_id, CASE WHEN shared = 0 AND coalesce(n, 0) = 0 THEN 'NOT_EVALUATED' WHEN shared > 0.1 * area THEN 'SIGNAL' ELSE 'NO_SIGNAL' END AS value, CASE WHEN shared > 0 THEN 0.5e0 ELSE 0.0e0 END AS confidence FROM s LEFT JOIN h ON h.district_id = s.district_id""")
def check_pe(v: Views) -> DataFrame:
    d = districts(v).withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    shared = spatial.intersection_area(d, d.filter("school_type = 'MS'"), "district_id")
    return rules.check_pe(d, shared, spatial.count_inside(addresses(v), d, "buildings")).select("district_id", "value", "confidence")


@query("SELECT district_id, condition_code, value, 'v1' AS engine_version FROM f_district, (VALUES ('Pa', 'INSUFFICIENT_DATA'), ('Pd', 'INSUFFICIENT_DATA'), ('Pf', 'NOT_EVALUATED')) t(condition_code, value)")
def verdict_rows(v: Views) -> DataFrame:
    d = v("f_district")
    return rules.verdict_rows([rules.check_pa(d), rules.check_pd(d), rules.check_pf(d)], "v1", "0.1").select("district_id", "condition_code", "value", "engine_version")
