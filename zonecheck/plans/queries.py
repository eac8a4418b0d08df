"""Registered queries of the library, each with its SQL counterpart.

Every query starts from the views of ``views`` over whole tables. ``QUERIES`` holds callables of (spark, sf_dir),
``ORACLE_SQL`` the SQL that gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import assign, clean, serve
from .views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of Views under its own name, with its SQL."""

    def register(f: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Views(spark, sf_dir))

        run.__name__ = run.__qualname__ = f.__name__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return register


# the street key in SQL
def norm_sql(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(replace(replace({c}, 'Arm. gen.', 'Armádneho generála'), 'č.', ''))), '^ulica\\s+|\\s+ulica$', '', 'g'), '[.]', ' ', 'g'), '\\s+', ' ', 'g'))"


MASK = "left(regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}', '[email]', 'g'), '(?:\\+421|00421)[\\s\\-]?\\d{{1,4}}[\\s\\-]?\\d{{3,4}}[\\s\\-]?\\d{{3,4}}|0\\d{{1,4}}[\\s\\-]?\\d{{3,4}}[\\s\\-]?\\d{{3,4}}', '[tel]', 'g'), '\\d{{6}}\\s*/\\s*\\d{{3,4}}', '[rč]', 'g'), {n})"


def case_sql(c: str, values: dict, default: str) -> str:
    show = lambda v: str(v) if isinstance(v, int) else f"'{v}'"
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {show(v)}" for k, v in values.items()) + f" ELSE {default} END"


LABEL = case_sql("condition_code", T.CONDITIONS, "condition_code")
ORDER = case_sql("condition_code", {k: i + 1 for i, k in enumerate(T.CONDITIONS)}, "99")
RANK = case_sql("severity", T.SEVERITY_RANK, "1")
HOSTS = ["example.com", "example.net"]
HOST = "lower(regexp_replace({c}, '^[Hh][Tt][Tt][Pp][Ss]?://([^/:]+).*$', '\\1'))"
ALLOWED = "coalesce(" + " OR ".join(f"{HOST} = '{h}' OR {HOST} LIKE '%.{h}'" for h in HOSTS) + ", false)"

CLEAN = f"""clean AS (SELECT min(register_id) AS register_id, municipality_id, ulica_norm, s AS supisne_cislo, o AS orientacne_cislo, arg_min(ulica, register_id) AS ulica
 FROM (SELECT register_id, municipality_id, ulica, {norm_sql('ulica')} AS ulica_norm, trim(supisne_cislo) AS s, trim(orientacne_cislo) AS o FROM f_register WHERE obyvatelna = true AND vyradena IS NOT TRUE) x
 WHERE ulica_norm <> '' GROUP BY municipality_id, ulica_norm, s, o)"""
STREETS = f"streets AS (SELECT DISTINCT d.municipality_id, r.district_id, {norm_sql('r.street')} AS street_norm FROM f_street_range r JOIN f_district d ON d.district_id = r.district_id WHERE {norm_sql('r.street')} <> '')"
VALID = """house AS (SELECT *, nullif(regexp_extract(trim(regexp_replace(trim(regexp_replace(formatted_address, ',?\\s*\\d{3}\\s*\\d{2}\\s+.*$', '')), ',.*$', '')), '[/ ](\\d+)\\s*$', 1), '') AS found_house FROM f_house_geocode),
 checked AS (SELECT *, CASE WHEN status IS NULL OR status <> 'OK' THEN 'status_' || lower(coalesce(status, 'none')) WHEN found_house IS NULL AND partial_match THEN 'partial_match_off_target'
  WHEN found_house IS NULL THEN 'no_house_in_formatted_address' WHEN found_house IS DISTINCT FROM house_number THEN 'house_number_mismatch' END AS validation_reason FROM house),
 valid AS (SELECT *, validation_reason IS NULL AS valid FROM checked)"""
LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY district_id, condition_code ORDER BY computed_at DESC, verdict_id DESC) AS rn FROM f_verdict) t WHERE rn = 1)"
COMPOSED = f"""{LATEST},
 inputs AS (SELECT district_id, coalesce(bool_or(condition_code IN ('S1','S2','S3')), false) AS has_legal, coalesce(bool_or(condition_code IN ('S1','S2','S3') AND value = 'FAIL'), false) AS any_fail,
  coalesce(bool_or(condition_code IN ('S1','S2','S3') AND value = 'INCOMPLETE'), false) AS any_incomplete,
  coalesce(bool_or(condition_code IN ('Pa','Pb','Pc','Pd') AND NOT coalesce(is_illustrative, false) AND value IN ('RISK','INSUFFICIENT_DATA')), false) AS any_indicator_risk,
  max(engine_version) AS engine_version, max(computed_at) AS computed_at FROM latest GROUP BY district_id),
 composed AS (SELECT d.district_id, d.municipality_id,
  CASE WHEN NOT coalesce(has_legal, false) THEN 'NONE' WHEN any_fail THEN 'RED' WHEN any_incomplete OR any_indicator_risk THEN 'ORANGE' ELSE 'GREEN' END AS composition_color,
  CASE WHEN NOT coalesce(has_legal, false) THEN '{serve.REASONS['none']}' WHEN any_fail THEN '{serve.REASONS['fail']}' WHEN any_incomplete AND any_indicator_risk THEN '{serve.REASONS['both']}'
   WHEN any_incomplete THEN '{serve.REASONS['incomplete']}' WHEN any_indicator_risk THEN '{serve.REASONS['risk']}' ELSE '{serve.REASONS['pass']}' END AS composition_reason,
  coalesce(any_fail, false) AS legal_fail, coalesce(any_incomplete, false) AS legal_incomplete, coalesce(any_indicator_risk, false) AS indicator_risk, engine_version, computed_at
  FROM f_district d LEFT JOIN inputs i ON i.district_id = d.district_id)"""


def neat(v: Views) -> DataFrame:
    return clean.clean_register(v("f_register"))


def streets(v: Views) -> DataFrame:
    return assign.district_streets(v("f_street_range"), v("f_district"))


def composed(v: Views) -> DataFrame:
    return serve.district_compositions(v("f_district"), v("f_verdict"))


def card(v: Views) -> DataFrame:
    return serve.scorecard(v("f_verdict"), v("f_district"), v("f_municipality"), composed(v), HOSTS)


# --- registers and streets


@query(f"WITH {CLEAN} SELECT register_id, municipality_id, ulica_norm, supisne_cislo, orientacne_cislo FROM clean")
def clean_register(v: Views) -> DataFrame:
    return neat(v).select("register_id", "municipality_id", "ulica_norm", "supisne_cislo", "orientacne_cislo")


@query(f"""WITH {CLEAN}, c AS (SELECT municipality_id, count(*) AS kept FROM clean GROUP BY 1),
 r AS (SELECT municipality_id, count(*) AS total, count(*) FILTER (NOT coalesce(obyvatelna, false)) AS not_habitable, count(*) FILTER (coalesce(obyvatelna, false) AND coalesce(vyradena, false)) AS withdrawn,
 count(*) FILTER (coalesce(obyvatelna, false) AND NOT coalesce(vyradena, false) AND coalesce({norm_sql('ulica')}, '') = '') AS empty_street,
 count(*) FILTER (coalesce(obyvatelna, false) AND NOT coalesce(vyradena, false) AND coalesce({norm_sql('ulica')}, '') <> '') AS eligible FROM f_register GROUP BY 1)
 SELECT r.municipality_id, total, not_habitable, withdrawn, empty_street, coalesce(kept, 0) AS kept, eligible - coalesce(kept, 0) AS duplicates FROM r LEFT JOIN c ON c.municipality_id = r.municipality_id""")
def clean_report(v: Views) -> DataFrame:
    return clean.clean_report(v("f_register"), neat(v))


@query(f"""WITH {CLEAN} SELECT register_id, municipality_id, ulica_norm, orientacne_cislo FROM (SELECT *, row_number() OVER (PARTITION BY municipality_id, ulica_norm
 ORDER BY CAST(nullif(regexp_replace(orientacne_cislo, '\\D', '', 'g'), '') AS INT) ASC NULLS LAST, orientacne_cislo ASC NULLS LAST, register_id) AS n FROM clean) t WHERE n = 1""")
def street_anchors(v: Views) -> DataFrame:
    return clean.street_anchors(neat(v)).select("register_id", "municipality_id", "ulica_norm", "orientacne_cislo")


@query(f"SELECT street_id, {norm_sql('street')} AS street_norm FROM f_street")
def norm_street(v: Views) -> DataFrame:
    return v("f_street").select("street_id", T.norm_street("street").alias("street_norm"))


@query(f"WITH {STREETS} SELECT * FROM streets")
def district_streets(v: Views) -> DataFrame:
    return streets(v)


@query(f"WITH {CLEAN}, {STREETS} SELECT c.register_id, s.district_id FROM clean c LEFT JOIN streets s ON s.municipality_id = c.municipality_id AND s.street_norm = c.ulica_norm")
def assign_by_street(v: Views) -> DataFrame:
    return assign.assign_by_street(neat(v), streets(v)).select("register_id", "district_id")


@query(f"""WITH {CLEAN}, {STREETS}, k AS (SELECT DISTINCT municipality_id, street_norm FROM streets)
 SELECT c.municipality_id, CAST(count(*) AS BIGINT) AS total, CAST(count(k.street_norm) AS BIGINT) AS assigned, CAST(count(*) - count(k.street_norm) AS BIGINT) AS unassigned
 FROM clean c LEFT JOIN k ON k.municipality_id = c.municipality_id AND k.street_norm = c.ulica_norm GROUP BY 1""")
def assignment_totals(v: Views) -> DataFrame:
    return assign.assignment_totals(neat(v), streets(v))


@query(f"""WITH {CLEAN}, {STREETS} SELECT municipality_id, ulica_norm AS street_norm, min(ulica) AS sample, count(*) AS addresses FROM clean c
 WHERE NOT EXISTS (SELECT 1 FROM streets s WHERE s.municipality_id = c.municipality_id AND s.street_norm = c.ulica_norm) GROUP BY 1, 2""")
def coverage_gaps(v: Views) -> DataFrame:
    return assign.coverage_gaps(neat(v), streets(v))


@query(f"WITH {CLEAN}, {STREETS} SELECT municipality_id, district_id, street_norm FROM streets s WHERE NOT EXISTS (SELECT 1 FROM clean c WHERE c.municipality_id = s.municipality_id AND c.ulica_norm = s.street_norm)")
def empty_streets(v: Views) -> DataFrame:
    return assign.empty_streets(neat(v), streets(v)).select("municipality_id", "district_id", "street_norm")


@query(f"WITH {STREETS} SELECT municipality_id, street_norm, count(DISTINCT district_id) AS districts FROM streets GROUP BY 1, 2 HAVING count(DISTINCT district_id) > 1")
def border_streets(v: Views) -> DataFrame:
    return assign.border_streets(streets(v))


@query(f"""WITH {CLEAN}, {STREETS}, reg AS (SELECT municipality_id, {norm_sql('ulica')} AS k, register_id, ulica FROM f_register WHERE obyvatelna = true),
 raw AS (SELECT s.district_id, count(DISTINCT r.register_id) AS habitable_addresses, count(DISTINCT r.ulica) AS register_streets, count(DISTINCT s.street_norm) AS vzn_streets,
  count(DISTINCT s.street_norm) FILTER (r.register_id IS NOT NULL) AS vzn_streets_in_register FROM streets s LEFT JOIN reg r ON r.municipality_id = s.municipality_id AND r.k = s.street_norm GROUP BY 1),
 cl AS (SELECT s.district_id, count(DISTINCT c.register_id) AS clean_habitable_addresses, count(DISTINCT c.ulica_norm) AS clean_distinct_streets FROM streets s LEFT JOIN clean c ON c.municipality_id = s.municipality_id AND c.ulica_norm = s.street_norm GROUP BY 1)
 SELECT raw.district_id, habitable_addresses, register_streets, vzn_streets, vzn_streets_in_register, floor((vzn_streets_in_register * 20000 + vzn_streets) / (2 * vzn_streets)) / 10000 AS street_coverage,
  clean_habitable_addresses, clean_distinct_streets, floor((clean_distinct_streets * 20000 + vzn_streets) / (2 * vzn_streets)) / 10000 AS clean_street_coverage
 FROM raw JOIN cl ON cl.district_id = raw.district_id""")
def district_address_stats(v: Views) -> DataFrame:
    return assign.district_address_stats(v("f_register"), neat(v), streets(v))


@query(f"""WITH {CLEAN}, c2 AS (SELECT *, TRY_CAST(nullif(regexp_extract(orientacne_cislo, '^\\s*(\\d+)', 1), '') AS INT) AS house FROM clean),
 seg AS (SELECT d.municipality_id, r.district_id, {norm_sql('r.street')} AS k, CASE range_type WHEN 'odd' THEN 1 WHEN 'even' THEN 0 END AS parity, lo, CASE WHEN range_type = 'single' THEN lo ELSE hi END AS hi
  FROM f_street_range r JOIN f_district d ON d.district_id = r.district_id)
 SELECT DISTINCT c2.register_id, seg.district_id FROM c2 JOIN seg ON seg.municipality_id = c2.municipality_id AND seg.k = c2.ulica_norm
 WHERE house IS NULL OR (coalesce(lo, 0) <= house AND house <= coalesce(hi, 1000000000) AND (parity IS NULL OR house % 2 = parity))""")
def assign_by_house(v: Views) -> DataFrame:
    segments = assign.range_segments(v("f_street_range")).join(v("f_district").select("district_id", "municipality_id"), "district_id")
    return assign.assign_by_house(neat(v), segments).select("register_id", "district_id")


@query("""WITH p AS (SELECT register_id, lower(ulica) AS p FROM f_register ), s AS (SELECT street_id, lower(street) AS s FROM f_street),
 m AS (SELECT s.street_id, p.register_id AS point_id, row_number() OVER (PARTITION BY s.street_id ORDER BY p.register_id) AS n FROM p JOIN s ON left(p, 3) = left(s, 3) AND length(p) >= 3 AND length(s) >= 3 AND (starts_with(p, s) OR starts_with(s, p)))
 SELECT street_id, point_id FROM m WHERE n <= 50""")
def prefix_match(v: Views) -> DataFrame:
    return assign.prefix_match(v("f_register").select(F.col("register_id").alias("point_id"), F.col("ulica").alias("street")), v("f_street"))


@query(f"""WITH {STREETS}, k AS (SELECT DISTINCT {norm_sql('ulica')} AS street_norm FROM f_register WHERE obyvatelna)
 SELECT district_id, count(*) FILTER (k.street_norm IS NOT NULL) AS matched, count(*) FILTER (k.street_norm IS NULL) AS fallback FROM streets s LEFT JOIN k ON k.street_norm = s.street_norm GROUP BY 1""")
def match_coverage(v: Views) -> DataFrame:
    return assign.match_coverage(streets(v), v("f_register").filter("obyvatelna").select(F.col("ulica").alias("name")))


# --- geocodes and house ranges


@query(f"WITH {VALID} SELECT district_id, street, house_number, found_house, valid, validation_reason FROM valid")
def validate_geocodes(v: Views) -> DataFrame:
    return clean.validate_geocodes(v("f_house_geocode")).select("district_id", "street", "house_number", "found_house", "valid", "validation_reason")


@query(f"""WITH {VALID} SELECT district_id, count(*) AS total, count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid) AS invalid,
 min(TRY_CAST(house_number AS INT)) FILTER (valid) AS min_valid, max(TRY_CAST(house_number AS INT)) FILTER (valid) AS max_valid FROM valid GROUP BY 1""")
def validation_report(v: Views) -> DataFrame:
    return assign.validation_report(clean.validate_geocodes(v("f_house_geocode")), "district_id")


@query(f"WITH {VALID} SELECT coalesce(validation_reason, 'valid') AS reason, count(*) AS n FROM valid GROUP BY 1")
def validation_reasons(v: Views) -> DataFrame:
    return assign.reason_counts(clean.validate_geocodes(v("f_house_geocode")))


@query("SELECT status, count(*) AS n, count(*) FILTER (partial_match) AS partial, count(*) * 5.0 / 1000 AS cost FROM f_house_geocode GROUP BY 1")
def geocode_totals(v: Views) -> DataFrame:
    return assign.geocode_totals(v("f_house_geocode"))


@query(f"""WITH {VALID}, r AS (SELECT DISTINCT district_id, street FROM f_street_range WHERE range_type <> 'all')
 SELECT v.district_id, v.street, min(CAST(house_number AS INT)) AS detected_min, max(CAST(house_number AS INT)) AS detected_max FROM valid v JOIN r ON r.district_id = v.district_id AND r.street = v.street
 WHERE valid AND regexp_matches(house_number, '^[0-9]+$') GROUP BY 1, 2""")
def detected_ranges(v: Views) -> DataFrame:
    return assign.detected_ranges(v("f_street_range"), clean.validate_geocodes(v("f_house_geocode")))


@query("SELECT g.* FROM (SELECT DISTINCT district_id, street FROM f_house_geocode WHERE status = 'OK') g WHERE EXISTS (SELECT 1 FROM f_street_range r WHERE r.district_id = g.district_id AND r.street = g.street AND r.range_type = 'all')")
def street_seeds_all(v: Views) -> DataFrame:
    codes = v("f_house_geocode").filter("status = 'OK'").select("district_id", "street").distinct()
    return assign.street_seeds_all(codes, v("f_street_range"))


RANGE_ROWS = """rr AS (SELECT district_id, street, range_type, CASE range_type WHEN 'all' THEN CAST([] AS INT[]) WHEN 'single' THEN [lo] ELSE [lo, hi] END AS numbers FROM f_street_range)"""
EXPANDED = f"""{RANGE_ROWS}, ex AS (SELECT DISTINCT district_id, street, unnest(CASE range_type WHEN 'all' THEN CAST([] AS BIGINT[]) WHEN 'single' THEN CAST(numbers AS BIGINT[])
 WHEN 'range' THEN range(numbers[1], numbers[2] + 1) ELSE range(numbers[1], numbers[2] + 1, 2) END) AS house_number FROM rr)"""


def range_rows(v: Views) -> DataFrame:
    numbers = F.when(F.col("range_type") == "all", F.array().cast("array<int>")).when(F.col("range_type") == "single", F.array("lo")).otherwise(F.array("lo", "hi"))
    return v("f_street_range").select("district_id", "street", "range_type", numbers.alias("numbers"))


@query(f"WITH {EXPANDED} SELECT district_id, street, CAST(house_number AS INT) AS house_number FROM ex")
def expand_ranges(v: Views) -> DataFrame:
    return assign.expand_ranges(range_rows(v))


@query(f"""WITH {EXPANDED}, done AS (SELECT DISTINCT district_id, street, TRY_CAST(house_number AS INT) AS h FROM f_house_geocode WHERE status = 'OK'),
 k AS (SELECT *, row_number() OVER (PARTITION BY district_id, street ORDER BY house_number) - 1 AS i, count(*) OVER (PARTITION BY district_id, street) AS n FROM ex),
 picked AS (SELECT * FROM k WHERE n <= 100 OR i IN (SELECT (j.j * k.n) // 100 FROM range(100) j(j)))
 SELECT district_id, street, CAST(house_number AS INT) AS house_number FROM picked p WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.district_id = p.district_id AND d.street = p.street AND d.h = p.house_number)""")
def house_worklist(v: Views) -> DataFrame:
    done = v("f_house_geocode").filter("status = 'OK'").select("district_id", "street", F.col("house_number").try_cast("int").alias("house_number"))
    return assign.house_worklist(range_rows(v), done, 100)


# --- verdicts and views


@query(f"WITH {LATEST} SELECT verdict_id, district_id, condition_code, value, computed_at FROM latest")
def latest_verdicts(v: Views) -> DataFrame:
    return serve.latest_verdicts(v("f_verdict")).select("verdict_id", "district_id", "condition_code", "value", "computed_at")


@query(f"WITH {COMPOSED} SELECT * FROM composed")
def district_compositions(v: Views) -> DataFrame:
    return composed(v)


@query(f"WITH {COMPOSED} SELECT district_id, has_legal, any_fail, any_incomplete, any_indicator_risk FROM inputs")
def composition_inputs(v: Views) -> DataFrame:
    return serve.composition_inputs(serve.latest_verdicts(v("f_verdict")))


@query(f"WITH {COMPOSED} SELECT district_id, engine_version, computed_at FROM inputs")
def verdict_versions(v: Views) -> DataFrame:
    return serve.verdict_versions(serve.latest_verdicts(v("f_verdict")))


_CODES = "coalesce(array_to_string(list_sort(list_distinct(list(condition_code) FILTER ({w}))), ', '), '')"


@query(f"""WITH {LATEST}, c AS (SELECT district_id, {_CODES.format(w="condition_code IN ('S1','S2','S3') AND value = 'FAIL'")} AS fails, {_CODES.format(w="condition_code IN ('S1','S2','S3') AND value = 'INCOMPLETE'")} AS incompletes,
 {_CODES.format(w="condition_code IN ('Pa','Pb','Pc','Pd') AND NOT coalesce(is_illustrative, false) AND value IN ('RISK','INSUFFICIENT_DATA')")} AS risks FROM latest GROUP BY 1)
 SELECT *, CASE WHEN fails <> '' THEN 'RED' WHEN incompletes <> '' OR risks <> '' THEN 'ORANGE' ELSE 'GREEN' END AS color FROM c""")
def compose(v: Views) -> DataFrame:
    return serve.compose(serve.latest_verdicts(v("f_verdict")))


@query("SELECT verdict_id, district_id, condition_code, CASE value WHEN 'FAIL' THEN 'critical' WHEN 'INCOMPLETE' THEN 'medium' WHEN 'RISK' THEN 'high' WHEN 'INSUFFICIENT_DATA' THEN 'low' WHEN 'SIGNAL' THEN 'medium' ELSE 'info' END AS severity, 'open' AS status, left(evidence_text, 500) AS evidence_text, engine_version FROM f_verdict WHERE value <> 'PASS'")
def findings_from_verdicts(v: Views) -> DataFrame:
    return serve.findings_from_verdicts(v("f_verdict"))


@query(f"""WITH {COMPOSED} SELECT l.district_id, d.name AS district_name, d.municipality_id, m.name AS municipality_name, condition_code, {LABEL} AS condition_label, {ORDER} AS condition_order, value, confidence,
 CASE WHEN {ALLOWED.format(c='source')} THEN source END AS provenance_source, {MASK.format(c='evidence_text', n=500)} AS evidence_public_text, is_illustrative, composition_color, l.computed_at
 FROM latest l JOIN f_district d ON d.district_id = l.district_id JOIN f_municipality m ON m.municipality_id = d.municipality_id LEFT JOIN composed c ON c.district_id = l.district_id""")
def scorecard(v: Views) -> DataFrame:
    return card(v)


@query(f"""SELECT f.finding_id, f.district_id, d.name AS district_name, d.municipality_id, m.name AS municipality_name, f.condition_code, {LABEL.replace('condition_code', 'f.condition_code')} AS condition_label, severity, {RANK} AS severity_rank, status,
 {MASK.format(c='f.evidence_text', n=200)} AS evidence_public_text, CASE WHEN {ALLOWED.format(c='v.source')} THEN v.source END AS provenance_source, f.created_at, is_demo
 FROM f_finding f JOIN f_district d ON d.district_id = f.district_id JOIN f_municipality m ON m.municipality_id = d.municipality_id LEFT JOIN f_verdict v ON v.verdict_id = f.verdict_id""")
def findings_public(v: Views) -> DataFrame:
    return serve.findings_public(v("f_finding"), v("f_verdict"), v("f_district"), v("f_municipality"), HOSTS)


@query(f"""SELECT f.finding_id, f.district_id, severity, {RANK} AS severity_rank FROM f_finding f JOIN f_district d ON d.district_id = f.district_id WHERE severity IN ('critical','high','medium')""")
def findings_panel(v: Views) -> DataFrame:
    return serve.findings_panel(serve.findings_public(v("f_finding"), v("f_verdict"), v("f_district"), v("f_municipality"), HOSTS)).select("finding_id", "district_id", "severity", "severity_rank")


@query(f"SELECT finding_id, severity, created_at FROM f_finding ORDER BY {RANK} DESC, created_at DESC, finding_id LIMIT 50 OFFSET 50")
def findings_page(v: Views) -> DataFrame:
    return serve.findings_page(v("f_finding"), page=2).select("finding_id", "severity", "created_at")


@query("SELECT finding_id, district_id, condition_code FROM f_finding WHERE severity = 'high' AND status = 'open' AND condition_code = 'Pb'")
def findings_query(v: Views) -> DataFrame:
    return clean.findings_query(v("f_finding"), severity="high", status="open", condition="Pb").select("finding_id", "district_id", "condition_code")


@query(f"""WITH {COMPOSED} SELECT m.municipality_id, m.name, count(DISTINCT d.district_id) AS districts_count, count(DISTINCT d.school_id) AS schools_count, count(DISTINCT f.finding_id) FILTER (f.status = 'open') AS open_findings_count,
 count(DISTINCT c.district_id) FILTER (composition_color = 'RED') AS red_districts_count, count(DISTINCT c.district_id) FILTER (composition_color = 'ORANGE') AS orange_districts_count,
 count(DISTINCT c.district_id) FILTER (composition_color = 'GREEN') AS green_districts_count, count(DISTINCT c.district_id) FILTER (composition_color = 'NONE') AS none_districts_count
 FROM f_municipality m JOIN f_district d ON d.municipality_id = m.municipality_id LEFT JOIN f_finding f ON f.district_id = d.district_id LEFT JOIN composed c ON c.district_id = d.district_id GROUP BY 1, 2""")
def municipality_summary(v: Views) -> DataFrame:
    return serve.municipality_summary(v("f_municipality"), v("f_district"), v("f_finding"), composed(v))


@query("""WITH a AS (SELECT v.district_id, count(*) AS n, max(engine_version) AS e, max(computed_at) AS t FROM f_verdict v JOIN f_district d ON d.district_id = v.district_id GROUP BY 1),
 b AS (SELECT district_id, count(*) AS f, count(*) FILTER (status = 'open') AS o FROM f_finding GROUP BY 1)
 SELECT max(e) AS engine_version, max(t) AS last_engine_run_at, CAST(sum(n * greatest(coalesce(f, 0), 1)) AS BIGINT) AS verdicts_count, CAST(sum(n) AS BIGINT) AS verdicts_distinct, count(DISTINCT a.district_id) AS districts_count,
 count(DISTINCT d.school_id) AS schools_count, CAST(coalesce(sum(o), 0) AS BIGINT) AS open_findings_count FROM a JOIN f_district d ON d.district_id = a.district_id LEFT JOIN b ON b.district_id = a.district_id""")
def run_metadata(v: Views) -> DataFrame:
    return serve.run_metadata(v("f_verdict"), v("f_district"), v("f_finding"))


_VALUES = ["PASS", "FAIL", "INCOMPLETE", "RISK", "INSUFFICIENT_DATA", "SIGNAL", "NO_SIGNAL", "NOT_EVALUATED"]


@query(f"WITH {LATEST} SELECT condition_code, " + ", ".join(f"count(*) FILTER (value = '{x}') AS \"{x}\"" for x in _VALUES) + " FROM latest GROUP BY 1")
def condition_breakdown(v: Views) -> DataFrame:
    return serve.condition_breakdown(serve.latest_verdicts(v("f_verdict")))


@query(f"WITH {COMPOSED} SELECT CASE WHEN composition_color IN ('RED','ORANGE','GREEN') THEN composition_color ELSE 'NONE' END AS color, count(*) AS districts FROM composed GROUP BY 1")
def traffic_light_counts(v: Views) -> DataFrame:
    return serve.traffic_light_counts(composed(v))


@query(f"WITH {COMPOSED} SELECT l.district_id, " + ", ".join(f"max(value) FILTER (condition_code = '{c}') AS \"{c}\"" for c in T.CONDITIONS) + ", any_value(composition_color) AS composition_color, any_value(composition_reason) AS composition_reason FROM latest l JOIN composed c ON c.district_id = l.district_id GROUP BY 1")
def result_table(v: Views) -> DataFrame:
    return serve.result_table(serve.latest_verdicts(v("f_verdict")), composed(v))


@query(f"""WITH {LATEST}, a AS (SELECT l.district_id, count(*) FILTER (value = 'PASS') AS passed, count(*) FILTER (value = 'FAIL') AS failed, count(*) FILTER (value NOT IN ('PASS','FAIL')) AS others,
 string_agg(condition_code || '=' || value, ' ' ORDER BY {ORDER}) AS conditions FROM latest l JOIN f_district d ON d.district_id = l.district_id JOIN f_municipality m ON m.municipality_id = d.municipality_id GROUP BY 1),
 f AS (SELECT district_id, count(*) FILTER (status = 'open') AS open_findings FROM f_finding GROUP BY 1)
 SELECT coalesce(a.district_id, f.district_id) AS district_id, coalesce(passed, 0) AS passed, coalesce(failed, 0) AS failed, coalesce(others, 0) AS others, conditions, coalesce(open_findings, 0) AS open_findings FROM a FULL JOIN f ON f.district_id = a.district_id""")
def district_summaries(v: Views) -> DataFrame:
    return serve.district_summaries(card(v), v("f_finding"))


@query(f"""SELECT condition_code, severity, min(finding_id) AS finding_id, arg_min(district_id, finding_id) AS district_id, {MASK.format(c='arg_min(evidence_text, finding_id)', n=200)} AS sample FROM f_finding GROUP BY 1, 2""")
def explanation_worklist(v: Views) -> DataFrame:
    return serve.explanation_worklist(v("f_finding"), cap=None)


@query(f"SELECT condition_code, arg_max(evidence_text, {RANK} * 1000000000000 + finding_id) AS explanation FROM f_finding GROUP BY 1")
def explanation_per_condition(v: Views) -> DataFrame:
    return serve.explanation_per_condition(v("f_finding").withColumnRenamed("evidence_text", "explanation"))


@query("SELECT district_id, median(distance_m) AS median_m, max(distance_m) AS max_m, median(duration_s) AS median_s, max(duration_s) AS max_s, count(distance_m) AS sample_size, count(*) - count(distance_m) AS errors FROM f_route GROUP BY 1")
def route_stats(v: Views) -> DataFrame:
    return serve.route_stats(v("f_route"))


@query("""WITH r AS (SELECT district_id, median(distance_m) AS median_m FROM f_route GROUP BY 1), j AS (SELECT d.district_id, d.school_type, r.median_m, CASE WHEN school_type = 'MS' THEN 4000.0 ELSE 2000.0 END AS lim FROM f_district d LEFT JOIN r ON r.district_id = d.district_id)
 SELECT district_id, school_type, median_m, CASE WHEN median_m IS NULL THEN 'NO_DATA' WHEN median_m <= lim THEN 'PASS' WHEN median_m <= lim * 1.25 THEN 'RISK' ELSE 'FAIL' END AS status FROM j""")
def walking_status(v: Views) -> DataFrame:
    return serve.walking_status(v("f_route"), v("f_district"))


# --- scalar functions over whole tables


@query(f"SELECT doc_id, {MASK.format(c='text', n=500)} AS masked FROM documents")
def mask_pii(v: Views) -> DataFrame:
    return v("documents").select("doc_id", T.mask_pii("text", 500).alias("masked"))


@query(f"SELECT page_id, {HOST.format(c='url')} AS host, {ALLOWED.format(c='url')} AS allowed FROM pages")
def host_in_allowlist(v: Views) -> DataFrame:
    return v("pages").select("page_id", T.url_host("url").alias("host"), T.host_in_allowlist("url", HOSTS).alias("allowed"))


_SLUG = "translate({c}, 'áäčďéíĺľňóôŕšťúýž', 'aacdeillnoorstuyz')"


@query(f"SELECT street_id, regexp_replace({_SLUG.format(c='lower(street)')}, '[^a-z0-9]+', '-', 'g') AS slug, lower(regexp_replace({_SLUG.format(c='street')}, '[^a-z0-9]+', '-', 'g')) AS as_written FROM f_street")
def slug(v: Views) -> DataFrame:
    return v("f_street").select("street_id", T.slug("street").alias("slug"), T.slug("street", as_written=True).alias("as_written"))


@query("SELECT register_id, TRY_CAST(nullif(regexp_extract(orientacne_cislo, '^\\s*(\\d+)', 1), '') AS INT) AS house, TRY_CAST(nullif(regexp_replace(orientacne_cislo, '\\D', '', 'g'), '') AS INT) AS digits FROM f_register")
def house_int(v: Views) -> DataFrame:
    return v("f_register").select("register_id", T.house_int("orientacne_cislo").alias("house"), T.only_digits("orientacne_cislo").alias("digits"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS text_hash FROM documents")
def text_hash(v: Views) -> DataFrame:
    return v("documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))
