"""Registered queries over ordinance texts, table updates, geometry columns and small functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import geo as G, text as T
from ..operators import ordinance, spatial
from ..sources import io
from ..sources.shared import shared_dir
from .queries import CLEAN, STREETS, neat, norm_sql, query, streets
from .views import Views


def ordinance_texts(v: Views) -> DataFrame:
    """One ordinance per municipality, written from the street ranges: a block per district, an entry per range."""
    q = (
        F.when(F.col("range_type") == "odd", F.concat(F.lit("nepárne čísla "), "lo", F.lit(" – "), "hi")).when(F.col("range_type") == "even", F.concat(F.lit("párne čísla od "), "lo", F.lit(" – "), "hi"))
        .when(F.col("range_type") == "range", F.concat(F.lit("čísla "), "lo", F.lit(" – "), "hi")).when(F.col("range_type") == "single", F.concat(F.lit("číslo "), "lo"))
    )
    entry = F.concat("street", F.coalesce(F.concat(F.lit(" ("), q, F.lit(")")), F.lit("")))
    per = v("f_street_range").withColumn("e", entry).groupBy("district_id").agg(F.array_join(F.array_sort(F.collect_list("e")), ", ").alias("s"))
    d = v("f_district").select("district_id", "municipality_id")
    block = F.concat(F.col("district_id").cast("string"), F.lit(". Základná škola č. "), F.col("district_id").cast("string"), F.lit(", Ulica 1:\n"), "s", F.lit("\nObec: Horná (ulica: Malá), Dolná; Stredná"))
    return per.join(d, "district_id").withColumn("b", block).groupBy(F.col("municipality_id").alias("vzn_id")).agg(F.concat(F.lit("Úvod\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("district_id", "b"))), lambda x: x["b"]), "\n")).alias("raw_text"))


@query("SELECT d.municipality_id AS vzn_id, CAST(d.district_id AS INT) AS number, 'Základná škola č. ' || d.district_id AS school_name, 'Ulica 1' AS address, 'Horná|Dolná|Stredná' AS shared, count(*) AS entries FROM f_street_range r JOIN f_district d ON d.district_id = r.district_id GROUP BY d.municipality_id, d.district_id")
def ordinance_blocks(v: Views) -> DataFrame:
    blocks = ordinance.ordinance_blocks(ordinance_texts(v))
    return blocks.select("vzn_id", "number", "school_name", "address", F.array_join("municipalities", "|").alias("shared"), F.size(T.split_outside_parens("streets_text")).cast("long").alias("entries"))


@query("SELECT CAST(district_id AS INT) AS number, trim(street) AS street, CASE range_type WHEN 'odd' THEN 'nepárne čísla ' || lo || ' – ' || hi WHEN 'even' THEN 'párne čísla od ' || lo || ' – ' || hi WHEN 'range' THEN 'čísla ' || lo || ' – ' || hi WHEN 'single' THEN 'číslo ' || lo END AS qualifier FROM f_street_range")
def street_entries(v: Views) -> DataFrame:
    return ordinance.street_entries(ordinance.ordinance_blocks(ordinance_texts(v))).select("number", "street", "qualifier")


@query("SELECT CAST(district_id AS INT) AS number, trim(street) AS street, range_type, CASE range_type WHEN 'all' THEN '' WHEN 'single' THEN CAST(lo AS VARCHAR) ELSE lo || ',' || hi END AS numbers FROM f_street_range")
def street_ranges(v: Views) -> DataFrame:
    ranges = ordinance.street_ranges(ordinance.street_entries(ordinance.ordinance_blocks(ordinance_texts(v))))
    return ranges.select("number", "street", "range_type", F.array_join(F.transform("numbers", lambda x: x.cast("string")), ",").alias("numbers"))


@query()
def classify_streets(v: Views) -> DataFrame:
    o = v("f_street_range").join(v("f_district").select("district_id", "municipality_id"), "district_id").select("municipality_id", "street")
    return ordinance.classify_streets(o, v("f_register").select("municipality_id", "ulica"), nearest=True)


@query(f"""WITH {CLEAN}, {STREETS}, k AS (SELECT DISTINCT municipality_id, ulica_norm FROM clean), m AS (SELECT s.district_id, k.ulica_norm IS NOT NULL AS ok FROM streets s LEFT JOIN k ON k.municipality_id = s.municipality_id AND k.ulica_norm = s.street_norm),
 p AS (SELECT district_id, count(*) AS streets, count(*) FILTER (ok) AS resolved FROM m GROUP BY 1)
 SELECT *, CASE WHEN resolved = 0 THEN 'none' WHEN resolved > 0.9 * streets THEN 'high' WHEN resolved > 0.6 * streets THEN 'medium' ELSE 'low' END AS confidence FROM p""")
def geometry_confidence(v: Views) -> DataFrame:
    known = neat(v).select("municipality_id", F.col("ulica_norm").alias("street_norm")).distinct().withColumn("resolved", F.lit(True))
    return ordinance.geometry_confidence(streets(v).join(known, ["municipality_id", "street_norm"], "left").select("district_id", "street_norm", F.coalesce("resolved", F.lit(False)).alias("resolved")))


# --- updates


@query("""WITH o AS (SELECT finding_id, status, severity FROM f_finding WHERE NOT is_demo), n AS (SELECT finding_id, 'closed' AS status, 'x' AS tag FROM f_finding WHERE condition_code = 'S1')
 SELECT coalesce(n.finding_id, o.finding_id) AS finding_id, CASE WHEN n.finding_id IS NOT NULL THEN n.status ELSE o.status END AS status, o.severity, n.tag FROM o FULL JOIN n ON n.finding_id = o.finding_id""")
def upsert(v: Views) -> DataFrame:
    f = v("f_finding")
    incoming = f.filter("condition_code = 'S1'").select("finding_id", F.lit("closed").alias("status"), F.lit("x").alias("tag"))
    return io.upsert(f.filter("not is_demo").select("finding_id", "status", "severity"), incoming, ["finding_id"])


@query("SELECT finding_id, district_id, status FROM f_finding WHERE NOT is_demo UNION ALL SELECT finding_id + 10000000, district_id, 'open' FROM f_finding WHERE is_demo AND condition_code = 'S2'")
def replace_partition(v: Views) -> DataFrame:
    f = v("f_finding").select("finding_id", "district_id", "status", "is_demo", "condition_code")
    new = f.filter("is_demo and condition_code = 'S2'").select((F.col("finding_id") + 10000000).alias("finding_id"), "district_id", F.lit("open").alias("status"))
    return io.replace_partition(f, new.withColumn("is_demo", F.lit(True)).withColumn("condition_code", F.lit("S2")), F.col("is_demo")).select("finding_id", "district_id", "status")


# findings of municipality 1 come anew, those of municipality 2 go, the others stay in the files that hold them
@query("""WITH f AS (SELECT f.finding_id, f.status, d.municipality_id FROM f_finding f JOIN f_district d ON d.district_id = f.district_id)
 SELECT finding_id, CASE WHEN municipality_id = 1 THEN 'closed' ELSE status END AS status, municipality_id FROM f WHERE municipality_id <> 2 AND NOT (municipality_id = 1 AND finding_id % 2 = 0)""")
def overwrite_partitions(v: Views) -> DataFrame:
    f = v("f_finding").join(v("f_district").select("district_id", "municipality_id"), "district_id").select("finding_id", "status", "municipality_id")
    path = shared_dir(v.spark)
    io.write_partitions(f, path, ["municipality_id"])
    new = f.filter("municipality_id = 1 and finding_id % 2 = 1").withColumn("status", F.lit("closed"))
    for _ in range(2):  # a second run changes nothing
        io.overwrite_partitions(new, path, ["municipality_id"], v.spark.sql("SELECT explode(array(1L, 2L)) AS municipality_id"))
    return v.spark.read.schema("finding_id long, status string, municipality_id long").parquet(path)


@query("SELECT doc_id FROM documents WHERE lang <> 'en' OR lang IS NULL OR text IS NULL")
def changed_texts(v: Views) -> DataFrame:
    d = v("documents")
    old = d.select("doc_id", F.when(F.col("lang") == "en", F.sha2("text", 256)).otherwise("other").alias("hash"))
    return io.changed_texts(old, d.select("doc_id", F.col("text").alias("raw_text")), ["doc_id"]).select("doc_id")


@query("SELECT work.register_id FROM f_register work WHERE NOT EXISTS (SELECT 1 FROM f_address a WHERE a.address_id = work.register_id AND a.municipality_id = work.municipality_id)")
def pending(v: Views) -> DataFrame:
    from ..operators import assign

    done = v("f_address").select(F.col("address_id").alias("register_id"), "municipality_id")
    return assign.pending(v("f_register"), done, ["register_id", "municipality_id"]).select("register_id")


# --- geometry columns


@query("SELECT district_id, (x1 - x0) * (y1 - y0) AS area, 2 * ((x1 - x0) + (y1 - y0)) AS outline, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, CAST(2 * ceil((x1 - x0) / 60) + 2 * ceil((y1 - y0) / 60) + 1 AS BIGINT) AS points FROM f_district")
def geometry_columns(v: Views) -> DataFrame:
    ring = F.col("rings")[0]["pts"]
    return spatial.box_polygons(v("f_district")).select(
        "district_id", G.area_m2(F.col("rings")).alias("area"), G.length_m(ring).alias("outline"), G.centroid(ring)["x"].alias("cx"), G.centroid(ring)["y"].alias("cy"), F.size(G.segmentize(ring, 60.0)).cast("long").alias("points")
    )


@query("SELECT address_id, floor(2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(y / 100000 - 0.1) / 2), 2) + cos(radians(49.0)) * cos(radians(48.9 + y / 100000)) * pow(sin(radians(x / 100000) / 2), 2))))) AS metres FROM f_address")
def haversine(v: Views) -> DataFrame:
    lon, lat = 21.0 + F.col("x") / 100000, 48.9 + F.col("y") / 100000
    return v("f_address").select("address_id", F.floor(G.haversine_m(F.lit(21.0), F.lit(49.0), lon, lat)).cast("double").alias("metres"))


@query("SELECT event_id, date_trunc('week', CAST(ts AS TIMESTAMP)) + INTERVAL 7 DAY + INTERVAL 330 MINUTE AS next_at FROM events")
def next_monday(v: Views) -> DataFrame:
    return v("events").select("event_id", G.next_monday_0530("ts").alias("next_at"))


@query("SELECT DISTINCT condition_code, severity, value FROM (SELECT f.condition_code, f.severity, v.value FROM f_finding f JOIN f_verdict v ON v.verdict_id = f.verdict_id) t")
def severity_of(v: Views) -> DataFrame:
    return v("f_verdict").filter("value <> 'PASS'").select("condition_code", T.severity_of("value").alias("severity"), "value").distinct()


@query("SELECT conv_id, turn, json_object('role', role, 'turn', turn)::VARCHAR AS merged, role AS back FROM conversations")
def json_functions(v: Views) -> DataFrame:
    merged = F.to_json(F.struct("role", "turn"))
    return v("conversations").select("conv_id", "turn", merged.alias("merged")).withColumn("back", T.json_text("merged", "role"))
