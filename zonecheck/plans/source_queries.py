"""Registered queries over sources: files written from the tables to the shared folder, then read by the readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import spatial
from ..sources import io
from ..sources.shared import shared_dir
from .queries import query
from .views import Views

#: Records of a written file.
PER_FILE = 5000


def _file_texts(rows: DataFrame, key: str, record: Column, around: tuple[str, str], total: bool = False) -> str:
    """Writes JSON files of PER_FILE records each, an array between two texts, and returns their folder; with ``total`` the records' number comes first."""
    path = shared_dir(rows.sparkSession)
    files = rows.select(F.floor(F.col(key) / PER_FILE).alias("file"), record.alias("r")).groupBy("file").agg(F.array_join(F.collect_list("r"), ",").alias("body"), F.count("*").cast("string").alias("n"))
    parts = [F.lit(around[0]), *([F.col("n"), F.lit(',"features":[')] if total else []), F.col("body"), F.lit(around[1])]
    files.select(F.concat(*parts).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def _collection(rows: DataFrame, key: str, properties: Column, x: str = "x", y: str = "y") -> str:
    """Feature collections of points."""
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates")).alias("geometry")))
    return _file_texts(rows, key, feature, ('{"type":"FeatureCollection","totalFeatures":', "]}"), total=True)


@query(f"SELECT address_id, 'Point' AS geometry_type, x, y, count(*) OVER (PARTITION BY floor(address_id / {PER_FILE})) AS total FROM f_address")
def read_features(v: Views) -> DataFrame:
    a = v("f_address")
    got = io.read_features(v.spark, _collection(a, "address_id", F.struct(F.col("address_id").cast("string").alias("id"))))
    at = F.from_json("coordinates", "array<double>")
    return got.select(F.col("properties")["id"].cast("long").alias("address_id"), "geometry_type", at[0].alias("x"), at[1].alias("y"), "total")


@query("SELECT 'U ' || (address_id % 97) AS street, CAST(address_id % 50 AS VARCHAR) AS house_number, CASE WHEN address_id % 3 = 0 THEN NULL ELSE '08001' END AS postal_code, x AS lon, y AS lat FROM f_address WHERE x <> 0 AND y <> 0")
def read_address_features(v: Views) -> DataFrame:
    a = v("f_address")
    # a third has the street under another of its names, and an empty postal code
    odd, name = F.col("address_id") % 3 == 0, F.concat(F.lit("U "), (F.col("address_id") % 97).cast("string"))
    properties = F.struct(F.when(odd, name).alias("street_name"), F.when(~odd, name).alias("ulica"), (F.col("address_id") % 50).cast("string").alias("cislo"), F.when(odd, "").otherwise("08001").alias("psc"))
    return io.read_address_features(v.spark, _collection(a, "address_id", properties))


@query("SELECT 'U ' || (address_id % 97) AS street, CAST(address_id % 50 AS VARCHAR) AS house_number, CASE WHEN address_id % 3 = 0 THEN NULL ELSE '08001' END AS postal_code, x AS lon, y AS lat FROM f_address WHERE address_id % 11 <> 0")
def read_address_points(v: Views) -> DataFrame:
    comma = lambda c: F.regexp_replace(F.col(c).cast("string"), "[.]", ",")
    rows = v("f_address").select(
        F.concat(F.lit(" U "), (F.col("address_id") % 97).cast("string")).alias("Ulica"), (F.col("address_id") % 50).alias("cislo"), F.when(F.col("address_id") % 3 != 0, "08001").alias("PSC"),
        comma("y").alias("gps_lat"), F.when(F.col("address_id") % 11 == 0, "0,0").otherwise(comma("x")).alias("gps_lon"),
    )
    path = shared_dir(v.spark)
    rows.write.option("header", True).option("sep", ";").csv(path)
    return io.read_address_points(v.spark, path, sep=";")


def _register_files(v: Views) -> str:
    r = v("f_register")
    shown = lambda c: F.when(F.col(c), "Áno").when(~F.col(c), "Nie")
    named = {"Mesto": F.concat(F.lit(" Mesto "), F.col("municipality_id").cast("string")), "Ulica": F.col("ulica"), "Súp._č.": F.col("supisne_cislo"), "Orient._č.": F.col("orientacne_cislo"), "Obývateľná": shown("obyvatelna"), "Vyrad.": shown("vyradena"), "Popis": F.lit("  "), "Index_domu": F.col("register_id").cast("string")}
    return _file_texts(r, "register_id", F.to_json(F.struct(*[c.alias(k) for k, c in named.items()])), ("[", "]"))


@query("SELECT register_id, 'Mesto ' || municipality_id AS mesto, nullif(trim(ulica), '') AS ulica, nullif(trim(supisne_cislo), '') AS supisne_cislo, nullif(trim(orientacne_cislo), '') AS orientacne_cislo, obyvatelna, vyradena, CAST(NULL AS VARCHAR) AS popis, true AS has_raw FROM f_register")
def read_register(v: Views) -> DataFrame:
    got = io.read_register(v.spark, _register_files(v))
    return got.select(F.col("index_domu").cast("long").alias("register_id"), "mesto", "ulica", "supisne_cislo", "orientacne_cislo", "obyvatelna", "vyradena", "popis", (F.get_json_object("raw", "$.Index_domu") == F.col("index_domu")).alias("has_raw"))


@query("SELECT municipality_id, count(*) AS n, count(DISTINCT register_id) AS ids, (SELECT count(*) FROM f_register) AS loaded FROM f_register GROUP BY 1")
def reload(v: Views) -> DataFrame:
    path = shared_dir(v.spark)
    loaded = io.reload(v("f_register"), path)
    return v.spark.read.parquet(path).groupBy("municipality_id").agg(F.count("*").alias("n"), F.count_distinct("register_id").alias("ids")).withColumn("loaded", F.lit(loaded).cast("long"))


@query("""WITH m AS (SELECT 'register' AS key, count(*) AS n, (count(ulica) + count(orientacne_cislo) + count(obyvatelna)) / (3 * count(*)) AS f, count(*) FILTER (obyvatelna AND NOT vyradena) / count(*) AS v FROM f_register
 UNION ALL SELECT 'districts', count(*), (count(school_id) + count(geometry_confidence)) / (2 * count(*)), count(*) FILTER (geometry_confidence = 'high') / count(*) FROM f_district)
 SELECT key, n, CAST(greatest(1, ceil(f * 10)) AS INT) AS completeness, CAST(greatest(1, ceil(v * 10)) AS INT) AS validity, 'v1' AS version FROM m""")
def catalogue(v: Views) -> DataFrame:
    a = io.measured(v("f_register"), "register", ["ulica", "orientacne_cislo", "obyvatelna"], F.col("obyvatelna") & ~F.col("vyradena"), "v1")
    return a.unionByName(io.measured(v("f_district"), "districts", ["school_id", "geometry_confidence"], F.col("geometry_confidence") == "high", "v1"))


@query("""SELECT school_id, type, 'atlas' AS source, DATE '2024-09-01' AS source_date, 7 AS source_quality, '{"source":"atlas","source_date":"2024-09-01","source_quality":7}' AS provenance FROM f_school""")
def with_provenance(v: Views) -> DataFrame:
    return io.with_provenance(v("f_school").select("school_id", "type"), "atlas", "2024-09-01", 7)


@query("""SELECT district_id, '{"type":"Polygon","coordinates":[[[' || concat_ws('],[', x0 || ',' || y0, x1 || ',' || y0, x1 || ',' || y1, x0 || ',' || y1, x0 || ',' || y0) || ']]]}' AS geojson FROM f_district""")
def to_geojson(v: Views) -> DataFrame:
    return spatial.box_polygons(v("f_district")).select("district_id", io.to_geojson("rings").alias("geojson"))
