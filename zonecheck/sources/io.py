"""Sources, sinks and table updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

# Names under which address files have their columns.
LAT = ["lat", "latitude", "gps_lat", "y", "SUP_SURAD_Y"]
LON = ["lon", "lng", "longitude", "gps_lon", "x", "SUP_SURAD_X"]
STREET = ["street", "ulica", "street_name", "nazov_ulice"]
HOUSE = ["house_number", "cislo", "orientacne_cislo", "number"]
POSTAL = ["postal_code", "psc", "zip"]

_GEOMETRY = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(properties, geometry_type, coordinates, total) of each feature of GeoJSON feature collections: properties as a map of strings, coordinates as JSON text.

    A file of another type is an error; total is the file's own number of features, to be held against the rows read.
    """
    feature = T.StructType([T.StructField("properties", T.MapType(T.StringType(), T.StringType())), T.StructField("geometry", _GEOMETRY)])
    schema = T.StructType([T.StructField("type", T.StringType()), T.StructField("totalFeatures", T.LongType()), T.StructField("features", T.ArrayType(feature))])
    files = spark.read.schema(schema).option("multiLine", True).json(path)
    checked = files.withColumn("features", F.when(F.col("type") == "FeatureCollection", F.col("features")).otherwise(F.raise_error(F.concat(F.lit("no FeatureCollection but "), F.coalesce("type", F.lit("nothing")))).cast(schema["features"].dataType)))
    return checked.select(F.col("totalFeatures").alias("total"), F.explode("features").alias("f")).select("f.properties", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"), "total")


def _first(df: DataFrame, names: list[str]) -> Column:
    known = {c.lower(): c for c in df.columns}
    found = [F.nullif(F.trim(F.col(f"`{known[n.lower()]}`").cast("string")), F.lit("")) for n in names if n.lower() in known]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _number(c: Column) -> Column:
    return F.regexp_replace(c, ",", ".").try_cast("double")


def read_address_points(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(street, house_number, postal_code, lon, lat) of a CSV file under any of the usual column names; decimal commas are read, rows without coordinates or with a zero one are left out."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    out = raw.select(_first(raw, STREET).alias("street"), _first(raw, HOUSE).alias("house_number"), _first(raw, POSTAL).alias("postal_code"), _number(_first(raw, LON)).alias("lon"), _number(_first(raw, LAT)).alias("lat"))
    return out.filter((F.col("lon") != 0) & (F.col("lat") != 0))


def read_address_features(spark: SparkSession, path: str) -> DataFrame:
    """The same of GeoJSON points."""
    points = read_features(spark, path).filter("geometry_type = 'Point'").withColumn("c", F.from_json("coordinates", "array<double>"))
    of = lambda names: F.coalesce(*[F.nullif(F.trim(F.col("properties")[n]), F.lit("")) for n in names])
    return points.select(of(STREET).alias("street"), of(HOUSE).alias("house_number"), of(POSTAL).alias("postal_code"), F.get("c", 0).alias("lon"), F.get("c", 1).alias("lat")).filter((F.col("lon") != 0) & (F.col("lat") != 0))


# Keys of the register's JSON and the columns they become.
REGISTER = {
    "Mesto": "mesto", "Časť_mesta": "cast_mesta", "Ulica": "ulica", "Súp._č.": "supisne_cislo", "Orient._č.": "orientacne_cislo", "Adresa": "adresa",
    "PSČ": "psc", "Obývateľná": "obyvatelna", "Vyrad.": "vyradena", "Mestská_oblasť": "mestska_oblast", "Popis": "popis", "Index_domu": "index_domu",
}


def yes_no(c: Column) -> Column:
    """True for Áno, false for Nie, else null."""
    low = F.lower(F.trim(c))
    return F.when(low == "áno", True).when(low == "nie", False)


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """The register's rows with trimmed texts ('' is null), yes and no as booleans, and the record itself as JSON in ``raw``."""
    schema = T.StructType([T.StructField(k, T.StringType()) for k in REGISTER])
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    text = lambda k: F.nullif(F.trim(F.col(f"`{k}`")), F.lit(""))
    return raw.select(*[(yes_no(F.col(f"`{k}`")) if name in ("obyvatelna", "vyradena") else text(k)).alias(name) for k, name in REGISTER.items()], F.to_json(F.struct(*[F.col(f"`{k}`") for k in REGISTER])).alias("raw"))


def reload(df: DataFrame, path: str) -> int:
    """Replaces the table at ``path`` by ``df`` and returns its rows; a count that differs from the source's is an error."""
    expected = df.count()
    df.write.mode("overwrite").parquet(path)
    found = df.sparkSession.read.parquet(path).count()
    if found != expected:
        raise ValueError(f"{path} has {found} rows of {expected}")
    return found


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by business key, incoming ones in place of existing ones; of incoming rows with one key any one, the largest, stays.

    Columns that either side lacks are null there, but an existing row keeps its values in columns that the incoming
    side does not have. If the incoming side has only keys, existing rows stay as they are.
    """
    new = incoming.groupBy(*keys).agg(F.max(F.struct(F.lit(1).alias("__in"), *[c for c in incoming.columns if c not in keys])).alias("__n"))
    old = existing.withColumn("__e", F.struct(F.lit(1).alias("__in"), *[c for c in existing.columns if c not in keys])).select(*keys, "__e")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    both = old.alias("o").join(new.alias("n"), on, "full")
    names = [c for c in dict.fromkeys([*existing.columns, *incoming.columns]) if c not in keys]
    has_new = F.col("n.__n").isNotNull()

    def value(c: str) -> Column:
        if c in incoming.columns and c in existing.columns:
            return F.when(has_new, F.col(f"n.__n.{c}")).otherwise(F.col(f"o.__e.{c}"))
        return F.col(f"n.__n.{c}") if c in incoming.columns else F.col(f"o.__e.{c}")

    key = lambda k: F.when(has_new, F.col(f"n.{k}")).otherwise(F.col(f"o.{k}"))
    return both.select(*[key(k).alias(k) for k in keys], *[value(c).alias(c) for c in names])


def replace_partition(existing: DataFrame, incoming: DataFrame, predicate: Column) -> DataFrame:
    """``existing`` without the rows of the partition, with the new ones."""
    return existing.filter(~F.coalesce(predicate, F.lit(False))).unionByName(incoming, allowMissingColumns=True)


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Writes a table with a folder for each value of ``by``; what stood at ``path`` goes."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*by).parquet(path)


def overwrite_partitions(incoming: DataFrame, path: str, by: list[str], emptied: DataFrame | None = None) -> None:
    """Replaces the partitions of the table at ``path`` that ``incoming`` has rows of; no other file is touched, and running it again changes nothing.

    ``emptied`` (the columns of ``by``) names further partitions to replace, which are deleted where nothing comes in.
    ``incoming`` must not read from the same table; its rows of a partition are all that the partition then holds.
    """
    incoming.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    if emptied is None:
        return
    jvm = incoming.sparkSession._jvm
    name = lambda r: "/".join(f"{c}={'__HIVE_DEFAULT_PARTITION__' if r[c] is None else r[c]}" for c in by)
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(incoming.sparkSession._jsc.hadoopConfiguration())
    for r in emptied.select(*by).distinct().join(incoming.select(*by).distinct(), by, "left_anti").toLocalIterator():
        folder = jvm.org.apache.hadoop.fs.Path(root, name(r))
        if files.exists(folder):
            files.delete(folder, True)


def catalogue(spark: SparkSession, key: str, completeness: int, validity: int, version: str, status: str) -> DataFrame:
    """A row of the data catalogue."""
    return spark.range(1).select(F.lit(key).alias("key"), F.lit(completeness).alias("completeness"), F.lit(validity).alias("validity"), F.lit(version).alias("version"), F.current_timestamp().alias("fetched_at"), F.lit(status).alias("status"))


def measured(df: DataFrame, key: str, required: list[str], valid: Column, version: str) -> DataFrame:
    """A row of the data catalogue with completeness and validity from 1 to 10: the share of ``required`` fields that are filled, and of rows that are ``valid``. An empty table has 1 and 1."""
    mark = lambda share: F.greatest(F.lit(1), F.ceil(F.coalesce(share, F.lit(0.0)) * 10)).cast("int")
    filled = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in required), F.lit(0))
    one = df.agg(F.count("*").alias("n"), F.sum(filled).alias("f"), F.count_if(F.coalesce(valid, F.lit(False))).alias("v"))
    return one.select(F.lit(key).alias("key"), "n", mark(F.try_divide("f", F.col("n") * len(required))).alias("completeness"), mark(F.try_divide("v", "n")).alias("validity"), F.lit(version).alias("version"))


def with_provenance(df: DataFrame, source: str, date: str, quality: int) -> DataFrame:
    """Adds source columns and the same as a JSON text."""
    named = {"source": F.lit(source), "source_date": F.lit(date).cast("date"), "source_quality": F.lit(quality)}
    return df.withColumns(named).withColumn("provenance", F.to_json(F.struct(*named)))


def to_geojson(rings: Column | str) -> Column:
    """A polygon's rings as GeoJSON text: its parts in order, each an outer ring and its holes."""
    point = lambda p: F.array(p["x"], p["y"])
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.transform(rings, lambda r: F.transform(r["pts"], point)).alias("coordinates")))


def changed_texts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` (keys, raw_text) whose text is new or has another SHA-256 than before (keys, hash)."""
    hashed = new.withColumn("hash", F.sha2("raw_text", 256))
    before = old.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("hash").alias("__hash"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return hashed.join(before, [*on, F.col("hash") == F.col("__hash")], "left_anti")


def latest_only(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).filter("__n = 1").drop("__n")
