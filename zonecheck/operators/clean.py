"""Cleaning, filters, validation and deduplication of registers, schools and geocodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geo as G, text as T
from ..sources.shared import stored
from .assign import contained

# Kinds of school by the words in a free text, the first that occurs wins; the order keeps ZS_SPECIAL out of reach.
SCHOOL_KINDS = [("základná škola", "ZS"), ("materská škola", "MS"), ("základná umelecká", "ZUS"), ("špeciálna základná škola", "ZS_SPECIAL")]


def school_type(c: Column | str) -> Column:
    out = F.lit("OTHER")
    for words, kind in reversed(SCHOOL_KINDS):
        out = F.when(F.lower(T._col(c)).contains(words), F.lit(kind)).otherwise(out)
    return out


def is_public(c: Column | str) -> Column:
    """False for private and church schools; null and '' are public."""
    return F.coalesce(~F.lower(T._col(c)).rlike("súkromn|cirkev"), F.lit(True))


def load_schools(features: DataFrame, municipalities: DataFrame) -> DataFrame:
    """Schools of a known kind in a known municipality (features: code, type_text, language; municipalities: code, municipality_id)."""
    kinds = features.withColumn("type", school_type("type_text")).filter(F.col("type") != "OTHER")
    language = F.left(F.upper(F.coalesce("language", F.lit("SK"))), F.lit(5))
    return kinds.join(municipalities.select("code", "municipality_id"), "code").withColumn("teaching_language", language)


def filter_school_types(schools: DataFrame, types: tuple[str, ...] = ("ZS", "MS")) -> DataFrame:
    """(type, before, after, deleted) counts of keeping only ``types``."""
    return schools.groupBy("type").agg(F.count("*").alias("before"), F.count_if(F.col("type").isin(*types)).alias("after")).withColumn("deleted", F.col("before") - F.col("after"))


def community_category(df: DataFrame, municipalities: DataFrame, count: str = "population") -> DataFrame:
    """Adds category by size, and the municipality by code where known."""
    n = F.col(count)
    kind = F.when(n > 500, "large").when(n > 100, "medium").when(n > 0, "small").otherwise("unknown")
    return df.withColumn("category", kind).join(municipalities.select("code", "municipality_id"), "code", "left")


def children_latest(df: DataFrame, municipalities: DataFrame) -> DataFrame:
    """Children per municipality (code: the last six characters of ``nuts``): the last count or, if null or 0, that of 2020; year: the latest with a count."""
    years = [c for c in df.columns if c.startswith("y") and c[1:].isdigit()]
    value = F.coalesce(F.nullif(F.col("last"), F.lit(0)), F.col("y2020"))
    year = F.greatest(*[F.when(F.col(y).isNotNull(), F.lit(int(y[1:]))) for y in years], F.lit(None).cast("int"))
    coded = df.withColumn("code", F.right(F.col("nuts"), F.lit(6)))
    return coded.join(municipalities.select("code", "municipality_id"), "code").select("code", "municipality_id", value.alias("children"), year.alias("year"))


def named_streets(ways: DataFrame, bbox: tuple[float, float, float, float]) -> DataFrame:
    """(name_key, ways): named ways that are roads and meet the box, by lower-case name. ``ways`` has id, tags, pts."""
    # Kinds of way for walking only.
    walks = ["footway", "path", "steps", "cycleway", "pedestrian"]
    kept = ways.filter(F.col("tags")["name"].isNotNull() & F.col("tags")["highway"].isNotNull() & ~F.col("tags")["highway"].isin(walks) & _meets("pts", bbox))
    return kept.groupBy(F.lower(F.col("tags")["name"]).alias("name_key")).agg(F.array_sort(F.collect_list("id")).alias("ways"))


def address_buildings(ways: DataFrame, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Buildings with a street in the box, with the mean of their points."""
    kept = ways.filter(F.col("tags")["building"].isNotNull() & F.col("tags")["addr:street"].isNotNull() & _meets("pts", bbox))
    mean = lambda a: F.aggregate("pts", F.lit(0.0), lambda s, p: s + p[a]) / F.size("pts")
    return kept.select("id", F.col("tags")["addr:street"].alias("street"), F.col("tags")["addr:housenumber"].alias("house_number"), mean("x").alias("x"), mean("y").alias("y"))


def _meets(points: str, bbox: tuple[float, float, float, float]) -> Column:
    low = lambda a: F.array_min(F.transform(points, lambda p: p[a]))
    high = lambda a: F.array_max(F.transform(points, lambda p: p[a]))
    x0, y0, x1, y1 = bbox
    return (high("x") >= x0) & (low("x") <= x1) & (high("y") >= y0) & (low("y") <= y1)


def scope_filter(points: DataFrame, targets: DataFrame) -> DataFrame:
    """Points whose municipality is a target (code, name) by code or by equal or contained lower-case name.

    Each distinct name of the points is compared with the targets' names that share their rarest trigram with it; points
    then meet codes and names by equality.
    """
    name = F.lower("municipality_name")
    wanted = targets.select(F.lower("name").alias("x")).distinct()
    found = contained(wanted, stored(points.select(name.alias("y")).filter("y is not null").distinct())).select(F.col("y").alias("__name"), F.lit(True).alias("__named")).distinct()
    codes = targets.select(F.col("code").alias("__code"), F.lit(True).alias("__coded")).distinct()
    met = points.withColumns({"__code": F.col("municipality_code"), "__name": name}).join(codes, "__code", "left").join(found, "__name", "left")
    return met.filter("__coded or __named").select(*points.columns)


def validate_required(df: DataFrame, fields: list[str], key: str) -> DataFrame:
    """(key, field, severity): a row for each required field that is missing or empty."""
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == ""), F.lit(f)) for f in fields]))
    return df.select(F.col(key), F.explode(missing).alias("field"), F.lit("error").alias("severity"))


def validate_domain(df: DataFrame, domains: dict[str, list[str]], key: str) -> DataFrame:
    """(key, field, value, severity): a warning for each value out of its domain; null passes."""
    odd = F.array_compact(F.array(*[F.when(~F.col(f).isin(d), F.struct(F.lit(f).alias("field"), F.col(f).alias("value"))) for f, d in domains.items()]))
    return df.select(F.col(key), F.explode(odd).alias("x")).select(key, "x.field", "x.value", F.lit("warning").alias("severity"))


def house_from_address(c: Column | str) -> Column:
    """The house number in a formatted address, without postal code, town and quarter; none: null. What follows the first comma does not count, so the patterns see the street alone."""
    street = F.substring_index(T._col(c), ",", 1)
    return F.nullif(F.regexp_extract(F.trim(F.regexp_replace(street, r"\s*\d{3}\s*\d{2}\s+.*$", "")), r"[/ ](\d+)\s*$", 1), F.lit(""))


def validate_geocodes(geocodes: DataFrame) -> DataFrame:
    """Adds found_house, valid and validation_reason (null where valid)."""
    found = F.col("found_house")
    reason = (
        F.when(F.col("status").isNull() | (F.col("status") != "OK"), F.concat(F.lit("status_"), F.lower(F.coalesce("status", F.lit("none")))))
        .when(found.isNull() & F.col("partial_match"), "partial_match_off_target")
        .when(found.isNull(), "no_house_in_formatted_address")
        .when(~found.eqNullSafe(F.col("house_number")), "house_number_mismatch")
    )
    return geocodes.withColumn("found_house", house_from_address("formatted_address")).withColumn("validation_reason", reason).withColumn("valid", F.col("validation_reason").isNull())


def house_dots(geocodes: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Houses to be shown: those with coordinates that were not found invalid (null counts as valid)."""
    return geocodes.filter(F.coalesce("valid", F.lit(True)) & F.col(lon).isNotNull() & F.col(lat).isNotNull())


def school_markers(schools: DataFrame, founders: DataFrame) -> DataFrame:
    """Schools with a point, and their founder's name and type where known."""
    named = founders.select("founder_id", F.col("name").alias("founder_name"), F.col("type").alias("founder_type"))
    return schools.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).join(named, "founder_id", "left")


def mismatch_points(mismatches: DataFrame, points: DataFrame) -> DataFrame:
    """Mismatched addresses that have coordinates, with them."""
    return mismatches.join(points.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).select("address_id", "x", "y"), "address_id")


def clean_register(register: DataFrame) -> DataFrame:
    """Habitable, not withdrawn rows with a street key, without duplicates: of rows with the same municipality, key and numbers the lowest id stays; nulls are equal."""
    fine = register.filter((F.col("obyvatelna") == True) & ~F.col("vyradena").eqNullSafe(True)).withColumn("ulica_norm", T.norm_street("ulica")).filter(F.coalesce("ulica_norm", F.lit("")) != "")  # noqa: E712
    return dedup_register(fine.withColumn("supisne_cislo", F.trim("supisne_cislo")).withColumn("orientacne_cislo", F.trim("orientacne_cislo")))


def dedup_register(register: DataFrame) -> DataFrame:
    """One row, with the lowest id, per municipality, street key and numbers; combined before the shuffle."""
    keys = ["municipality_id", "ulica_norm", "supisne_cislo", "orientacne_cislo"]
    rest = [c for c in register.columns if c not in keys and c != "register_id"]
    best = register.groupBy(*keys).agg(F.min(F.struct("register_id", *rest)).alias("b"))
    return best.select("b.register_id", *keys, *[F.col(f"b.{c}").alias(c) for c in rest])


def clean_report(register: DataFrame, clean: DataFrame) -> DataFrame:
    """(municipality_id, total, not_habitable, withdrawn, empty_street, kept, duplicates)."""
    habitable = F.coalesce(F.col("obyvatelna"), F.lit(False))
    withdrawn = F.coalesce(F.col("vyradena"), F.lit(False))
    empty = F.coalesce(T.norm_street("ulica"), F.lit("")) == ""
    counts = register.groupBy("municipality_id").agg(
        F.count("*").alias("total"), F.count_if(~habitable).alias("not_habitable"), F.count_if(habitable & withdrawn).alias("withdrawn"),
        F.count_if(habitable & ~withdrawn & empty).alias("empty_street"), F.count_if(habitable & ~withdrawn & ~empty).alias("eligible"),
    )
    kept = clean.groupBy("municipality_id").agg(F.count("*").alias("kept"))
    both = counts.join(kept, "municipality_id", "left").withColumn("kept", F.coalesce("kept", F.lit(0)).cast("long"))
    return both.withColumn("duplicates", F.col("eligible") - F.col("kept")).drop("eligible")


def street_anchors(clean: DataFrame) -> DataFrame:
    """One address per municipality and street: the lowest orientation number, by its digits (none last), then as text, then by id."""
    order = Window.partitionBy("municipality_id", "ulica_norm").orderBy(T.only_digits("orientacne_cislo").asc_nulls_last(), F.col("orientacne_cislo").asc_nulls_last(), "register_id")
    return clean.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def check_constraints(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that a row breaks; a rule that is null for a row is not broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(F.col(key), F.explode(broken).alias("rule"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(df: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose foreign key, not null, has no parent."""
    return df.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("__k")), F.col(key) == F.col("__k"), "left_anti")


def findings_query(findings: DataFrame, severity: str | None = None, status: str | None = None, condition: str | None = None) -> DataFrame:
    for column, value in (("severity", severity), ("status", status), ("condition_code", condition)):
        if value is not None:
            findings = findings.filter(F.col(column) == value)
    return findings


def road_segments(roads: DataFrame) -> DataFrame:
    """(road_id, class, line_no, line): each line of a multi-line road, in two dimensions, with at least two points. ``lines`` is an array of lines of [x, y, ...] arrays."""
    flat = F.transform("line", lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))
    return roads.select("road_id", "class", F.posexplode("lines").alias("line_no", "line")).withColumn("line", flat).filter(F.size("line") >= 2)


def transit_stops(bus: DataFrame, rail: DataFrame) -> DataFrame:
    """Bus and rail stops with their kind."""
    return bus.withColumn("kind", F.lit("bus")).unionByName(rail.withColumn("kind", F.lit("rail")), allowMissingColumns=True)


def validate_geom_type(df: DataFrame, key: str, column: str = "geometry_type") -> DataFrame:
    """(key, geometry_type): rows that are no polygons."""
    return df.filter(~F.coalesce(F.col(column).isin("Polygon", "MultiPolygon"), F.lit(False))).select(key, column)


def mercator_to_degrees(x: Column, y: Column) -> Column:
    """struct(lon, lat) of spherical Mercator metres."""
    radius = 6378137.0
    return F.struct(F.degrees(x / radius).alias("lon"), F.degrees(2 * F.atan(F.exp(y / radius)) - F.lit(1.5707963267948966)).alias("lat"))


def normalise_crs(df: DataFrame) -> DataFrame:
    """``df`` (pts: array of struct(x, y)) with crs, sniffed from the first point, and points of Mercator and of the national grid turned to degrees; others pass through."""
    first = F.get("pts", 0)
    crs = (
        F.when(first.isNull(), "none").when((F.abs(first["x"]) <= 180) & (F.abs(first["y"]) <= 90), "4326")
        .when((F.abs(first["x"]) > 1e6) & (F.abs(first["x"]) < 2e7), "3857").when(first["x"].between(-9e5, -4e5), "5514").otherwise("other")
    )
    # cast renames lon and lat
    turned = lambda f: F.transform("pts", lambda p: f(p["x"], p["y"]).cast("struct<x: double, y: double>"))
    known = F.when(F.col("crs") == "3857", turned(mercator_to_degrees)).when(F.col("crs") == "5514", turned(G.grid_to_degrees))
    return df.withColumn("crs", crs).withColumn("pts", known.otherwise(F.col("pts")))
