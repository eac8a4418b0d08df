"""The nine checks of a district, as verdict rows (district_id, condition_code, value, confidence, data_completeness, is_proxy, is_illustrative)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from . import serve, spatial

# Thresholds of the checks.
PASS_M, PASS_S, RISK_M, SHARE, TOLERANCE = 2000.0, 1800.0, 4000.0, 0.10, 1.0


def _row(code: str, value: Column | str, confidence: Column | float, completeness: Column | float, proxy: Column | bool = False, illustrative: bool = False) -> list[Column]:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [
        F.col("district_id"), F.lit(code).alias("condition_code"), lit(value).alias("value"), F.round(lit(confidence).cast("double"), 3).alias("confidence"),
        F.round(lit(completeness).cast("double"), 3).alias("data_completeness"), lit(proxy).alias("is_proxy"), F.lit(illustrative).alias("is_illustrative"),
    ]


def _weak(c: str = "geometry_confidence") -> Column:
    return F.coalesce(F.col(c).isin("low", "medium"), F.lit(False))


def check_s1(districts: DataFrame, addresses: DataFrame) -> DataFrame:
    """Coverage: PASS if every address of the municipality lies in exactly one of its districts; else, or without addresses, INCOMPLETE."""
    total = addresses.groupBy("municipality_id").agg(F.count("*").alias("n"))
    bad = spatial.coverage_failures(addresses, districts).groupBy("municipality_id").agg(F.count("*").alias("bad"))
    joined = districts.select("district_id", "municipality_id").join(total, "municipality_id", "left").join(bad, "municipality_id", "left")
    fine = F.col("n").isNotNull() & (F.coalesce("bad", F.lit(0)) == 0)
    return joined.select(*_row("S1", F.when(fine, "PASS").otherwise("INCOMPLETE"), F.when(fine, 0.8).otherwise(0.4), F.when(fine, 0.9).otherwise(0.3), ~fine))


def check_s2(districts: DataFrame, pairs: DataFrame) -> DataFrame:
    """No overlap with another district of its kind above the tolerance; weak outlines only give INCOMPLETE."""
    both = pairs.select(F.col("a").alias("district_id")).unionByName(pairs.select(F.col("b").alias("district_id"))).groupBy("district_id").agg(F.count("*").alias("partners"))
    joined = districts.join(both, "district_id", "left")
    none = F.col("school_type").isNull()
    value = F.when(none, "INCOMPLETE").when(F.col("partners").isNull(), "PASS").when(_weak(), "INCOMPLETE").otherwise("FAIL")
    confidence = F.when(none, 0.0).when(F.col("partners").isNull(), 0.7).when(_weak(), 0.3).otherwise(0.7)
    return joined.select(*_row("S2", value, confidence, F.when(none, 0.0).otherwise(0.9)))


def check_s3(districts: DataFrame, schools: DataFrame) -> DataFrame:
    """Exactly one public school of its type inside."""
    joined = districts.join(spatial.schools_per_district(schools, districts), "district_id")
    none, n, own = F.col("school_id").isNull(), F.col("school_count"), F.col("own_inside")
    value = F.when(none, "INCOMPLETE").when(n == 1, "PASS").when(n == 0, F.when(_weak(), "INCOMPLETE").otherwise("FAIL")).otherwise(F.when(own & _weak(), "INCOMPLETE").otherwise("FAIL"))
    confidence = F.when(none, 0.0).when(n == 1, F.when(own, 0.75).otherwise(0.55)).when(n == 0, F.when(_weak(), 0.3).otherwise(0.6)).otherwise(F.when(own & _weak(), 0.4).otherwise(0.7))
    return joined.select(*_row("S3", value, confidence, F.when(none, 0.0).otherwise(0.9)))


def check_pa(districts: DataFrame) -> DataFrame:
    return districts.select(*_row("Pa", "INSUFFICIENT_DATA", 0.0, 0.0, True))


def check_pb(districts: DataFrame, routes: DataFrame) -> DataFrame:
    """Walking distance by the median of the sampled routes; never by straight lines."""
    joined = districts.join(serve.route_stats(routes), "district_id", "left")
    n = F.coalesce("sample_size", F.lit(0))
    none = F.col("school_id").isNull() | (n == 0)
    value = F.when(none, "INCOMPLETE").when((F.col("median_m") <= PASS_M) & (F.col("median_s") <= PASS_S), "PASS").when(F.col("median_m") <= RISK_M, "RISK").otherwise("FAIL")
    confidence = F.when(none, 0.0).when(n >= 10, 0.7).when(n >= 5, 0.55).otherwise(0.3)
    return joined.select(*_row("Pb", value, confidence, F.least(F.lit(0.6), confidence * 0.85)))


def check_pc(districts: DataFrame, transit: DataFrame) -> DataFrame:
    """Transit, for illustration: ``transit`` has (district_id, status)."""
    joined = districts.join(transit, "district_id", "left")
    none, fine = F.col("school_id").isNull(), F.coalesce(F.col("status") == "OK", F.lit(False))
    return joined.select(*_row("Pc", F.when(fine & ~none, "ILUSTRATIVE_AVAILABLE").otherwise("ILUSTR_NO_DATA"), F.when(fine & ~none, 0.5).otherwise(0.0), F.when(none, 0.0).otherwise(0.3), False, True))


def check_pd(districts: DataFrame) -> DataFrame:
    return districts.select(*_row("Pd", "INSUFFICIENT_DATA", 0.0, 0.0, True))


def check_pe(districts: DataFrame, shared: DataFrame, buildings: DataFrame) -> DataFrame:
    """Share of the district's area in marked communities; ``shared`` has shared_area, ``buildings`` buildings, districts area."""
    joined = districts.join(shared, "district_id", "left").join(buildings, "district_id", "left")
    area, n = F.coalesce("shared_area", F.lit(0.0)), F.coalesce("buildings", F.lit(0))
    value = F.when((area == 0) & (n == 0), "NOT_EVALUATED").when(area > SHARE * F.col("area"), "SIGNAL").otherwise("NO_SIGNAL")
    return joined.select(*_row("Pe", value, F.when(area > 0, 0.5).otherwise(0.0), F.when(area > 0, 0.5).otherwise(0.0)))


def check_pf(districts: DataFrame) -> DataFrame:
    return districts.select(*_row("Pf", "NOT_EVALUATED", 0.0, 0.0))


def verdict_rows(checks: list[DataFrame], engine_version: str, methodology_version: str) -> DataFrame:
    """All checks as one table with its versions."""
    return reduce(DataFrame.unionByName, checks).withColumns({"engine_version": F.lit(engine_version), "methodology_version": F.lit(methodology_version)})
