"""Verdicts, their composition, findings and the views served from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..sources.io import to_geojson
from ..sources.shared import stored

LEGAL, INDICATORS = ["S1", "S2", "S3"], ["Pa", "Pb", "Pc", "Pd"]


def latest_verdicts(verdicts: DataFrame) -> DataFrame:
    """The latest verdict, ties by the higher id, of each district and condition; combined before the shuffle, no sort. All columns travel, so select those that are wanted first."""
    rest = [c for c in verdicts.columns if c not in ("district_id", "condition_code", "computed_at", "verdict_id")]
    best = verdicts.groupBy("district_id", "condition_code").agg(F.max_by(F.struct(*verdicts.columns), F.struct("computed_at", "verdict_id")).alias("b"))
    return best.select("district_id", "condition_code", "b.verdict_id", "b.computed_at", *[f"b.{c}" for c in rest])


def composition_inputs(latest: DataFrame) -> DataFrame:
    """(district_id, has_legal, any_fail, any_incomplete, any_indicator_risk)."""
    legal = F.col("condition_code").isin(LEGAL)
    risk = F.col("condition_code").isin(INDICATORS) & ~F.coalesce(F.col("is_illustrative"), F.lit(False)) & F.col("value").isin("RISK", "INSUFFICIENT_DATA")
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return latest.groupBy("district_id").agg(
        some(legal).alias("has_legal"), some(legal & (F.col("value") == "FAIL")).alias("any_fail"), some(legal & (F.col("value") == "INCOMPLETE")).alias("any_incomplete"), some(risk).alias("any_indicator_risk")
    )


def verdict_versions(latest: DataFrame) -> DataFrame:
    return latest.groupBy("district_id").agg(F.max("engine_version").alias("engine_version"), F.max("computed_at").alias("computed_at"))


def compose(verdicts: DataFrame) -> DataFrame:
    """(district_id, color, fails, incompletes, risks) of verdicts with one row per district and condition; the last three are sorted code lists."""
    legal, value = F.col("condition_code").isin(LEGAL), F.col("value")
    risky = F.col("condition_code").isin(INDICATORS) & ~F.coalesce(F.col("is_illustrative"), F.lit(False)) & value.isin("RISK", "INSUFFICIENT_DATA")
    codes = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("condition_code")))), ", ")
    out = verdicts.groupBy("district_id").agg(codes(legal & (value == "FAIL")).alias("fails"), codes(legal & (value == "INCOMPLETE")).alias("incompletes"), codes(risky).alias("risks"))
    color = F.when(F.col("fails") != "", "RED").when((F.col("incompletes") != "") | (F.col("risks") != ""), "ORANGE").otherwise("GREEN")
    return out.withColumn("color", color)


# The reasons shown with a colour.
REASONS = {
    "none": "Bez verdiktov",
    "fail": "FAIL v zákonných podmienkach",
    "both": "NEÚPLNÉ zákonné podmienky; Rizikové indikátory",
    "incomplete": "NEÚPLNÉ zákonné podmienky",
    "risk": "Rizikové indikátory",
    "pass": "Š1–Š3 PASS, žiadne rizikové indikátory",
}


def district_compositions(districts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Colour, reason and versions of every district; NONE without a legal verdict. Both aggregates follow from one grouping by district."""
    latest = latest_verdicts(verdicts)
    inputs = composition_inputs(latest).join(verdict_versions(latest), "district_id")
    joined = districts.select("district_id", "municipality_id").join(inputs, "district_id", "left")
    legal, fail, incomplete, risk = (F.coalesce(c, F.lit(False)) for c in ("has_legal", "any_fail", "any_incomplete", "any_indicator_risk"))
    color = F.when(~legal, "NONE").when(fail, "RED").when(incomplete | risk, "ORANGE").otherwise("GREEN")
    reason = F.when(~legal, REASONS["none"]).when(fail, REASONS["fail"]).when(incomplete & risk, REASONS["both"]).when(incomplete, REASONS["incomplete"]).when(risk, REASONS["risk"]).otherwise(REASONS["pass"])
    return joined.select(
        "district_id", "municipality_id", color.alias("composition_color"), reason.alias("composition_reason"), fail.alias("legal_fail"), incomplete.alias("legal_incomplete"), risk.alias("indicator_risk"), "engine_version", "computed_at"
    )


def findings_from_verdicts(verdicts: DataFrame) -> DataFrame:
    """An open finding for every verdict but PASS."""
    return verdicts.filter("value <> 'PASS'").select(
        "verdict_id", "district_id", "condition_code", T.severity_of("value").alias("severity"), F.lit("open").alias("status"), F.left("evidence_text", F.lit(500)).alias("evidence_text"), "engine_version"
    )


def scorecard(verdicts: DataFrame, districts: DataFrame, municipalities: DataFrame, compositions: DataFrame, hosts: list[str] = T.HOSTS) -> DataFrame:
    """The latest verdict of each district and condition as shown: label, order, allowed source, masked evidence, colour."""
    d = districts.select("district_id", F.col("name").alias("district_name"), "municipality_id").join(municipalities.select("municipality_id", F.col("name").alias("municipality_name")), "municipality_id")
    # masked and cut before the joins, which then carry short texts
    latest = latest_verdicts(verdicts).withColumn("evidence_public_text", T.mask_pii("evidence_text", 500)).drop("evidence_text")
    joined = latest.join(d, "district_id").join(compositions.select("district_id", "composition_color"), "district_id", "left")
    return joined.select(
        "district_id", "district_name", "municipality_id", "municipality_name", "condition_code", T.condition_label("condition_code").alias("condition_label"), T.condition_order("condition_code").alias("condition_order"),
        "value", "confidence", F.when(T.host_in_allowlist("source", hosts), F.col("source")).alias("provenance_source"), "evidence_public_text", "is_illustrative", "composition_color", "computed_at",
    )


def findings_public(findings: DataFrame, verdicts: DataFrame, districts: DataFrame, municipalities: DataFrame, hosts: list[str] = T.HOSTS) -> DataFrame:
    """Findings as shown, with rank, masked evidence and the source of their verdict if its host is allowed."""
    d = districts.select("district_id", F.col("name").alias("district_name"), "municipality_id").join(municipalities.select("municipality_id", F.col("name").alias("municipality_name")), "municipality_id")
    sources = verdicts.select("verdict_id", "source")
    # masked and cut before the joins, which then carry short texts
    findings = findings.withColumn("evidence_public_text", T.mask_pii("evidence_text", 200)).drop("evidence_text")
    return findings.join(d, "district_id").join(sources, "verdict_id", "left").select(
        "finding_id", "district_id", "district_name", "municipality_id", "municipality_name", "condition_code", T.condition_label("condition_code").alias("condition_label"), "severity", T.severity_rank("severity").alias("severity_rank"),
        "status", "evidence_public_text", F.when(T.host_in_allowlist("source", hosts), F.col("source")).alias("provenance_source"), "created_at", "is_demo",
    )


def findings_panel(public: DataFrame) -> DataFrame:
    """The severe findings, for a panel."""
    return public.filter(F.col("severity").isin("critical", "high", "medium"))


def _panel_order() -> list[Column]:
    return [F.col("is_demo").desc(), F.col("severity_rank").desc(), F.col("finding_id")]


def findings_panel_order(public: DataFrame) -> DataFrame:
    """The severe findings in the order of the panel: demo rows first, then the most severe, then by id."""
    return findings_panel(public).orderBy(*_panel_order())


def findings_panel_places(public: DataFrame) -> DataFrame:
    """The severe findings, each with its ``place`` in the order of the panel."""
    return numbered(findings_panel(public), *_panel_order())


def numbered(rows: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """Adds ``name``, the place of each row in ``order`` from 1. Rows are sorted by ranges and numbered in their range; only the counts of ranges, a row each, meet in one task."""
    at = F.monotonically_increasing_id()
    ranges = stored(rows.orderBy(*order).withColumns({"__range": F.shiftright(at, 33), "__at": at.bitwiseAND((1 << 33) - 1)}))
    sizes = ranges.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    return ranges.join(F.broadcast(before), "__range").select(*rows.columns, (F.col("__before") + F.col("__at") + 1).alias(name))


def district_base(districts: DataFrame, schools: DataFrame) -> DataFrame:
    """Districts with the attributes of their school; without one they are null."""
    s = schools.select("school_id", F.col("type").alias("own_school_type"), F.col("is_public").alias("own_school_public"), F.col("x").alias("school_x"), F.col("y").alias("school_y"))
    return districts.join(s, "school_id", "left")


def findings_page(findings: DataFrame, page: int = 1, size: int = 50) -> DataFrame:
    """A page of the findings: most severe first, then newest, then by id."""
    order = [T.severity_rank("severity").desc(), F.col("created_at").desc(), F.col("finding_id")]
    return findings.orderBy(*order).offset((page - 1) * size).limit(size)


def municipality_summary(municipalities: DataFrame, districts: DataFrame, findings: DataFrame, compositions: DataFrame) -> DataFrame:
    """Districts, schools, open findings and colours of each municipality; each side is counted before they are joined."""
    d = districts.groupBy("municipality_id").agg(F.count_distinct("district_id").alias("districts_count"), F.count_distinct("school_id").alias("schools_count"))
    per = findings.filter("status = 'open'").groupBy("district_id").agg(F.count_distinct("finding_id").alias("n"))
    f = per.join(districts.select("district_id", "municipality_id"), "district_id").groupBy("municipality_id").agg(F.sum("n").alias("open_findings_count"))
    colors = [F.count_if(F.col("composition_color") == c).alias(f"{c.lower()}_districts_count") for c in ("RED", "ORANGE", "GREEN", "NONE")]
    c = compositions.groupBy("municipality_id").agg(*colors)
    out = municipalities.select("municipality_id", "name").join(d, "municipality_id").join(f, "municipality_id", "left").join(c, "municipality_id", "left")
    return out.withColumn("open_findings_count", F.coalesce("open_findings_count", F.lit(0)))


def run_metadata(verdicts: DataFrame, districts: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: versions and counts. verdicts_count counts each verdict once per finding of its district, as the view that it stands for does; verdicts_distinct counts it once."""
    v = verdicts.groupBy("district_id").agg(F.count("*").alias("n"), F.max("engine_version").alias("version"), F.max("computed_at").alias("at"))
    f = findings.groupBy("district_id").agg(F.count("*").alias("f"), F.count_if(F.col("status") == "open").alias("open"))
    joined = v.join(districts.select("district_id", "school_id"), "district_id").join(f, "district_id", "left")
    return joined.agg(
        F.max("version").alias("engine_version"), F.max("at").alias("last_engine_run_at"), F.sum(F.col("n") * F.greatest(F.coalesce("f", F.lit(0)), F.lit(1))).alias("verdicts_count"), F.sum("n").alias("verdicts_distinct"),
        F.count_distinct("district_id").alias("districts_count"), F.count_distinct("school_id").alias("schools_count"), F.coalesce(F.sum("open"), F.lit(0)).alias("open_findings_count"),
    )


def condition_breakdown(latest: DataFrame) -> DataFrame:
    """Counts of each value per condition, one column per value."""
    values = ["PASS", "FAIL", "INCOMPLETE", "RISK", "INSUFFICIENT_DATA", "SIGNAL", "NO_SIGNAL", "NOT_EVALUATED"]
    return latest.groupBy("condition_code").pivot("value", values).agg(F.count("value")).na.fill(0)


def traffic_light_counts(compositions: DataFrame) -> DataFrame:
    known = F.when(F.col("composition_color").isin("RED", "ORANGE", "GREEN"), F.col("composition_color")).otherwise("NONE")
    return compositions.groupBy(known.alias("color")).agg(F.count("*").alias("districts"))


def result_table(latest: DataFrame, compositions: DataFrame) -> DataFrame:
    """One row per district: a column per condition, and the colour."""
    wide = latest.groupBy("district_id").pivot("condition_code", list(T.CONDITIONS)).agg(F.first("value"))
    return wide.join(compositions.select("district_id", "composition_color", "composition_reason"), "district_id")


def district_summaries(card: DataFrame, findings: DataFrame) -> DataFrame:
    """Per district the number of passed, failed and other conditions, 'code=value' in the order of conditions, and open findings."""
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("condition_order", F.concat_ws("=", "condition_code", "value").alias("t")))), lambda x: x["t"]), " ")
    a = card.groupBy("district_id").agg(F.count_if(F.col("value") == "PASS").alias("passed"), F.count_if(F.col("value") == "FAIL").alias("failed"), F.count_if(~F.col("value").isin("PASS", "FAIL")).alias("others"), shown.alias("conditions"))
    f = findings.groupBy("district_id").agg(F.count_if(F.col("status") == "open").alias("open_findings"))
    return a.join(f, "district_id", "full").na.fill(0, ["passed", "failed", "others", "open_findings"])


def explanation_worklist(findings: DataFrame, done: DataFrame | None = None, cap: int | None = 40) -> DataFrame:
    """For each condition and severity the first finding (smallest id) with masked evidence; those already done are left out; ``cap`` bounds the list."""
    best = findings.groupBy("condition_code", "severity").agg(F.min_by(F.struct("finding_id", "district_id", "evidence_text"), "finding_id").alias("b"))
    work = best.select("condition_code", "severity", "b.finding_id", "b.district_id", T.mask_pii("b.evidence_text", 200).alias("sample"))
    if done is not None:
        work = work.join(done, ["condition_code", "severity"], "left_anti")
    return work if cap is None else work.orderBy("condition_code", "severity").limit(cap)


def explanation_per_condition(explanations: DataFrame) -> DataFrame:
    """The explanation of the most severe row of each condition, the later of equals."""
    return explanations.groupBy("condition_code").agg(F.max_by("explanation", F.struct(T.severity_rank("severity"), "finding_id")).alias("explanation"))


def route_stats(routes: DataFrame) -> DataFrame:
    """Per district the median and largest distance and duration, routes and failed routes."""
    return routes.groupBy("district_id").agg(
        F.median("distance_m").alias("median_m"), F.max("distance_m").alias("max_m"), F.median("duration_s").alias("median_s"), F.max("duration_s").alias("max_s"), F.count("distance_m").alias("sample_size"), F.count_if(F.col("distance_m").isNull()).alias("errors")
    )


def walking_status(routes: DataFrame, districts: DataFrame) -> DataFrame:
    """OK up to 2000 m by the median (4000 for MS), RISK up to a quarter more, FAIL above, none without routes."""
    limit = F.when(F.col("school_type") == "MS", 4000.0).otherwise(2000.0)
    joined = districts.select("district_id", "school_type").join(route_stats(routes).select("district_id", "median_m"), "district_id", "left")
    return joined.withColumn("status", F.when(F.col("median_m").isNull(), "NO_DATA").when(F.col("median_m") <= limit, "PASS").when(F.col("median_m") <= limit * 1.25, "RISK").otherwise("FAIL"))


def sample_origins(addresses: DataFrame, n: int = 20, seed: int = 0, centroids: DataFrame | None = None, buildings: DataFrame | None = None) -> DataFrame:
    """At most ``n`` origins per district: its centroid first, then addresses, then buildings, each kind in the order of a seeded hash of the id.

    ``addresses`` has district_id, address_id and more; ``buildings`` the same, ``centroids`` district_id with a null
    address_id. Columns that one of them lacks are null there.
    """
    kinds = [(centroids, "centroid"), (addresses, "address"), (buildings, "building")]
    every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [f.withColumns({"kind": F.lit(k), "__k": F.lit(i)}) for i, (f, k) in enumerate(kinds) if f is not None])
    order = Window.partitionBy("district_id").orderBy("__k", F.md5(F.concat(F.lit(f"{seed}:"), F.col("address_id").cast("string"))), "address_id")
    return every.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= n).drop("n", "__k")


def with_demo_values(card: DataFrame, mock: DataFrame) -> DataFrame:
    """Scorecard rows with a demo value beside them, where there is one; never an input of a verdict."""
    return card.join(mock.select("district_id", "condition_code", "demo_value"), ["district_id", "condition_code"], "left")


def map_features(districts: DataFrame, schools: DataFrame, compositions: DataFrame) -> DataFrame:
    """Districts with colour (NONE without one), the outline as GeoJSON and the school's point."""
    s = schools.select("school_id", F.struct("x", "y").alias("school_point"))
    joined = districts.join(s, "school_id", "left").join(compositions.select("district_id", "composition_color", "composition_reason"), "district_id", "left")
    return joined.select("district_id", "name", "municipality_id", "school_id", F.coalesce("composition_color", F.lit("NONE")).alias("composition_color"), "composition_reason", to_geojson("rings").alias("geojson"), "school_point")


def islands_view(islands: DataFrame) -> DataFrame:
    """Islands with counts, from their lists where a count is missing."""
    n = lambda c, a: F.coalesce(F.col(c), F.when(F.col(a).isNotNull(), F.size(a)), F.lit(0)).cast("long").alias(c)
    kept = [c for c in islands.columns if c not in ("street_count", "house_count")]
    return islands.select(*kept, n("street_count", "streets"), n("house_count", "house_numbers"))


def multipart_findings(parts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(district_id, verdict_id, condition_code, severity, status, tag): one open finding for each district of several parts, on its latest S2 verdict if there is one; the tag makes it replaceable."""
    several = parts.groupBy("district_id").agg(F.count("*").alias("n")).filter("n > 1").select("district_id")
    s2 = latest_verdicts(verdicts.filter("condition_code = 'S2'")).select("district_id", "verdict_id")
    return several.join(s2, "district_id", "left").select("district_id", "verdict_id", F.lit("S2").alias("condition_code"), F.lit("medium").alias("severity"), F.lit("open").alias("status"), F.concat(F.lit("geo:multipart:"), F.col("district_id").cast("string")).alias("tag"))
