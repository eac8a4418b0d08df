import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonecheck.functions import geo as G
from zonecheck.operators import assign, clean, rules, serve, spatial, tessellate
from zonecheck.sources import io

BASE = {"S1": "PASS", "S2": "PASS", "S3": "PASS", "Pa": "PASS", "Pb": "PASS", "Pc": "PASS", "Pd": "PASS", "Pe": "NO_SIGNAL", "Pf": "NOT_EVALUATED"}
CASES = {
    "green": ({}, (), "GREEN"), "coverage_gap": ({"S1": "FAIL"}, (), "RED"), "overlap": ({"S2": "FAIL"}, (), "RED"), "missing_address": ({"S1": "INCOMPLETE"}, (), "ORANGE"), "missing_school": ({"S3": "INCOMPLETE"}, (), "ORANGE"),
    "capacity": ({"Pa": "INSUFFICIENT_DATA"}, (), "ORANGE"), "no_transit": ({"Pa": "INSUFFICIENT_DATA", "Pc": "ILUSTR_NO_DATA"}, ("Pc",), "ORANGE"), "signal": ({"Pe": "SIGNAL"}, (), "GREEN"), "pa_fail": ({"Pa": "FAIL"}, (), "GREEN"),
    "pc_risk": ({"Pc": "RISK"}, (), "ORANGE"), "pc_risk_illustrative": ({"Pc": "RISK"}, ("Pc",), "GREEN"), "no_data_illustrative": ({"Pc": "ILUSTR_NO_DATA"}, ("Pc",), "GREEN"),
}


def verdicts(spark):
    rows = []
    for d, (change, shown, _) in enumerate(CASES.values()):
        for k, (code, value) in enumerate({**BASE, **change}.items()):
            rows.append((100 * d + k, d, code, value, code in shown, "v1", 5))
            rows.append((100 * d + 50 + k, d, code, "FAIL", False, "v0", 4))  # an older run
    return spark.createDataFrame(rows, "verdict_id long, district_id long, condition_code string, value string, is_illustrative boolean, engine_version string, computed_at long")


def test_composition(spark):
    latest = serve.latest_verdicts(verdicts(spark))
    assert latest.count() == 9 * len(CASES)
    got = {r["district_id"]: r["color"] for r in serve.compose(latest).collect()}
    assert got == {d: color for d, (_, _, color) in enumerate(CASES.values())}
    districts = spark.createDataFrame([(d, 1) for d in range(len(CASES) + 1)], "district_id long, municipality_id long")
    view = {r["district_id"]: r for r in serve.district_compositions(districts, verdicts(spark)).collect()}
    assert view[len(CASES)]["composition_color"] == "NONE" and view[len(CASES)]["composition_reason"] == "Bez verdiktov"
    assert {d: view[d]["composition_color"] for d in got} == got


def test_latest_takes_the_higher_id_of_ties(spark):
    df = spark.createDataFrame([(1, 1, "S1", "PASS", 3), (2, 1, "S1", "FAIL", 3)], "verdict_id long, district_id long, condition_code string, value string, computed_at long")
    assert serve.latest_verdicts(df).first()["value"] == "FAIL"


def test_severity_order(spark):
    df = spark.createDataFrame([(1, "info"), (2, "critical"), (3, "medium"), (4, "low"), (5, "high")], "finding_id int, severity string").withColumn("created_at", F.lit(1))
    assert [r["finding_id"] for r in serve.findings_page(df).collect()] == [2, 5, 3, 4, 1]
    assert [r["finding_id"] for r in serve.findings_page(df, page=2, size=2).collect()] == [3, 4]


def test_run_metadata_counts_as_the_view_does(spark):
    v = spark.createDataFrame([(1, 1, "a", 1), (2, 1, "a", 1), (3, 2, "b", 2)], "verdict_id int, district_id int, engine_version string, computed_at int")
    d = spark.createDataFrame([(1, 5), (2, None)], "district_id int, school_id int")
    f = spark.createDataFrame([(1, 1, "open"), (2, 1, "x"), (3, 1, "open")], "finding_id int, district_id int, status string")
    r = serve.run_metadata(v, d, f).first()
    assert (r["verdicts_count"], r["verdicts_distinct"], r["districts_count"], r["schools_count"], r["open_findings_count"]) == (7, 3, 2, 1, 2)


def test_house_of_address(spark):
    cases = {"Bajkalská 199, 080 01 Prešov, Slovakia": "199", "Bajkalská 4862/17, 080 01 Prešov, Slovakia": "17", "Federátov 6499/2, Sekčov, 080 01 Prešov, Slovakia": "2", "Bajkalská, 080 01 Prešov, Slovakia": None, None: None}
    df = spark.createDataFrame([(a,) for a in cases], "a string")
    assert {r[0]: r[1] for r in df.select("a", clean.house_from_address("a")).collect()} == cases


def test_register(spark):
    rows = [(3, 1, "Tehelná.", " 1", "2 ", True, False), (2, 1, "Tehelná", "1", "2", True, None), (1, 1, "tehelná", "1", "2", False, False), (4, 1, "Tehelná", None, None, True, False), (5, 1, "Tehelná", None, None, True, False), (6, 1, " ", "1", "1", True, False), (7, 1, "X", "1", "1", None, False), (8, 1, "X", "1", "1", True, True)]
    raw = spark.createDataFrame(rows, "register_id long, municipality_id long, ulica string, supisne_cislo string, orientacne_cislo string, obyvatelna boolean, vyradena boolean")
    neat = clean.clean_register(raw)
    assert sorted(r["register_id"] for r in neat.collect()) == [2, 4]
    r = clean.clean_report(raw, neat).first()
    assert (r["total"], r["not_habitable"], r["withdrawn"], r["empty_street"], r["kept"], r["duplicates"]) == (8, 2, 1, 1, 2, 2)
    assert [x["register_id"] for x in clean.street_anchors(neat).collect()] == [2]


def test_schools(spark):
    f = spark.createDataFrame([("A", "Základná škola X", None), ("A", "špeciálna základná škola", "sk"), ("B", "Materská škola", "hu"), ("Z", "Základná škola", None), ("A", "gymnázium", None)], "code string, type_text string, language string")
    m = spark.createDataFrame([("A", 1), ("B", 2)], "code string, municipality_id int")
    assert sorted((r["type"], r["teaching_language"], r["municipality_id"]) for r in clean.load_schools(f, m).collect()) == [("MS", "HU", 2), ("ZS", "SK", 1), ("ZS", "SK", 1)]
    p = spark.createDataFrame([("súkromná škola",), ("Cirkevná",), ("",), (None,)], "t string")
    assert [r[0] for r in p.select(clean.is_public("t")).collect()] == [False, False, True, True]


def test_children_and_communities(spark):
    m = spark.createDataFrame([("123456", 1)], "code string, municipality_id int")
    df = spark.createDataFrame([("SK0_123456", None, 7, None), ("SK0_999999", 1, 1, 1)], "nuts string, last int, y2020 int, y2019 int")
    assert [tuple(r) for r in clean.children_latest(df, m).collect()] == [("123456", 1, 7, 2020)]
    c = spark.createDataFrame([("123456", 501), ("x", 101), ("x", 1), ("x", 0), ("x", None)], "code string, population int")
    assert [r["category"] for r in clean.community_category(c, m).orderBy(F.col("population").desc_nulls_last()).collect()] == ["large", "medium", "small", "unknown", "unknown"]


def test_ways(spark):
    ways = [(1, {"name": "Hlavná", "highway": "residential"}, [(0.0, 0.0), (1.0, 1.0)]), (2, {"name": "hlavná", "highway": "primary"}, [(5.0, 5.0), (1.0, 1.0)]), (3, {"name": "X", "highway": "footway"}, [(0.0, 0.0)]), (4, {"name": "Far", "highway": "primary"}, [(90.0, 90.0)]), (5, {"building": "yes", "addr:street": "A", "addr:housenumber": "3"}, [(0.0, 0.0), (2.0, 0.0)])]
    df = spark.createDataFrame(ways, "id int, tags map<string,string>, pts array<struct<x: double, y: double>>")
    assert [tuple(r) for r in clean.named_streets(df, (0, 0, 2, 2)).collect()] == [("hlavná", [1, 2])]
    assert [tuple(r) for r in clean.address_buildings(df, (0, 0, 2, 2)).collect()] == [(5, "A", "3", 1.0, 0.0)]


def expanded(kind, numbers):
    if kind == "all":
        return []
    if kind == "single":
        return numbers
    if kind in ("odd", "even"):
        if len(numbers) < 2:
            return list(range(1, 200, 2)) if kind == "odd" else list(range(2, 201, 2))
        return [n for a, b in zip(numbers[::2], numbers[1::2], strict=False) for n in range(a, b + 1, 2)]
    out, i = [], 0
    while i < len(numbers):
        if i + 1 < len(numbers) and numbers[i + 1] - numbers[i] > 1:
            out += range(numbers[i], numbers[i + 1] + 1)
            i += 2
        else:
            out.append(numbers[i])
            i += 1
    return out


@pytest.mark.parametrize("kind,numbers", [("all", []), ("single", [7]), ("odd", []), ("odd", [1, 9, 15, 17, 21]), ("even", [4]), ("range", [4, 5]), ("range", [27, 29]), ("range", [1, 4, 5, 9, 3])])
def test_expand_ranges(spark, kind, numbers):
    df = spark.createDataFrame([(1, "S", kind, numbers)], "district_id int, street string, range_type string, numbers array<int>")
    assert sorted(r["house_number"] for r in assign.expand_ranges(df).collect()) == sorted(set(expanded(kind, numbers)))


def test_sample_evenly(spark):
    for n, cap in ((7, 3), (3, 5), (100, 7), (10, 10)):
        df = spark.range(n).withColumn("k", F.lit(1))
        want = [int(i * n / cap) for i in range(cap)] if n > cap else list(range(n))
        assert sorted(r["id"] for r in assign.sample_evenly(df, ["k"], ["id"], cap).collect()) == want


def test_house_ranges_and_streets(spark):
    a = spark.createDataFrame([(1, 1, "a", "3"), (2, 1, "a", "4A"), (3, 1, "a", None), (4, 1, "b", "1"), (5, 2, "a", "3")], "register_id int, municipality_id int, ulica_norm string, orientacne_cislo string")
    s = spark.createDataFrame([(1, 10, "a", 1, 1, 9), (1, 11, "a", 0, 2, 8), (1, 12, "b", None, None, None)], "municipality_id int, district_id int, street_norm string, parity int, lo int, hi int")
    assert sorted((r["register_id"], r["district_id"]) for r in assign.assign_by_house(a, s).collect()) == [(1, 10), (2, 11), (3, 10), (3, 11), (4, 12)]


# --- geometry

L_SHAPE = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4), (0, 0)]
HOLE = [(0.2, 0.2), (0.8, 0.2), (0.8, 0.8), (0.2, 0.8), (0.2, 0.2)]
POLY = "district_id long, municipality_id long, rings array<struct<hole: boolean, pts: array<struct<x: double, y: double>>>>"


def ring(points):
    return [(float(x), float(y)) for x, y in points]


def polygons(spark):
    rows = [(1, 1, [(False, ring(L_SHAPE)), (True, ring(HOLE))]), (2, 1, [(False, ring([(0.5, 0.5), (3, 0.5), (3, 3), (0.5, 3), (0.5, 0.5)]))])]
    return spatial.with_box(spark.createDataFrame(rows, POLY)).withColumns({"school_type": F.lit("ZS"), "teaching_language": F.lit(None).cast("string")})


def test_points_in_l_shape_with_hole(spark):
    points = [(1, 1, 0.5, 0.5), (2, 1, 0.1, 0.1), (3, 1, 2.0, 2.0), (4, 1, 0.0, 2.0), (5, 1, 0.2, 0.5), (6, 2, 0.1, 0.1), (7, 1, 3.9, 0.9)]
    df = spark.createDataFrame(points, "address_id long, municipality_id long, x double, y double")
    got = lambda edge: {(r["address_id"], r["district_id"]) for r in spatial.points_in_polygons(df, polygons(spark), cell=1.0, boundary=edge).collect()}
    assert got(False) == {(2, 1), (3, 2), (7, 1)}
    assert got(True) == {(1, 2), (2, 1), (3, 2), (4, 1), (5, 1), (7, 1)}


def test_overlap_area_of_general_polygons(spark):
    r = spatial.overlap_pairs(polygons(spark), tolerance=0.01, cell=1.0).collect()
    # of the square [0.5, 3]^2 the L holds two bars, less the part of its hole
    assert len(r) == 1 and abs(r[0]["area"] - (2.5 * 0.5 + 0.5 * 2.0 - 0.3 * 0.3)) < 1e-9
    g = np.random.default_rng(0)
    for _ in range(20):
        a, b = (spatial.convex_hull(g.random((6, 2))) for _ in range(2))
        close = lambda h: [{"hole": False, "pts": [{"x": x, "y": y} for x, y in [*h, h[0]]]}]
        grid = (np.stack(np.meshgrid(np.arange(400), np.arange(400)), -1).reshape(-1, 2) + 0.5) / 400
        inside = lambda h: np.all([(q[0] - p[0]) * (grid[:, 1] - p[1]) - (q[1] - p[1]) * (grid[:, 0] - p[0]) >= 0 for p, q in zip(h, [*h[1:], h[0]], strict=True)], 0)
        assert abs(spatial.shared_area(close(a), close(b)) - (inside(a) & inside(b)).mean()) < 0.01


def test_geometry_columns(spark):
    df = spark.createDataFrame([(ring(L_SHAPE),)], "p array<struct<x: double, y: double>>")
    r = df.select(G.ring_area(F.col("p")), G.length_m(F.col("p")), G.centroid(F.col("p")), F.size(G.segmentize(F.col("p"), 1.5))).first()
    assert r[0] == 7 and r[1] == 16 and abs(r[2]["x"] - (4 * 2 + 3 * 0.5) / 7) < 1e-9 and r[3] == 3 + 1 + 2 + 2 + 1 + 3 + 1
    d = spark.range(1).select(G.haversine_m(F.lit(21.0), F.lit(49.0), F.lit(21.0), F.lit(50.0)), G.utm34n(F.lit(21.0), F.lit(0.0)), G.utm34n(F.lit(21.24), F.lit(49.0))).first()
    assert abs(d[0] - 111195) < 5 and abs(d[1]["x"] - 500000) < 1e-6 and abs(d[1]["y"]) < 1e-6
    assert abs(d[2]["x"] - 517553.9) < 2 and abs(d[2]["y"] - 5427488) < 60


def test_nearest_and_blockers(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 1000.0, 0.0)], "address_id int, x double, y double")
    s = spark.createDataFrame([(7, 300.0, 400.0), (8, -300.0, 400.0), (9, 0.0, 501.0)], "school_id int, x double, y double")
    assert [tuple(r) for r in spatial.nearest_within(p, s, 500.0, "address_id", "school_id").collect()] == [(1, 7, 500.0)]
    lines = spark.createDataFrame([(1, 5, 0.0, 0.0, 1000.0, 0.0)], "line_id int, district_id int, ax double, ay double, bx double, by double")
    h = spark.createDataFrame([(6, 500.0, 50.0), (5, 500.0, 1.0), (7, 500.0, 51.0), (8, 1040.0, 0.0)], "district_id int, x double, y double")
    assert spatial.corridor_blockers(lines, h).first()["blockers"] == [6, 8]


def test_hulls(spark):
    g = np.random.default_rng(1)
    pts = [(k, float(x), float(y)) for k in (1, 2) for x, y in g.random((300, 2))] + [(3, 0.0, 0.0), (3, 1.0, 1.0)]
    got = {r["k"]: r for r in spatial.hulls(spark.createDataFrame(pts, "k long, x double, y double"), "k").collect()}
    assert set(got) == {1, 2}
    for k, r in got.items():
        whole = spatial.convex_hull(np.array([p[1:] for p in pts if p[0] == k]))
        assert sorted((p["x"], p["y"]) for p in r["hull"]) == sorted(whole) and r["n"] == 300


# --- tessellation


def test_tessellation_owns_every_cell_once(spark):
    bounds = spark.createDataFrame([(1, 0.0, 0.0, 3000.0, 2000.0), (2, 0.0, 0.0, 100.0, 100.0)], "municipality_id int, x0 double, y0 double, x1 double, y1 double")
    seeds = [(1, 10, 50.0, 50.0), (1, 11, 2950.0, 1950.0), (1, 12, 2950.0, 50.0), (1, 12, 60.0, 1900.0)]
    cells = tessellate.raster(bounds, 100.0)
    owned = tessellate.tessellate(cells, spark.createDataFrame(seeds, "municipality_id int, district_id int, x double, y double"), tile=200.0)
    got = {(r["cx"], r["cy"]): r["district_id"] for r in owned.collect()}
    assert len(got) == owned.count() == 600
    for (cx, cy), d in got.items():
        assert d == min((math.hypot(cx * 100 + 50 - x, cy * 100 + 50 - y), d0) for _, d0, x, y in seeds)[1]
    labelled = tessellate.parts(owned.select("municipality_id", "cx", "cy", "district_id"))
    areas = {(r["district_id"], r["part"]): r["area_m2"] for r in tessellate.part_areas(labelled, 100.0).collect()}
    assert len([k for k in areas if k[0] == 12]) == 2 and sum(areas.values()) == 6e6


def grid(spark, text):
    rows = [(1, x, y, int(c)) for y, line in enumerate(text.split()) for x, c in enumerate(line)]
    return spark.createDataFrame(rows, "municipality_id long, cx long, cy long, district_id long")


def test_slivers_go_to_the_longest_border(spark):
    cells = grid(spark, "1111222 1111222 1111212 1111222")
    after = {(r["cx"], r["cy"]): r["district_id"] for r in tessellate.absorb_slivers(cells, 1.0, max_km2=1e-5, max_share=0.1).collect()}
    assert len(after) == 28 and after[5, 2] == 2 and sorted(after.values()).count(1) == 16
    labelled = tessellate.parts(cells)
    evidence = tessellate.part_evidence(labelled, spark.createDataFrame([(1, 2, 5.5, 0.5)], "municipality_id long, district_id long, x double, y double"), 1.0)
    kept = tessellate.keep_non_empty(evidence, tessellate.part_areas(labelled, 1.0))
    assert sorted((r["district_id"], r["area_m2"]) for r in kept.collect()) == [(1, 16.0), (2, 11.0)]


def test_parts_by_rank(spark):
    areas = spark.createDataFrame([(1, 0, 10.9e6), (1, 1, 0.01e6), (2, 0, 5.0e6)], "district_id int, part int, area_m2 double")
    assert [(r["district_id"], r["part"]) for r in tessellate.sliver_parts(areas).collect()] == [(1, 1)]
    assert {(r["district_id"], r["part"]): r["status"] for r in tessellate.mark_main_body(areas).collect()} == {(1, 0): "main_body", (1, 1): "unresolved_anomaly", (2, 0): "main_body"}


# --- checks


def test_checks(spark):
    d = spark.createDataFrame([(1, 1, "ZS", 1, None, [(False, ring([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]))]), (2, 1, "ZS", None, "low", [(False, ring([(9, 0), (20, 0), (20, 10), (9, 10), (9, 0)]))])], "district_id long, municipality_id long, school_type string, school_id long, geometry_confidence string, rings array<struct<hole: boolean, pts: array<struct<x: double, y: double>>>>")
    d = spatial.with_box(d).withColumns({"teaching_language": F.lit(None).cast("string"), "name": F.col("district_id").cast("string")})
    a = spark.createDataFrame([(1, 1, 5.0, 5.0), (2, 1, 9.5, 5.0)], "address_id long, municipality_id long, x double, y double")
    s = spark.createDataFrame([(1, "ZS", True, 5.0, 5.0), (2, "ZS", False, 6.0, 5.0)], "school_id long, type string, is_public boolean, x double, y double")
    value = lambda df: {r["district_id"]: (r["value"], r["confidence"]) for r in df.collect()}
    assert value(rules.check_s1(d, a)) == {1: ("INCOMPLETE", 0.4), 2: ("INCOMPLETE", 0.4)}
    assert value(rules.check_s1(d, a.filter("address_id = 1"))) == {1: ("PASS", 0.8), 2: ("PASS", 0.8)}
    assert value(rules.check_s2(d, spatial.overlap_pairs(d))) == {1: ("FAIL", 0.7), 2: ("INCOMPLETE", 0.3)}
    assert value(rules.check_s3(d, s)) == {1: ("PASS", 0.75), 2: ("INCOMPLETE", 0.0)}
    routes = spark.createDataFrame([(1, 1999.0, 100.0)] * 5 + [(1, None, None)], "district_id long, distance_m double, duration_s double")
    assert value(rules.check_pb(d, routes)) == {1: ("PASS", 0.55), 2: ("INCOMPLETE", 0.0)}
    assert value(rules.check_pc(d, spark.createDataFrame([(1, "OK")], "district_id long, status string"))) == {1: ("ILUSTRATIVE_AVAILABLE", 0.5), 2: ("ILUSTR_NO_DATA", 0.0)}
    assert rules.verdict_rows([rules.check_pa(d), rules.check_pd(d), rules.check_pf(d)], "e", "m").count() == 6


# --- sources


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"type": "FeatureCollection", "totalFeatures": 2, "features": [{"type": "Feature", "properties": {"ulica": "Hlavná", "cislo": "3"}, "geometry": {"type": "Point", "coordinates": [21.2, 49.0]}}, {"type": "Feature", "properties": {}, "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}}]}')
    (tmp_path / "bad.json").write_text('{"type": "Feature"}')
    assert io.read_features(spark, str(tmp_path / "a.json")).count() == 2
    assert [tuple(r) for r in io.read_address_features(spark, str(tmp_path / "a.json")).collect()] == [("Hlavná", "3", None, 21.2, 49.0)]
    with pytest.raises(Exception, match="no FeatureCollection"):
        io.read_features(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "p.csv").write_text('ulica;cislo;gps_lat;gps_lon\nA;1;"49,5";"21,5"\nB;2;0;21\nC;3;;\n')
    assert [tuple(r) for r in io.read_address_points(spark, str(tmp_path / "p.csv"), sep=";").collect()] == [("A", "1", None, 21.5, 49.5)]
    (tmp_path / "r.json").write_text('[{"Mesto": " P ", "Ulica": "", "Obývateľná": "Áno", "Vyrad.": "Nie"}, {"Obývateľná": "?"}]')
    got = io.read_register(spark, str(tmp_path / "r.json")).collect()
    assert [(r["mesto"], r["ulica"], r["obyvatelna"], r["vyradena"]) for r in got] == [("P", None, True, False), (None, None, None, None)]
    assert io.reload(spark.range(5), str(tmp_path / "t")) == 5


def test_upsert_keeps_other_columns(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (None, "n", "z")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 2), (None, "m", 3)], "k int, v string, u int")
    assert {tuple(r) for r in io.upsert(old, new, ["k"]).collect()} == {(1, "a", "x", None), (2, "c", "y", 1), (3, "d", None, 2), (None, "m", "z", 3)}
    assert {tuple(r) for r in io.upsert(old, spark.createDataFrame([(1,), (9,)], "k int"), ["k"]).collect()} == {(1, "a", "x"), (2, "b", "y"), (None, "n", "z"), (9, None, None)}
    assert io.with_provenance(old, "s", "2024-01-02", 7).first()["provenance"] == '{"source":"s","source_date":"2024-01-02","source_quality":7}'


def test_faults_and_thinning():
    assert spatial.ring_fault([]) == "empty" and spatial.ring_fault([(0, 0), (1, 0), (0, 0)]) == "fewer than 4 points" and spatial.ring_fault([(0, 0), (1, 0), (1, 1), (0, 1)]) == "unclosed"
    assert spatial.ring_fault([(0, 0), (1, 1), (1, 0), (0, 1), (0, 0)]) == "self-intersection" and spatial.ring_fault(L_SHAPE) is None
    assert spatial.thinned([(0, 0), (1, 0.01), (2, 0), (2, 2)], 0.1) == [(0, 0), (2, 0), (2, 2)] and spatial.thinned([], 1.0) == []


def test_islands(spark):
    cells = grid(spark, "1122211 1122211 1122233")
    labelled = tessellate.parts(cells)
    houses = spark.createDataFrame([(1, 1, 5.5, 0.5), (1, 2, 3.5, 0.5)], "municipality_id long, district_id long, x double, y double")
    got = {(r["district_id"], r["area_m2"]): (r["status"], r["blockers"]) for r in tessellate.connect_islands(labelled, houses, 1.0).collect()}
    assert got[1, 6.0] == ("main_body", None) and got[1, 4.0] == ("unresolved_anomaly", [2]) and got[3, 2.0] == ("main_body", None)
    candidates = tessellate.absorb_evidenceless(cells, houses.filter("district_id = 2"), 1.0, dry_run=True)
    assert sorted(r["area_m2"] for r in candidates.collect()) == [4.0, 6.0]
    with pytest.raises(ValueError, match="too large"):
        tessellate.absorb_evidenceless(cells, houses.filter("district_id = 2"), 1.0, max_km2=1e-9)


def test_crs(spark):
    df = spark.createDataFrame([(1, [(21.2, 49.0)]), (2, [(2359973.2, 6274861.4)]), (3, [(-500000.0, -1200000.0)]), (4, [])], "id int, pts array<struct<x: double, y: double>>")
    got = {r["id"]: r for r in clean.normalise_crs(df).collect()}
    assert [got[i]["crs"] for i in (1, 2, 3, 4)] == ["4326", "3857", "5514", "none"]
    assert abs(got[2]["pts"][0]["x"] - 21.2) < 1e-4 and abs(got[2]["pts"][0]["y"] - 49.0) < 1e-2
    # the published example of the projection: within a centimetre on the grid's own ellipsoid, some 150 m away from there in WGS 84
    one = spark.createDataFrame([(-568991.00, -1050538.63)], "x double, y double").select(G.grid_to_bessel(F.col("x"), F.col("y")).alias("own"), G.grid_to_degrees(F.col("x"), F.col("y")).alias("wgs")).first()
    lon, lat = 16 + 50 / 60 + 59.179 / 3600, 50 + 12 / 60 + 32.442 / 3600
    assert abs(one["own"]["lat"] - lat) * 111_000 < 0.02 and abs(one["own"]["lon"] - lon) * 71_000 < 0.02
    moved = math.hypot((one["wgs"]["lat"] - lat) * 111_000, (one["wgs"]["lon"] - lon) * 71_000)
    assert 80 < moved < 180
    turned = got[3]["pts"][0]
    assert 17 < turned["x"] < 19 and 48 < turned["y"] < 50


def test_partitions_are_overwritten_in_place(spark, tmp_path):
    import os

    path = str(tmp_path / "table")
    rows = lambda *x: spark.createDataFrame(list(x), "id long, v string, part long")
    io.write_partitions(rows((1, "a", 1), (2, "b", 2), (3, "c", 3), (4, "d", None)), path, ["part"])
    stamp = lambda: {d + f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    before = stamp()
    gone = spark.createDataFrame([(2,), (3,), (9,)], "part long")
    for _ in range(2):
        io.overwrite_partitions(rows((7, "x", 2), (8, "y", 5)), path, ["part"], gone)
        got = sorted((r["id"], r["v"], r["part"]) for r in spark.read.parquet(path).collect())
        assert got == [(1, "a", 1), (4, "d", None), (7, "x", 2), (8, "y", 5)]
        after = stamp()
        assert {k for k, v in after.items() if before.get(k) == v} == {k for k in before if "part=1" in k or "part=__" in k}


def test_outline_distances(spark):
    ring = lambda *p: [(False, [{"x": float(x), "y": float(y)} for x, y in p])]
    kind = "k long, rings array<struct<hole: boolean, pts: array<struct<x: double, y: double>>>>"
    r = np.random.default_rng(2)
    a, b = (r.uniform(0, 5000, (n, 2)) for n in (300, 170))
    one, two = (spark.createDataFrame([(1, ring(*p)), (k, ring(*p[:4]))], kind) for k, p in ((2, a), (3, b)))
    got = {x["k"]: x["distance"] for x in spatial.hausdorff(one, two, "k").collect()}
    d = np.hypot(a[:, None, 0] - b[:, 0], a[:, None, 1] - b[:, 1])
    assert set(got) == {1} and abs(got[1] - max(d.min(0).max(), d.min(1).max())) < 1e-9
    square = spark.createDataFrame([(i, i, ring((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))) for i in range(5)] + [(5, 5, [])], "district_id long, school_id long, rings array<struct<hole: boolean, pts: array<struct<x: double, y: double>>>>")
    schools = spark.createDataFrame([(0, 5.0, 5.0), (1, 10.0, 5.0), (2, 40.0, 50.0), (3, 100.0, 5.0), (4, None, 1.0), (5, 1.0, 1.0)], "school_id long, x double, y double")
    placed = {x["school_id"]: (x["place"], x["distance"]) for x in spatial.school_distances(schools, square).collect()}
    assert placed == {0: ("inside", 0.0), 1: ("inside", 0.0), 2: ("near", 50.0), 3: ("far", 90.0), 4: ("unknown", None), 5: ("unknown", None)}


def test_roads_and_stops(spark):
    roads = spark.createDataFrame([(1, "I", [[[0.0, 1.0, 9.0], [2.0, 3.0, 9.0]], [[5.0, 5.0]]])], "road_id int, class string, lines array<array<array<double>>>")
    assert [(r["line_no"], [tuple(p) for p in r["line"]]) for r in clean.road_segments(roads).collect()] == [(0, [(0.0, 1.0), (2.0, 3.0)])]
    a = spark.createDataFrame([(1,)], "stop int")
    assert sorted(r["kind"] for r in clean.transit_stops(a, a).collect()) == ["bus", "rail"]


def test_containment(spark):
    s = spark.createDataFrame([("Hlavná",), ("Malá Hlavná",), ("Zzz",)], "street string")
    n = spark.createDataFrame([("hlavná",), ("Hlavná stará",)], "name string")
    assert {tuple(r) for r in assign.containment_match(s, n).collect()} == {("Hlavná", "hlavná", "exact"), ("Malá Hlavná", "hlavná", "contained"), ("Zzz", None, "none")}


NAMES = ["park", "Parkova", "Nova-parkova 2", "a", "Ab", "ab", "abeceda", "", " Hlavná ", "hlavná", "bc", "cde", "stará", "Hlavná/stará", "zzz", "x y"]


def test_containment_and_prefixes_against_the_full_product(spark):
    streets, names = NAMES[::2] + ["parkova", "B"], NAMES[1::2] + ["ovapa", "kov", "eceda"]
    for left, right in ((streets, names), (names, streets), (streets, [x for x in names if x]), (["park", "qqq"], ["Parkova"])):
        want = set()
        for s in left:
            low = s.lower().strip(" ")
            equal = [x for x in right if x.lower() == low]
            inside = [x for x in right if low in x.lower() or x.lower() in low]
            want.add((s, min(equal), "exact") if equal else (s, min(inside), "contained") if inside else (s, None, "none"))
        a, b = spark.createDataFrame([(x,) for x in left], "street string"), spark.createDataFrame([(x,) for x in right], "name string")
        assert {tuple(r) for r in assign.containment_match(a, b).collect()} == want
        p, q = (spark.createDataFrame(list(enumerate(x)), f"{k} int, street string") for x, k in ((right, "point_id"), (left, "street_id")))
        low = lambda x: x.lower().strip(" ")
        pairs = sorted((i, j) for i, s in enumerate(left) for j, x in enumerate(right) if low(s).startswith(low(x)) or low(x).startswith(low(s)))
        assert sorted(tuple(r) for r in assign.prefix_match(p, q).collect()) == pairs


def test_house_worklist_takes_a_hundred_of_each_street(spark):
    from zonecheck.plans import QUERIES, queries
    from zonecheck.plans.views import Views

    v = Views(spark, "/root/testdata/sf0.001")
    done = {tuple(r) for r in v("f_house_geocode").filter("status = 'OK' AND house_number <> 'x'").selectExpr("district_id", "street", "CAST(house_number AS INT)").collect()}
    streets = {}
    for r in assign.expand_ranges(queries.range_rows(v)).collect():
        streets.setdefault((r["district_id"], r["street"]), []).append(r["house_number"])
    want = {(*k, sorted(n)[i * len(n) // min(len(n), 100)]) for k, n in streets.items() for i in range(min(len(n), 100))} - done
    assert max(map(len, streets.values())) > 10
    assert {(r["district_id"], r["street"], r["house_number"]) for r in QUERIES["house_worklist"](spark, "/root/testdata/sf0.001").collect()} == want


def test_island_stats_and_empty_parts(spark):
    cells = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 0, 5), (1, 4, 0, 5)], "municipality_id long, cx long, cy long, district_id long")
    labelled = tessellate.parts(cells)
    houses = spark.createDataFrame([(1, 5, "B", "2", 50.0, 50.0), (1, 5, "A", "10", 150.0, 10.0), (1, 5, "A", "2", 10.0, 10.0), (1, 6, "Z", "1", 410.0, 10.0)], "municipality_id long, district_id long, street string, house_number string, x double, y double")
    got = {r["part"]: r for r in tessellate.island_stats(labelled, houses, 100.0).collect()}
    assert (got[0]["streets"], got[0]["house_numbers"], got[0]["houses"], got[0]["area_m2"]) == (["A", "B"], ["10", "2"], 3, 20000.0)
    assert (got[1]["streets"], got[1]["house_numbers"], got[1]["houses"]) == ([], [], 0)


def test_rows_to_be_shown(spark):
    codes = spark.createDataFrame([(1, True, 21.0), (2, None, 21.0), (3, False, 21.0), (4, True, None)], "id long, valid boolean, lon double").withColumn("lat", F.col("lon"))
    assert sorted(r["id"] for r in clean.house_dots(codes).collect()) == [1, 2]
    schools = spark.createDataFrame([(1, 7, 1.0, 1.0), (2, None, 1.0, 1.0), (3, 7, None, 1.0)], "school_id long, founder_id long, x double, y double")
    founders = spark.createDataFrame([(7, "Mesto", "obec")], "founder_id long, name string, type string")
    assert sorted((r["school_id"], r["founder_name"]) for r in clean.school_markers(schools, founders).collect()) == [(1, "Mesto"), (2, None)]
    public = spark.createDataFrame([(1, "high", 4, False), (2, "critical", 5, False), (3, "medium", 3, True), (4, "low", 2, True)], "finding_id long, severity string, severity_rank int, is_demo boolean")
    assert [r["finding_id"] for r in serve.findings_panel_order(public).collect()] == [3, 2, 1]
    assert sorted((r["place"], r["finding_id"]) for r in serve.findings_panel_places(public).collect()) == [(1, 3), (2, 2), (3, 1)]


def test_places_in_an_order_are_numbered_range_by_range(spark):
    rows = spark.range(0, 5000, 1, 7).select(F.col("id"), F.when(F.col("id") % 11 != 0, F.col("id") * 7919 % 1000).alias("x"))
    got = serve.numbered(rows.repartition(9), F.col("x").desc_nulls_last(), F.col("id")).collect()
    want = sorted(((r["x"], r["id"]) for r in got), key=lambda t: (t[0] is None, -(t[0] or 0), t[1]))
    assert [(r["x"], r["id"]) for r in sorted(got, key=lambda r: r["place"])] == want and sorted(r["place"] for r in got) == list(range(1, 5001))
    assert serve.numbered(rows.limit(0), F.col("x"), F.col("id")).columns == ["id", "x", "place"] and serve.numbered(rows.limit(0), F.col("id")).count() == 0


def test_prefix_match_with_a_common_beginning(spark):
    points = spark.createDataFrame([(i, f"Ulica {i % 30}") for i in range(300)] + [(900, "ul"), (901, None), (902, "")], "point_id long, street string")
    streets = spark.createDataFrame([(1, " ulica 1"), (2, "Ulica"), (3, "Ulica 299x"), (4, ""), (5, None)], "street_id long, street string")
    got = {}
    for r in assign.prefix_match(points, streets, most=5).collect():
        got.setdefault(r["street_id"], []).append(r["point_id"])
    p = {i: (s or "").strip().lower() for i, s in [(i, f"Ulica {i % 30}") for i in range(300)] + [(900, "ul"), (902, "")]}
    for k, s in ((1, "ulica 1"), (2, "ulica"), (3, "ulica 299x"), (4, "")):
        assert sorted(got[k]) == sorted(i for i, x in p.items() if x.startswith(s) or s.startswith(x))[:5]
    assert 5 not in got


def test_origins_with_the_centroid_first(spark):
    addresses = spark.createDataFrame([(1, i) for i in range(30)], "district_id long, address_id long")
    centroids = spark.createDataFrame([(1, None), (2, None)], "district_id long, address_id long")
    got = serve.sample_origins(addresses.limit(10), n=12, centroids=centroids, buildings=addresses.withColumn("address_id", F.col("address_id") + 100)).collect()
    kinds = sorted(r["kind"] for r in got if r["district_id"] == 1)
    assert kinds == ["address"] * 10 + ["building", "centroid"] and [r["kind"] for r in got if r["district_id"] == 2] == ["centroid"]


def test_area_drift_and_overlays(spark):
    box = lambda rows, names: spatial.box_polygons(spark.createDataFrame(rows, names + ", x0 double, y0 double, x1 double, y1 double"))
    districts = box([(1, 9, 0.0, 0.0, 10.0, 10.0), (2, 9, 10.0, 0.0, 20.0, 10.0)], "district_id long, municipality_id long")
    bounds = box([(9, 0.0, 0.0, 20.0, 10.05)], "municipality_id long")
    r = spatial.area_totals(districts, bounds).first()
    assert (r["districts"], r["area"], r["within"]) == (2, 200.0, True) and abs(r["boundary_area"] - 201.0) < 1e-9
    assert spatial.area_totals(districts, bounds, drift=0.001).first()["within"] is False
    overlays = box([(1, 5.0, 5.0, 6.0, 6.0), (2, 20.0, 0.0, 30.0, 10.0), (3, 19.0, 9.0, 30.0, 30.0)], "id long")
    assert sorted(x["id"] for x in spatial.overlays_in_scope(overlays, districts, "id").collect()) == [1, 3]


def test_house_numbers_in_formatted_addresses(spark):
    cases = {"Bajkalská 199, 080 01 Prešov": "199", "Sabinovská 4862/17": "17", "Vihorlatská 6499/2, Sekčov, 080 01": "2", "Mesto": None, "Ulica 5 080 01 Mesto, SK": "5", "X 12345, Y": "12345", "": None}
    got = {r["a"]: r["h"] for r in spark.createDataFrame([(k,) for k in cases], "a string").select("a", clean.house_from_address("a").alias("h")).collect()}
    assert got == cases


def test_measured_catalogue(spark):
    from zonecheck.sources import io

    df = spark.createDataFrame([(1, "a"), (2, None), (None, None)], "x long, y string")
    assert io.measured(df, "k", ["x", "y"], F.col("x") == 1, "v").first()[1:] == (3, 5, 4, "v")
    assert io.measured(df.limit(0), "k", ["x"], F.lit(True), "v").first()[1:4] == (0, 1, 1)
    with pytest.raises(Exception, match="driver and all executors"):  # a cluster needs a shared folder
        from zonecheck.sources import shared

        class Fake:
            class sparkContext:  # noqa: N801
                master = "spark://host:7077"

                @staticmethod
                def getConf():
                    return {}

        shared.shared_dir(Fake)


def test_scope_filter_meets_names_by_trigrams(spark):
    targets = [("1", "Mesto A"), ("2", "ab"), (None, "Lesná"), ("4", None), ("5", "Mesto A")]
    points = [(1, "1", None), (2, "9", "staré MESTO a1"), (3, None, "xABx"), (4, "4", "zzz"), (5, None, "lesná"), (6, "9", "lesn"), (7, None, None), (8, "5", "mesto a"), (8, "5", "mesto a"), (9, "9", "")]
    t, p = spark.createDataFrame(targets, "code string, name string"), spark.createDataFrame(points, "id int, municipality_code string, municipality_name string")
    want = lambda ts: sorted(i for i, c, n in points if any((c is not None and c == code) or (n is not None and name is not None and name.lower() in n.lower()) for code, name in ts))
    got = clean.scope_filter(p, t)
    assert sorted(r["id"] for r in got.collect()) == want(targets) and got.columns == p.columns
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    blank = [*targets, ("6", "")]
    assert sorted(r["id"] for r in clean.scope_filter(p, spark.createDataFrame(blank, t.schema)).collect()) == want(blank)


def test_demo_values_leave_the_evidence_behind(spark, monkeypatch):
    from zonecheck.plans import QUERIES

    seen, latest = [], serve.latest_verdicts
    monkeypatch.setattr(serve, "latest_verdicts", lambda df: seen.append(df.columns) or latest(df))
    assert QUERIES["with_demo_values"](spark, "/root/testdata/sf0.001").columns == ["district_id", "condition_code", "value", "demo_value"]
    assert seen and not {"evidence_text", "source"} & set(seen[0])


def test_house_worklist_equals_its_steps_and_shuffles_no_house_numbers(spark):
    rows = [(1, "a", "range", [1, 350]), (1, "a", "single", [7]), (1, "a", "single", [None]), (1, "b", "all", []), (1, "a", "single", None), (1, "c", "odd", [3]), (2, "a", "even", [2, 8]), (2, "a", "range", [4, 5, 9]), (2, None, "single", [3])]
    ranges = spark.createDataFrame(rows, "district_id int, street string, range_type string, numbers array<int>")
    done = spark.createDataFrame([(1, "a", 4), (1, "a", None), (1, "a", 7), (2, "a", 8), (2, None, 3), (3, "a", 1)], "district_id int, street string, house_number int")
    keys = ["district_id", "street", "house_number"]
    steps = assign.pending(assign.sample_evenly(assign.expand_ranges(ranges), keys[:2], keys[2:], 100), done, keys)
    got = assign.house_worklist(ranges, done, 100)
    count = lambda df: sorted(((tuple(r)) for r in df.collect()), key=str)
    assert count(got) == count(steps) and got.columns == keys
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and not [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "house_number" in x]
