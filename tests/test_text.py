import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from zonecheck.functions import text as T
from zonecheck.operators import ordinance

PII = [
    ("kontakt 0903 123 456 koniec", "kontakt [tel] koniec"), ("volaj 0911-222-333", "volaj [tel]"), ("stacionar 02 1234 5678", "stacionar [tel]"), ("+421 905 123 456", "[tel]"), ("00421 911 222 333", "[tel]"),
    ("email jan.novak@example.com koniec", "email [email] koniec"), ("rodne cislo 880101/1234", "rodne cislo [rč]"), ("email a@b.sk a tel 0905 999 888", "email [email] a tel [tel]"), ("normalny text bez PII data", "normalny text bez PII data"), (None, ""),
]


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", f("v").alias("o")).orderBy("i").collect()]


def test_masking(spark):
    assert column(spark, [a for a, _ in PII], lambda c: T.mask_pii(c, 500)) == [b for _, b in PII]
    assert [len(x) for x in column(spark, ["x" * 700], lambda c: T.mask_pii(c, 500))] == [500]
    import random

    r = random.Random(3)
    parts = ["ab cd", "x@y.sk", "mail" + "m" * 300 + "@long.example.sk", "0905 123 456", "+421 905-123-456", "850101 " + " " * 40 + "/ 1234", "words and words", "\n", "ľúbi", "12", "."]
    texts = ["".join(r.choice(parts) + r.choice([" ", "", " \n"]) for _ in range(r.randrange(1, 60))) for _ in range(120)]
    for most in (20, 60):  # as if the whole text were looked at
        assert column(spark, texts, lambda c: T.mask_pii(c, most)) == column(spark, texts, lambda c: F.left(T._masked(c), F.lit(most)))
    once = column(spark, [a for a, _ in PII], lambda c: T.mask_pii(c, 500))
    assert column(spark, once, lambda c: T.mask_pii(c, 500)) == once


def test_addresses_are_masked_as_by_the_plain_pattern_and_long_words_read_once(spark):
    import random
    import re

    r = random.Random(5)
    texts = ["".join(r.choice(["a", "b9", ".", "@", "-", " ", "x@y.sk", ".com", "@d.org", "%", "ž"]) for _ in range(r.randrange(1, 30))) for _ in range(400)]
    texts += ["a@b.com.x@d.org", "a@b.com@c.de", ".@..aa", "@a.bc"]
    plain = [re.sub(T.PERSONAL, "[rč]", re.sub(T.PHONE, "[tel]", re.sub(T.MAIL, "[email]", t))) for t in texts]
    assert column(spark, texts, T._masked) == plain
    assert column(spark, ["q" * 2_000_000], lambda c: F.length(T.mask_pii(c, 300))) == [300]


def test_street_keys(spark):
    same = [("Tehelná.", "Tehelná"), ("Mätová ulica", "Mätová"), ("Ulica Štefana Náhalku.", "Štefana Náhalku"), ("Pőschlova", "Pöschlova"), ("K Starej Tehelni", "K Starej tehelni"), ("Arm. gen. Svobodu", "Armádneho generála Svobodu")]
    a, b = (column(spark, [x[i] for x in same], T.norm_street) for i in range(2))
    assert a == b and a[0] == "tehelna" and column(spark, [None], T.norm_street) == [None]
    assert column(spark, ["Hlavná č. 12", "ul.  Dlhá"], T.norm_building_street) == ["hlavna", "dlha"]


def test_hosts_and_slugs(spark):
    urls = ["https://www.slov-lex.sk/x", "http://SLOV-LEX.sk:80/", "https://evil-slov-lex.sk", "slov-lex.sk", None, "ftp://gov.sk"]
    assert column(spark, urls, T.host_in_allowlist) == [True, True, False, True, False, False]
    assert column(spark, ["Poprad", "Veľký Šariš"], T.slug) == ["poprad", "velky-saris"]
    assert column(spark, ["Poprad"], lambda c: T.slug(c, as_written=True)) == ["-oprad"]


def test_codes(spark):
    assert column(spark, ["S1", "Pf", "X"], T.condition_order) == [1, 9, 99]
    assert column(spark, ["critical", "info", None, "low"], T.severity_rank) == [5, 1, 1, 2]
    assert column(spark, ["FAIL", "PASS", "SIGNAL"], T.severity_of) == ["critical", "info", "medium"]
    assert column(spark, ["X"], T.condition_label) == ["X"]


def test_lists_and_numbers(spark):
    assert column(spark, ["A (1, 2), B,, C "], T.split_outside_parens) == [["A (1, 2)", "B", "C"]]
    assert column(spark, ["93 – 101, 105 – 117, 119", "x, 4", None, "30, 20 - 10"], T.number_list) == [[93, 101, 105, 117, 119], [4], [], [30, 20, 10]]
    assert column(spark, ["12A", "A12", None, " 7/3"], T.house_int) == [12, None, None, 7]
    assert column(spark, ["12/3A", "x"], T.only_digits) == [123, None]
    assert column(spark, ["Horná (žiaci 5. ročníka), Dolná; Malá", "–", "", None], T.shared_municipalities) == [["Horná", "Dolná", "Malá"], [], [], []]


def test_json(spark):
    merged = spark.range(1).select(T.json_merge(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3")))).first()[0]
    assert json.loads(merged) == {"a": "1", "b": "3"}


QUALIFIERS = {
    "nepárne čísla": [("odd", [])], "párne čísla od 2 – 160": [("even", [2, 160])], "nepárne čísla 1 – 169": [("odd", [1, 169])], "číslo 6, číslo 12": [("single", [6]), ("single", [12])], "čísla 4 – 5": [("range", [4, 5])], "27 – 29": [("range", [27, 29])],
    "nepárne č. 93 – 101, 105 – 117, 119, párne č. 62 – 72": [("odd", [93, 101, 105, 117, 119]), ("even", [62, 72])], None: [("all", [])], "8": [("single", [8])], "párne": [("even", [])], "po most": [("all", [])],
}


@pytest.mark.parametrize("qualifier", list(QUALIFIERS))
def test_qualifiers(spark, qualifier):
    df = spark.createDataFrame([("Hlavná", qualifier)], "street string, qualifier string")
    assert [(r["range_type"], r["numbers"]) for r in ordinance.street_ranges(df).collect()] == QUALIFIERS[qualifier]


def test_ordinance_text(spark):
    text = "Článok 1\n1. Základná škola, Bajkalská 29:\nHlavná (nepárne čísla 1 – 9), Dlhá,\nHlavná (číslo 12)\nObec: Malá (žiaci 5. – 9. ročníka), Veľká\n2. Základná škola Kúpeľná:\nKrátka\n"
    blocks = ordinance.ordinance_blocks(spark.createDataFrame([(7, text)], "vzn_id int, raw_text string"))
    got = {r["number"]: r for r in blocks.collect()}
    assert got[1]["address"] == "Bajkalská 29" and got[1]["municipalities"] == ["Malá", "Veľká"] and got[2]["address"] is None and got[2]["municipalities"] == []
    entries = [(r["number"], r["street"], r["qualifier"]) for r in ordinance.street_entries(blocks).collect()]
    assert sorted(entries, key=str) == sorted([(1, "Hlavná", "nepárne čísla 1 – 9"), (1, "Dlhá", None), (1, "Hlavná", "číslo 12"), (2, "Krátka", None)], key=str)


def test_classes_of_streets(spark):
    register = ["Tehelná", "Mätová", "Jabloňová", "Herlianska", "Terchovská", "Ax"]
    listed = ["Tehelná", "Mätová ulica", "Jaboňová", "Herľanská", "Gerlachovská", "Neznáma", "Bx"]
    o, r = (spark.createDataFrame([(1, s) for s in x], f"municipality_id int, {c} string") for x, c in ((listed, "street"), (register, "ulica")))
    got = {x["street"]: (x["match_class"], x["best"], x["score"]) for x in ordinance.classify_streets(o, r).collect()}
    keys = {s: column(spark, [s], T.norm_street)[0] for s in [*listed, *register]}
    for s in listed:
        best = max((round(difflib.SequenceMatcher(None, keys[s], keys[x]).ratio(), 3), x) for x in register)
        if s in register:
            assert got[s] == ("EXACT", s, 1.0)
        elif keys[s] in [keys[x] for x in register]:
            assert got[s][0] == "NORMALIZED"
        elif best[0] >= 0.8:
            assert got[s] == ("FUZZY", best[1], best[0])
        else:
            assert got[s] == ("NOT_FOUND", None, None)
    assert got["Jaboňová"][0] == "FUZZY" and got["Neznáma"][0] == "NOT_FOUND"


@pytest.mark.parametrize("block", [None, 7])
def test_classes_agree_with_the_full_product(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(ordinance, "BLOCK", block)
    r = random.Random(3)
    name = lambda: "".join(r.choice("abcdenorst ") for _ in range(r.choice([4, 5, 6, 9, 30, 70]))).strip()
    register = {m: sorted({name() for _ in range(60)} | {"jasna", "letna", "hodna", "zz"}) for m in (1, 2)}
    listed = {m: sorted({name() for _ in range(60)} | {"jarna", "lesna", "horna", "qqq"} | {x[:2] + r.choice("xyz") + x[3:] for x in register.get(m, []) if len(x) > 4}) for m in (1, 2, 3)}
    o, g = (spark.createDataFrame([(m, s) for m, x in side.items() for s in x], f"municipality_id int, {c} string") for side, c in ((listed, "street"), (register, "ulica")))
    for nearest in (True, False):
        got = {(x["municipality_id"], x["street"]): (x["match_class"], x["best"], x["score"]) for x in ordinance.classify_streets(o, g, nearest=nearest).collect()}
        assert len(got) == sum(map(len, listed.values()))
        for m, streets in listed.items():
            streets_of = register.get(m, [])
            keys = dict(zip(streets_of, column(spark, streets_of, T.norm_street), strict=True)) if streets_of else {}
            for s, k in zip(streets, column(spark, streets, T.norm_street), strict=True):
                if s in streets_of or k in keys.values():
                    assert got[m, s][0] in ("EXACT", "NORMALIZED")
                    continue
                best, score = None, 0.0
                for x in streets_of:
                    if (y := difflib.SequenceMatcher(None, k, keys[x]).ratio()) > score:
                        best, score = x, y
                want = ("FUZZY" if score >= 0.8 else "NOT_FOUND", best, round(score, 3))
                assert got[m, s] == (want if nearest or score >= 0.8 else ("NOT_FOUND", None, None))
        assert got[1, "jarna"][0] == got[1, "lesna"][0] == got[1, "horna"][0] == "FUZZY"
