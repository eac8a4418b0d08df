"""Results do not depend on the number of templates, on widths of vectors, on the length of words or of texts."""

import pytest

pytest.importorskip("public_tokenizers")
import numpy as np
from pyspark.sql import functions as F

from zonecheck.llm import ann, decontaminate, license_scan, line_dedup, shingles

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("words", [5000, 0])
def test_templates_with_capitals_beyond_ascii(spark, monkeypatch, words):
    monkeypatch.setattr(license_scan, "FILTER_WORDS", words)
    templates = spark.createDataFrame([(0, "frei", False, "Über lizenz frei für alle"), (1, "i", False, "İZİN Ärger ΣΑΣ und Straße hier")], "template int, label string, exact boolean, text string")
    docs = spark.createDataFrame([(1, "Über lizenz frei für alle"), (2, "über lizenz frei für"), (3, "x İZİN Ärger ΣΑΣ und Straße hier y")], DOCS)
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan_documents(docs, templates).collect()}
    assert got == {1: "frei", 2: "", 3: "i"}


def test_vectors_of_several_widths(spark):
    r = np.random.default_rng(3)
    vectors = [(i, r.normal(size=4).tolist()) for i in range(60)] + [(i, r.normal(size=3).tolist()) for i in range(100, 130)] + [(140, [1.0])]
    got = {}
    for x in ann.neighbours(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), every=20, k=5).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"]))
    want = {}
    for q, v in vectors:
        if q % 20 == 0:
            near = sorted((-float(np.dot(v, u)), i) for i, u in vectors if i != q and len(u) == len(v))[:5]
            if near:
                want[q] = [(k + 1, i) for k, (_, i) in enumerate(near)]
    assert {q: sorted(x) for q, x in got.items()} == want and {100, 120} <= set(got)


def test_long_words_are_one_word(monkeypatch):
    texts = [b"a" * 700_000, b"x " + b"b" * 300_000 + b" y", b"ab" * 200_000 + b"-" + b"ab" * 200_000]
    assert [shingles.word_hashes([t])[1][0] for t in texts] == [1, 3, 2]
    two = shingles.word_hashes([texts[2]])[0]
    assert two[0] == two[1] == shingles.word_hashes([b", " + b"AB" * 200_000])[0][0]
    text = b" ".join(b"word%d" % (i * 7919) for i in range(300)) + b"  ,," + b"c" * 90
    whole = shingles.word_hashes([text])[0]
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(shingles, "LONGEST", size)
        assert shingles.word_hashes([text])[0].tolist() == whole.tolist()


def test_items_with_long_words_are_found(spark):
    item = " ".join(["alpha", "b" * 300_000, "gamma", "delta", "epsilon", "zeta"])
    docs = spark.createDataFrame([(1, "begin " * 30 + item + " end" * 30), (2, item.replace("b", "c", 1))], DOCS)
    items = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["containment"]) for r in decontaminate.contaminated(docs, items, containment=0.8, width=5).collect()] == [(1, 5, 1.0)]


def test_texts_of_very_many_lines(spark):
    lines = [f"line {i} of a text with the number {i * 7919 % 10007}" for i in range(40_000)]
    later = [x if i % 50 else x + " changed" for i, x in enumerate(lines)]
    got = {r["doc_id"]: r for r in line_dedup.marked(spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(later))], DOCS)).collect()}
    assert (got[1]["n_removed"], got[2]["n_removed"]) == (0, 39_200)
    assert got[2]["kept"].split("\n") == later[::50] and got[1]["kept"] == "\n".join(lines)
