import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers
from pyspark.sql import functions as F

from zonecheck.llm import ann, bpe, common, decontaminate, jaccard_join, language_id, license_scan, line_dedup, suffix_dedup, token_count, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and zone school street house number river bridge hill market old new green long road park lake stone".split()


def prose(seed, n=80):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def lines(seed, n=6):
    return "\n".join(prose(f"{seed}-{i}", 12) for i in range(n))


#: Nulls, empty texts, ties, repeated rows, a text beyond every chunk, and what each operator looks for.
TEXTS = [
    None, "", "   ", "!!! 123 ???", "a", "ab" * 400, prose(1), prose(1), prose(1).replace("river", "delta", 1), prose(2), lines(3), lines(3).replace("\n", "\n" + prose(77, 9) + "\n", 1), lines(4) + "\n" + lines(3),
    "x" * 1300, "Released under the MIT License. mit license", "This work is licensed under the GNU General Public License, version 3.", "żółć ñandú 日本語 🙂 \x00 \x07", "\n\n\n", "word " * 9000, prose(9, 4000),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [(None, prose(5), None, None, None), (6, TEXTS[6], "en", "s", 1), (6, TEXTS[6], "en", "s", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return [r.asDict() for r in df.collect()]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text, k=5):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


# --- 1


def test_bpe_agrees_with_tiktoken(docs, empty):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(bpe.encode(docs.withColumn("IDS", F.lit(1)), path, public_tokenizers.PATTERN))
    assert len(got) == docs.count()
    for r in got:
        assert r["ids"] == known.encode_ordinary(r["text"] or "")
    for r in rows(bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path)):
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    d = {r["doc_id"]: r for r in rows(bpe.digests(docs, path, public_tokenizers.PATTERN))}
    ids = known.encode_ordinary(TEXTS[6])
    assert d[6]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and d[6]["n_tokens"] == len(ids)
    assert d[0]["decoded_sha256"] == hashlib.sha256(b"").hexdigest() and d[0]["n_tokens"] == 0
    assert rows(bpe.digests(empty, path, public_tokenizers.PATTERN)) == []


# --- 2


def test_language_of_held_out_documents(spark, empty):
    base = {"aa": "lorem ipsum dolor amet consectetur", "bb": "das ist ein haus und der garten", "cc": "çà été où naïve élève"}
    r = random.Random(3)
    made = [(i, " ".join(r.choice(base[lang].split()) for _ in range(30)), lang) for i in range(300) for lang in [sorted(base)[i % 3]]]
    df = spark.createDataFrame([*made, (1000, None, "aa"), (1001, "12 !", "aa"), (1002, made[0][1] + " " + made[1][1][:60], None)], "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in rows(language_id.predict_documents(df))}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in made)
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und" and got[1000]["score"] == 0
    assert got[1002]["n_langs"] == 2 and 0 < got[1002]["score"] < 1
    import zlib

    assert all(x["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, x in got.items())
    assert rows(language_id.predict_documents(empty)) == []
    kept = language_id.keep_identified(df.withColumn("score", F.lit("own")), language_id.fit(df))
    assert kept.columns == ["doc_id", "text", "lang", "score"] and {1000, 1001} & {x["doc_id"] for x in rows(kept)} == set()


def test_fitting_takes_no_held_out_labels(spark):
    df = spark.createDataFrame([(i, f"wort{i} satz", "xx" if i % 2 else "yy") for i in range(40)], "doc_id long, text string, lang string")
    model = language_id.fit(df.filter(~language_id.held_out()).withColumn("lang", F.lit("only")))
    assert model.langs == ["only"]


def brute_inference(model, text, penalty, temper, rounds):
    """EM and the choice of the set for one text, word by word."""
    import math

    logp = model.logp.astype(float)
    words = []
    for w in re.findall(r"[^\W\d_]+", text):
        grams = language_id.words_of([w]).grams
        logs = [temper * sum(logp[g][k] for g in grams) for k in range(len(model.langs))]
        words.append([math.exp(max(x - max(logs), -60.0)) for x in logs])

    def mixture(langs, n):
        share = {k: 1 / len(langs) for k in langs}
        for _ in range(n):
            sums = dict.fromkeys(langs, 0.0)
            for w in words:
                total = sum(share[k] * w[k] for k in langs)
                for k in langs:
                    sums[k] += share[k] * w[k] / total
            share = {k: x / len(words) for k, x in sums.items()}
        return share, sum(math.log(sum(share[k] * w[k] for k in langs)) for w in words)

    every = list(range(len(model.langs)))
    share, _ = mixture(every, rounds)
    order = sorted(every, key=lambda k: -share[k])
    best = None
    for size in range(1, len(order) + 1):
        got, fit = mixture(order[:size], rounds if size > 1 else 0)
        value = fit - penalty * math.log(len(words) + 1) * size
        if best is not None and value <= best[0]:
            break
        best = (value, got, size)
    lead = max(best[1], key=best[1].get)
    return lead, best[1][lead], best[2]


def test_inference_against_brute_force(spark, monkeypatch):
    base = {"aa": "lorem ipsum dolor amet consectetur sit", "bb": "das ist ein haus und der garten", "cc": "çà été où naïve élève dor", "dd": "the house and the green garden is"}
    r = random.Random(6)
    made = [(i, " ".join(r.choice(base[lang].split()) for _ in range(20)), lang) for i in range(200) for lang in [sorted(base)[i % 4]]]
    model = language_id.fit(spark.createDataFrame([*made, (None, "das haus", None), (None, None, "aa")], "doc_id long, text string, lang string"))
    texts = [" ".join(r.choice(base[r.choice(langs)].split()) for _ in range(r.randrange(1, 60))) for _ in range(80) for langs in [r.sample(sorted(base), r.randrange(1, 4))]]
    best, score, kept = language_id.infer(model, texts, 3.0, 0.5, 8)
    expected = [brute_inference(model, t, 3.0, 0.5, 8) for t in texts]
    assert [e[0] for e in expected] == best.tolist() and [e[2] for e in expected] == kept.tolist() and len(set(kept.tolist())) > 1
    assert np.allclose([e[1] for e in expected], score, atol=1e-4)
    # a text in pieces gives what the whole gives
    long = " ".join(texts) + " 123 "
    whole = language_id.infer(model, [long], 3.0, 0.5, 8)
    monkeypatch.setattr(language_id, "CHUNK", 100)
    assert "".join(language_id.pieces(long)) == long and max(map(len, language_id.pieces(long))) <= 100
    parts = language_id.infer(model, [long], 3.0, 0.5, 8)
    assert whole[0] == parts[0] and abs(whole[1][0] - parts[1][0]) < 1e-6 and whole[2] == parts[2]
    with pytest.raises(ValueError, match="more than 3 languages"):
        language_id.fit(spark.createDataFrame(made, "doc_id long, text string, lang string"), most=3)


# --- 3


def test_licenses_against_brute_force(docs, empty):
    got = {}
    for r in rows(license_scan.scan_documents(docs)):
        got.setdefault(r["doc_id"], r)
    for i, text in enumerate(TEXTS):
        w = words_of(text)
        places = [(k, label) for label, phrase in license_scan.PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert r["first_word"] == (min(places)[0] if places else None) and r["last_word"] == (max(places)[0] if places else None)
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert rows(license_scan.scan_documents(empty)) == []


def brute_labels(text, coverage=0.85, slack=2, alike=0.8):
    """Spans of the templates by a dense table of votes."""
    w, out = words_of(text), set()
    for label, passage in license_scan.TEMPLATES:
        t = passage.split()
        votes = sorted({(i - j, i, j) for i in range(len(w) - 1) for j in range(len(t) - 1) if w[i : i + 2] == t[j : j + 2]})
        runs = []
        for d, i, j in votes:
            if runs and d - runs[-1][-1][0] <= slack:
                runs[-1].append((d, i, j))
            else:
                runs.append([(d, i, j)])
        for run in runs:
            first, last = min(i for _, i, _ in run), max(i for _, i, _ in run) + 1
            if len({j for *_, j in run}) / (len(t) - 1) >= coverage and last - first + 1 <= len(t) + 2 * slack:
                a, b = " ".join(w[first : last + 1]), passage
                row = list(range(len(b) + 1))
                for x, c in enumerate(a):
                    row = [x + 1]
                    for y, e in enumerate(b):
                        row.append(min(before[y] + (c != e), before[y + 1] + 1, row[y] + 1) if x else min(y + (c != e), y + 2, row[y] + 1))
                    before = row
                if row[-1] <= (1 - alike) * max(len(a), len(b)):
                    out.add(label)
    return out


def test_license_labels_against_brute_force(spark):
    r = random.Random(9)
    texts = []
    for _, passage in license_scan.TEMPLATES:
        w = passage.split()
        for edits in range(5):
            v = w[:]
            for _ in range(edits):
                at = r.randrange(len(v))
                v[at : at + r.randrange(2)] = [r.choice(["any", "software", "considerably"])] * r.randrange(1, 3)
            texts.append(prose(len(texts), 8) + ". " + " ".join(v).title() + "; " + prose(len(texts), 5))
    texts += [" ".join(r.sample(passage.split(), len(passage.split()))) for _, passage in license_scan.TEMPLATES]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("label", F.lit("own")).withColumn("words", F.lit("own")).withColumn("key", F.lit(1))
    got = {x["doc_id"]: x for x in rows(license_scan.scan_documents(df))}
    some = 0
    for i, text in enumerate(texts):
        expected = brute_labels(text)
        some += bool(expected)
        assert set(filter(None, got[i]["labels"].split(","))) == expected | set(filter(None, got[i]["base_labels"].split(",")))
    assert 20 < some < len(texts)


def test_license_templates_of_ones_own_and_repeated_rows(spark, monkeypatch):
    own = spark.createDataFrame([(0, "house", False, "all rights are kept by the house"), (1, "short", True, "kept by")], "template int, label string, exact boolean, text string")
    df = spark.createDataFrame([(1, "Here all rights are kept by the House."), (1, "Here all rights are kept by the House."), (2, "kept, by no one"), (None, None)], "doc_id long, text string")
    for filter_words in (5000, 2):
        monkeypatch.setattr(license_scan, "FILTER_WORDS", filter_words)
        monkeypatch.setattr(common, "BROADCAST_ROWS", filter_words)
        got = sorted(((x["doc_id"] or 0, x["labels"], x["n_base"]) for x in rows(license_scan.scan_documents(df, own))))
        assert got == [(0, "", 0), (1, "house,short", 1), (1, "house,short", 1), (2, "short", 1)]


def test_license_with_words_put_in(spark):
    text = "permission is hereby granted free of any charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
    r = rows(license_scan.scan_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")))[0]
    assert r["labels"] == "mit" and r["n_base"] == 0


# --- 4


def brute_groups(texts, threshold=0.8):
    sets = {i: shingles(t) for i, t in texts.items()}
    links = {i: {j for j in sets if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])} for i in sets}
    root = {i: i for i in sets}
    while True:
        low = {i: min([root[i], *(root[j] for j in links[i])]) for i in sets}
        if low == root:
            return links, root
        root = low


@pytest.mark.parametrize("small", [64, 2])
def test_jaccard_join_against_brute_force(spark, small):
    base = prose(11, 120).split()
    texts = {}
    for i in range(40):  # a group of near copies of each other, some below the threshold
        w = base[:]
        for k in range(i % 5):
            w[(7 * i + 31 * k) % 120] = f"edit{i}x{k}"
        texts[i] = " ".join(w)
    texts |= {100 + i: prose(i + 50) for i in range(30)} | {200: prose(50), 201: None, 202: "", 203: "one two", 204: "One two!"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    links, root = brute_groups(texts)
    got = {r["doc_id"]: r for r in rows(jaccard_join.link(df, small=small))}
    assert {i: r["n_links"] for i, r in got.items()} == {i: len(x) for i, x in links.items()}
    assert {i: r["class_id"] for i, r in got.items()} == root


def test_jaccard_join_with_hot_keys(spark, monkeypatch):
    """Copies of one text and a group of near copies hold most rows, and their keys are dealt out."""
    monkeypatch.setattr(common, "HOT_SHARE", 10)
    near = prose("near", 120).split()
    texts = [prose("copy", 60)] * 40 + [" ".join([*near[:i], f"x{i}", *near[i + 1 :]]) for i in range(0, 120, 4)] + [prose(f"own {i}", 60) for i in range(20)]
    got = rows(jaccard_join.link(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    sets = [shingles(t) for t in texts]
    links = {i: sum(len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)}
    assert {r["doc_id"]: r["n_links"] for r in got} == links and len(got) == 90
    assert {r["doc_id"]: r["class_id"] for r in got} == {i: 0 if i < 40 else 40 if i < 70 else i for i in range(90)}
    assert sorted(r["doc_id"] for r in got if r["leads"]) == [0, 40, *range(70, 90)]


def test_jaccard_join_odd_rows(docs, empty):
    got = rows(jaccard_join.link(docs))
    assert sum(r["doc_id"] == 6 for r in got) == 1 and sum(r["doc_id"] is None for r in got) == 1
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in rows(kept)]
    assert ids.count(6) == 3 and 7 not in ids and {0, 1, 9} <= set(ids)
    assert rows(jaccard_join.link(empty)) == [] and rows(jaccard_join.keep_one(empty)) == []


@pytest.mark.parametrize("shingles_a_block", [1 << 20, 300])
def test_blocks_count_each_pair_once(spark, monkeypatch, shingles_a_block):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", shingles_a_block)
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    base = prose(12, 100).split()
    texts = {i: " ".join(base[:i] + [f"w{i}"] + base[i + 1 :]) for i in range(30)}
    got = {r["doc_id"]: r["n_links"] for r in rows(jaccard_join.link(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), small=4))}
    assert got == {i: len(x) for i, x in brute_groups(texts)[0].items()}


# --- 5


def test_patience_aligns_common_lines():
    assert line_dedup.patience([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [(1, 1), (2, 2), (3, 4)]
    assert line_dedup.patience([], [1]) == [] and line_dedup.patience([1, 1], [1, 1]) == [(0, 0), (1, 1)]
    r = random.Random(1)
    for _ in range(50):
        a, b = ([r.randrange(12) for _ in range(r.randrange(15))] for _ in range(2))
        got = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))


def test_line_dedup(docs, empty):
    out = rows(line_dedup.marked(docs))
    assert len(out) == docs.count()
    by = {r["doc_id"]: r for r in out}
    assert by[10]["n_removed"] == 0 and by[7]["deleted"] and not by[6]["deleted"]
    assert by[11]["n_removed"] == 6 and by[11]["kept"] == prose(77, 9)
    assert by[12]["n_removed"] == 6 and by[12]["kept"] == lines(4)
    assert by[0]["kept"] is None and by[0]["n_lines"] == 0 and by[1]["kept"] == ""
    kept = line_dedup.dedup(docs)
    assert kept.columns == docs.columns
    got = {r["doc_id"]: r for r in rows(kept)}
    assert 7 not in got and got[12]["text"] == lines(4) and got[12]["n_chars"] == len(lines(4)) and got[9]["text"] == TEXTS[9]
    assert rows(line_dedup.dedup(empty)) == []


def test_a_common_line_alone_stays(spark):
    common = "this is a notice that very many documents share"
    df = spark.createDataFrame([(i, prose(i + 300, 20) + "\n" + common + "\n" + prose(i + 600, 20)) for i in range(30)], "doc_id long, text string")
    assert all(r["n_removed"] == 0 for r in rows(line_dedup.marked(df)))


@pytest.mark.parametrize("n", [8, 9, 30])
def test_passages_go_whatever_the_number_of_holders(spark, n):
    """A passage of one long line, and full lines parted by blank and short ones of which each text has another number."""
    single = prose(900, 60)
    parted = [prose(f"part {k}", 10) for k in range(3)]
    texts = [prose(i + 300, 20) + "\n" + single + "\n" + prose(i + 600, 20) for i in range(n)]
    texts += [prose(i + 1300, 20) + "\n" + ("\n" * (1 + i % 3) + "-\n").join(parted) + "\n" + prose(i + 1600, 20) for i in range(n)]
    out = {r["doc_id"]: r for r in rows(line_dedup.marked(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    for i in range(n):
        assert (single in out[i]["kept"]) == (i == 0) and prose(i + 300, 20) in out[i]["kept"] and prose(i + 600, 20) in out[i]["kept"]
        kept = out[n + i]["kept"]
        assert all((x in kept) == (i == 0) for x in parted) and prose(i + 1300, 20) in kept and prose(i + 1600, 20) in kept


def test_repeated_and_moved_passages_go(spark):
    assert line_dedup.patience([9, 1, 2, 8, 1, 2, 7], [5, 1, 2, 6]) == [(1, 1), (2, 2)]
    own = iter(range(5000, 6000))
    x = lambda: prose(next(own), 20)
    p, q, r = (prose(f"moved {k}", 12) + "\n-\n" + prose(f"moved {k} too", 12) for k in range(3))
    texts = [[x(), p, x(), p, x()], [x(), p, x()], [x(), p, x(), p, x()], [x(), q, x(), r, x()], [x(), r, x(), q, x(), q, x(), r, x()]]
    for more in (0, 10):  # rare lines, and lines of more holders than rare ones have
        held = texts + [[x(), p, x(), q, x(), r, x()] for _ in range(more)]
        frame = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(held)], "doc_id long, text string")
        kept = {d["doc_id"]: d["kept"] for d in rows(line_dedup.marked(frame))}
        for i, t in enumerate(held):
            assert kept[i] == "\n".join(t if i in (0, 3) else [y for y in t if y not in (p, q, r)])


def brute_line_dedup(texts):
    """Lines that go, by the rule: evidence as documented, each pair of a document and the first holder of some evidence aligned."""
    split = {i: t.split("\n") for i, t in texts.items()}
    kind = {i: [2 if len(x.strip()) >= 200 or len(x.split()) >= 50 else int(len(x.strip()) >= 25) for x in v] for i, v in split.items()}
    holders = {}
    for i, v in split.items():
        fulls = [(x, k) for x, k in zip(v, kind[i], strict=True) if k]
        for e in {((x,), k == 2) for x, k in fulls} | {((x, y), False) for (x, _), (y, _) in zip(fulls, fulls[1:], strict=False)}:
            holders.setdefault(e, []).append(i)
    shared = {e: v for e, v in holders.items() if len(v) > 1 and (len(e[0]) == 2 or e[1] or len(v) <= line_dedup.RARE)}
    gone = {i: set() for i in texts}
    for later in texts:
        for first in {min(v) for v in shared.values() if later in v and min(v) != later}:
            alone = {e[0][0] for e, v in shared.items() if len(e[0]) == 1 and later in v and min(v) == first}
            number = {x: n for n, x in enumerate(dict.fromkeys([*split[first], *split[later]]))}
            code = lambda i, number=number: [number[x] for x in split[i]]
            gone[later] |= set(line_dedup._deleted(code(first), code(later), kind[first], kind[later], {number[x] for x in alone}))
    # every line that is evidence by itself goes from every later document
    for e, v in shared.items():
        if len(e[0]) == 1:
            assert all(split[i].index(e[0][0]) in gone[i] for i in v if i != min(v))
    return {i: "\n".join(x for n, x in enumerate(v) if n not in gone[i]) for i, v in split.items()}


def test_line_dedup_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 3)  # some keys are salted
    r = random.Random(15)
    pool = [prose(f"pool {k}", 9) for k in range(60)] + [prose(f"long {k}", 55) for k in range(6)] + ["", "- -", "Heading"]
    texts = {}
    for i in range(120):
        parts = []
        for _ in range(r.randrange(1, 5)):
            at = r.randrange(len(pool) - 3)
            parts += r.choice([[prose(f"own {i} {r.random()}", 10)], pool[at : at + r.randrange(1, 5)], [pool[0], pool[1]], [r.choice(pool)]])
        texts[i] = "\n".join(parts) + f"\nthe end of document {i} which no other holds"
    out = {x["doc_id"]: x["kept"] for x in rows(line_dedup.marked(spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumns({"lines": F.lit(1), "__t": F.lit(1), "h": F.lit(1)})))}
    assert out == brute_line_dedup(texts)


# --- 6


def brute_cut(texts, length):
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, bytes(x for x, g in zip(t, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize("group", [4 << 20, 1000])
def test_suffix_dedup_against_brute_force(docs, empty, spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", group)
    shared = prose(21, 90)
    more = [(500 + i, prose(f"l{i}", 10 * i) + shared[i * 7 : 480 + i * 11] + prose(f"r{i}", 5 * i), None, None, None) for i in range(12)]
    frame = docs.filter("coalesce(doc_id, -1) <> 18 and coalesce(doc_id, -1) <> 19").unionByName(spark.createDataFrame(more, DOCS))
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows(suffix_dedup.cut(frame, 400)))
    assert got == brute_cut([(r["text"] or "").encode() for r in rows(frame)], 400)
    assert rows(suffix_dedup.cut(empty)) == []


def test_suffix_dedup_of_thue_morse_texts(spark):
    """Two texts of one run each, alike in the anchor in their middle only, whose polynomials modulo 2^64 are equal for every odd base."""
    turn = [bin(i).count("1") % 2 for i in range(256)]
    block = ["".join(pair[v] for v in turn) for pair in ("'u", "u'")]
    for seed in range(100):
        r = random.Random(seed)
        middle = "".join(r.choice("cdefghijklm") for _ in range(128))
        texts = [block[0] + middle + block[1], block[1] + middle + block[0]]
        runs = [suffix_dedup._passes([t.encode()], 400) for t in texts]
        if all(len(x[0]) == 1 for x in runs):
            break
    assert [list(x[3]) for x in runs][0] == [list(x[3]) for x in runs][1]
    texts += [texts[0][:450]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows(suffix_dedup.cut(docs, 400)))
    assert got == brute_cut([t.encode() for t in texts], 400)


# --- 7


def test_decontamination_against_brute_force(docs, empty, spark):
    items = {0: prose(2), 1: prose(9, 4000)[200:420], 2: prose(40, 20), 3: None, 4: "", 5: "just two", 6: prose(1).rsplit(" ", 5)[0]}
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in rows(decontaminate.contaminated(docs, table))}
    expected = set()
    for r in rows(docs):
        s = shingles(r["text"])
        expected |= {(r["doc_id"], i) for i, t in items.items() if shingles(t) and len(shingles(t) & s) >= 0.8 * len(shingles(t))}
    assert got == expected and expected
    kept = decontaminate.remove(docs, table)
    assert kept.columns == docs.columns and {r["doc_id"] for r in rows(kept)} == {r["doc_id"] for r in rows(docs)} - {d for d, _ in expected}
    assert rows(decontaminate.contaminated(empty, table)) == [] and rows(decontaminate.contaminated(docs, table.limit(0))) == []


def test_decontamination_by_minhash_alone(spark, monkeypatch):
    """Domains of one item of some length ask by MinHash; what they find does not come from shingle look-ups."""
    items = {i: prose(f"item {i}", 16 + 4 * i) for i in range(20)}
    texts = {i: prose(f"before {i}", 30 * i) + " " + items[i % 20] + " " + prose(f"after {i}", 3000 if i == 7 else 50) for i in range(60)}
    texts |= {100 + i: prose(f"clean {i}", 200) for i in range(20)} | {200 + i: texts[3] for i in range(30)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("class", F.lit("x")).withColumn("item_id", F.lit(-1))
    table = spark.createDataFrame(list(items.items()), "item_id long, text string").withColumn("n", F.lit(0)).withColumn("shingles", F.lit("x"))
    paths = decontaminate.probes(docs, decontaminate.item_shingles(table)).groupBy("path").count()
    counts = {r["path"]: r["count"] for r in rows(paths)}
    assert counts.get("minhash", 0) > 5 * counts.get("shingles", 0)
    every = decontaminate.item_keys
    monkeypatch.setattr(decontaminate, "item_keys", lambda own: every(own).filter("path = 'minhash'"))
    got = {(r["doc_id"], r["item_id"]) for r in rows(decontaminate.contaminated(docs, table))}
    sets = {i: shingles(t) for i, t in items.items()}
    assert got == {(d, i) for d, t in texts.items() for i, s in sets.items() if len(s & shingles(t)) >= 0.8 * len(s)}


def test_decontamination_by_rarest_shingles_of_items_with_a_common_beginning(spark, monkeypatch):
    """Items share their beginning; the domains ask by shingles alone, and keys that are hot are dealt out."""
    head = prose("head", 40)
    items = {i: head + " " + prose(f"item {i}", 12 + i) for i in range(20)} | {30: head, None: head + " " + prose("unnamed", 15)}
    texts = {i: prose(f"before {i}", 10 * i) + " " + list(items.values())[i % 22] + " " + prose(f"after {i}", 30) for i in range(44)}
    texts |= {100 + i: head + " " + prose(f"clean {i}", 60) for i in range(40)} | {200 + i: prose(f"other {i}", 60) for i in range(10)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    own = decontaminate.with_rarest(common.stored(decontaminate.item_shingles(table)))
    assert all(len(r["shingles"]) == r["n"] and len(r["rarest"]) == r["n"] - -(-8 * r["n"] // 10) + 1 for r in rows(own))
    monkeypatch.setattr(common, "HOT_SHARE", 10)
    monkeypatch.setattr(decontaminate, "functions_needed", lambda *_: None)
    got = {(r["doc_id"], r["item_id"]) for r in rows(decontaminate.contaminated(docs, table))}
    sets = {i: shingles(t) for i, t in items.items()}
    assert got == {(d, i) for d, t in texts.items() for i, s in sets.items() if len(s & shingles(t)) >= 0.8 * len(s)}


# --- 8


def test_token_counts_agree_with_the_library(docs, empty, spark, monkeypatch):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in rows(token_count.count_tokens(docs.withColumn("keep", F.col("text")).withColumn("N_TOKENS", F.lit("x")), path)):
        assert (r["n_bytes"], r["n_tokens"]) == (len((r["keep"] or "").encode()), len(model.encode(r["keep"] or "")))
    machine = token_count.transducer(path)
    r = random.Random(5)
    for chunk in (1, 2, 5, 64):
        monkeypatch.setattr(token_count, "CHUNK", chunk)
        for _ in range(150):
            text = "".join(r.choice("ab  ▁the \nżé日") for _ in range(r.randrange(1, 50)))
            assert token_count.count_text(machine, "▁" + text.replace(" ", "▁")) == len(model.encode(text)), (chunk, text)
    assert rows(token_count.count_tokens(empty, path)) == []


def test_state_maps_compose_as_reading(monkeypatch):
    """A map tells the state and count of reading its chunk from any state, one that was not expected too; prefixes of the scan are prefixes of the text."""
    machine = token_count.transducer(public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(8)
    for _ in range(100):
        parts = ["".join(r.choice("abethn▁▁s日") for _ in range(r.randrange(1, 20))) for _ in range(r.randrange(1, 9))]
        states = [machine.open_after("".join(parts[:k])[-3:]) if k else {0} for k in range(len(parts))]
        maps = [token_count.chunk_map(machine, p, s) for p, s in zip(parts, states, strict=True)]
        for m, p, known in zip(maps, parts, states, strict=True):
            assert all(m.table[s] == machine.read(s, p) for s in known)
            for s in r.sample(range(len(machine.states)), min(5, len(machine.states))):
                assert m(s) == machine.read(s, p)
        for k, m in enumerate(token_count.scan(maps)):
            assert m(0) == machine.read(0, "".join(parts[: k + 1]))
    # a text without spaces: the states expected at each chunk's start hold the one that is met
    text = "▁" + "".join(r.choice("aeinrst") for _ in range(4000))
    met, missed = 0, 0
    for at in range(200, 4000, 200):
        expected, got = machine.open_after(text[at - token_count.BEFORE : at]), machine.read(0, text[:at])[0]
        met, missed = met + (got in expected), missed + (got not in expected)
    assert met > 3 * missed


# --- 9


@pytest.mark.parametrize("broadcast", [300_000, 1])
def test_warc_round_trip(spark, monkeypatch, broadcast):
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    odd = "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc"
    pages = [(3, "http://a/ b", "same"), (1, "http://b", "same"), (2, None, odd), (4, "http://c", None), (5, "http://d", ""), (6, "http://e", "ž" * 50), (7, "http://f", odd), (8, "u", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in rows(warc.archive(df.withColumn("refers_to", F.lit("x")).withColumn("payload", F.lit("x")).withColumn("sha1", F.lit("x")), file_bytes=300))}
    first = {}
    for i, _, html in sorted(pages):
        payload = (html or "").encode()
        original = first.setdefault(payload, i)
        r = got[i]
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode() and r["payload_bytes"] == len(payload)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if original == i else ("revisit", original))
    assert all(r["payload_sha1"] == r["payload_digest"] for r in got.values() if r["record_type"] == "response")
    assert {r["record_type"] for r in rows(warc.archive(df, least_bytes=1000))} == {"response"}
    assert rows(warc.archive(df.limit(0))) == []
    odd_ids = spark.createDataFrame([(None, "u", "p"), (2, "u", "p"), (2, "u", "p"), (3, "u", "p"), (None, "u", "q")], df.schema)
    found = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in rows(warc.archive(odd_ids))), key=str)
    assert found == sorted([(2, "response", None, 1), (2, "response", None, 1), (3, "revisit", 2, 1), (None, "revisit", 2, 1), (None, "response", None, 1)], key=str)


# --- 10


def test_neighbours_recall_and_odd_vectors(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(1500, 16)).astype("float32")
    x[300:600] = x[300]  # a hot vector
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] * 16)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = {}
    for row in rows(ann.neighbours(df)):
        got.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"], row["score"]))
    assert set(got) == set(range(0, 1500, 20))
    y, hit = x.astype(float), 0
    for q, found in got.items():
        score = y @ y[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(1500), -score))[:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(score[f[1]] - f[2]) < 1e-9 for f in found)
        hit += len({f[1] for f in found} & set(best.tolist()))
    assert hit >= 0.9 * 20 * len(got)
    few = rows(ann.neighbours(df.filter("vec_id < 5")))
    assert sorted(f["vec_id"] for f in few) == [1, 2, 3, 4] and rows(ann.neighbours(df.limit(0))) == []


def test_recall_with_more_lists_than_probes(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(40, 24))
    x = centres[r.integers(0, 40, 8000)] * 0.7 + r.normal(size=(8000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").withColumn("list", F.lit("own")).withColumn("part", F.lit("own"))
    v = ann.usable(df)
    index = ann.fit(v, per_list=16)
    assert len(index.centroids) == ann.lists_for(8000, 16, 32_768) == 268
    got = {}
    for row in rows(ann.search(v, v.filter("vec_id % 20 = 0"), index, probes=64, block=64)):
        got.setdefault(row["query_id"], set()).add(row["vec_id"])
    hit = 0
    for q, found in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        hit += len(found & set(np.argsort(-score)[:20].tolist()))
    # at most 64 of 268 lists are read, and more than nine of ten neighbours found
    assert len(got) == 400 and 0.9 <= hit / (20 * len(got))


# --- columns of one's own


def test_columns_with_the_names_of_working_columns(spark):
    """Stages return the documents' own columns, whatever their names, with their values."""
    names = "t __t id __id row __row lines all gone found n m s size bucket set path probe __found __salt __hot class leads kept deleted word score".split()
    docs = spark.createDataFrame([(i, x) for i, x in enumerate([prose(1), prose(1), prose(2), lines(3), lines(3) + "\n" + lines(4)])], "doc_id long, text string")
    odd = docs.select("doc_id", "text", *[F.lit(f"own {n}").alias(n) for n in names])
    items = spark.createDataFrame([(0, prose(2))], "item_id long, text string").withColumn("s", F.lit(1)).withColumn("class", F.lit(1))
    for out, ids in ((line_dedup.dedup(odd), [0, 2, 3, 4]), (jaccard_join.keep_one(odd), [0, 2, 3, 4]), (decontaminate.remove(odd, items), [0, 1, 3, 4]), (bpe.encode(odd, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN), [0, 1, 2, 3, 4])):
        got = rows(out)
        assert sorted(r["doc_id"] for r in got) == ids and all(r[n] == f"own {n}" for r in got for n in names) and out.columns[:2] == ["doc_id", "text"]
    assert {r["doc_id"]: r["text"] for r in rows(line_dedup.dedup(odd))}[4] == lines(4)
    assert len(rows(jaccard_join.link(odd))) == len(rows(suffix_dedup.cut(odd))) == len(rows(license_scan.scan_documents(odd))) == 5


# --- pipeline


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)], DOCS)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, prose(2))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"] for r in rows(corpus_pipeline.run(spark, str(tmp_path)))}
    assert not got & {0, 1, 2, 3, 7, 9, 17} and {6, 10, 12, 15} <= got
    stage = frame
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == frame.columns


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    import tiktoken

    r = random.Random(31)
    pool = [prose(f"shared {k}", 12) for k in range(12)]
    german = "das ist ein haus und der garten am alten see mit brücke".split()
    texts = {}
    for i in range(90):
        own = [prose(f"own {i} {k}", 14) for k in range(r.randrange(1, 4))]
        at = r.randrange(len(pool) - 2)
        texts[i] = "\n".join(own + r.choice([[], pool[at : at + 2], [pool[at]]]) + [f"document {i} ends here and no other one does"])
    for i in range(90, 120):  # near copies in one line each, so that lines are not shared
        w = prose(f"group {i % 3}", 90).split()
        for k in range(r.randrange(0, 4)):
            w[r.randrange(90)] = f"edit{i}x{k}"
        texts[i] = " ".join(w)
    texts |= {120 + i: " ".join(r.choice(german) for _ in range(25)) + f" nummer {i}" for i in range(20)}
    texts |= {140: None, 141: "", 142: "123 !!", 143: texts[5], 144: texts[5], 145: "\n\n", 146: pool[3]}
    items = {0: prose("own 3 0", 14), 1: " ".join(prose("group 1", 90).split()[10:60]), 2: prose("nowhere", 30), 3: None}
    texts[147] = "before " + items[2] + " after"
    lang = lambda i: None if i % 7 == 0 else "de" if 120 <= i < 140 else "en"
    docs = spark.createDataFrame([(i, t, lang(i), "s", len(t or "")) for i, t in texts.items()], DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    model = language_id.fit(docs.filter(~language_id.held_out()))
    kept = {}
    for i, t in texts.items():
        best, score, _ = language_id.infer(model, [t or ""], 3.0, 0.5, 8)
        if best[0] >= 0 and score[0] >= 0.5:
            kept[i] = t
    assert {140, 141, 142, 145}.isdisjoint(kept) and len(kept) > 130
    first = {}
    for i, t in kept.items():
        first.setdefault(t, i)
    distinct = {i: t for t, i in first.items()}
    kept = {i: t for i, t in brute_line_dedup(distinct).items() if t.strip() or t == distinct[i]}
    _, root = brute_groups(kept)
    kept = {i: t for i, t in kept.items() if root[i] == i}
    sets = [shingles(t) for t in items.values() if shingles(t)]
    kept = {i: t for i, t in kept.items() if not any(len(s & shingles(t)) >= 0.8 * len(s) for s in sets)}
    assert 60 < len(kept) < 130 and {3, 147, 143}.isdisjoint(kept)
    path = public_tokenizers.path(corpus_pipeline.RANKS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {x["doc_id"]: x for x in rows(corpus_pipeline.run(spark, str(tmp_path)))}
    assert {i: x["ids"] for i, x in got.items()} == {i: known.encode_ordinary(t) for i, t in kept.items()}
    assert all(x["decoded_sha256"] == hashlib.sha256(kept[i].encode()).hexdigest() for i, x in got.items())
