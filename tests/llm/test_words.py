"""Token alignment, repeated word windows, spelling variants."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers
from pyspark.sql import functions as F

from zonecheck.llm import alignment, spelling, superkmers

DOCS = "doc_id long, text string"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORDS = "the of and zone school street house number river bridge hill market old new green long road park lake stone".split()
ODD = [
    None, "", " ", "  ", "\n", " \n \t x y  z", "a  b", "a\n\n  x", "x ", "<|endoftext|> <s> </s> <0x41> <unk>", "a▁b", "日本語 🙂 ñandú żółć", "'re ''re don't  can''t\u001c x\u001c  y \u0085 z​ q", "\x00 \x07", "x" * 3000,
    "ab " * 3000, "  lead", "trail  \n", "a \n b\n  \n c", "é ﬁ ½5 ①", "Zürich, Łódź; naïve_case X9y",
]


def rows(df):
    return [r.asDict() for r in df.collect()]


def prose(seed, n=80):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "s", ",", ".\n"]) for _ in range(n))


# --- 11


def aligned_by_hand(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib, b_lib = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in seen)}
    out, links = [], []
    for text in texts:
        out.append((0, 0, 0, 0, ""))
        links.append([])
        if not text:
            continue
        a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
        parts = [[bytes(letters[c] for c in a_lib.id_to_token(i)) for i in a], [bytes([int(b_lib.id_to_piece(i)[1:-1], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]]
        if any(b"".join(p) != (" " + text).encode() for p in parts):
            continue
        spans = []
        for p in parts:
            at = [0]
            for x in p:
                at.append(at[-1] + len(x))
            spans.append(list(zip(at, at[1:])))
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        inside = lambda ids, span, lo, hi: ",".join(str(i) for i, (s, e) in zip(ids, span) if lo <= s and e <= hi)
        groups = [f"{inside(a, spans[0], lo, hi)}|{inside(b, spans[1], lo, hi)}" for lo, hi in zip([0, *cuts], cuts)] if len(text) < 2000 else None
        links[-1] = [(i, j) for i, (s, e) in zip(a, spans[0]) for j, (s2, e2) in zip(b, spans[1]) if s < e2 and s2 < e] if len(text) < 2000 else []
        out[-1] = (len(a), len(b), len(cuts), len(links[-1]), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else None)
    counts, best = Counter(p for x in links for p in set(x)), defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    return [(*o[:4], sum(counts[p] == best[p[0]] for p in x), sum(counts[p] for p in x), o[4]) for o, x in zip(out, links)]


@pytest.mark.parametrize("hot", [1 << 19, 20, 0])
def test_alignment_against_brute_force(spark, hot, monkeypatch):
    texts = [t for t in ODD if t is None or len(t) < 2000] + [prose(s, 60) for s in range(6)] + [prose(1, 60)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], DOCS + ", n_a int")
    got = {r["doc_id"]: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in rows(alignment.document_links(df, A, B, hot))}
    assert [got[i] for i in range(len(texts))] == aligned_by_hand(texts)


def test_alignment_of_long_texts_in_parts(spark, monkeypatch):
    texts = ["ab " * 3000, prose(3, 900), "x" * 3000]
    both = alignment.Tokenizers(A, B)
    whole = [next(iter(x)) for x in (alignment._align(both, [u]) for t in texts for u in both.units(t))]
    monkeypatch.setattr(alignment, "_UNITS", 50)
    for text, want in zip(texts, whole):
        got = alignment.Aligned(True)
        for units in both.units(text):
            got.add(*alignment._align(both, [units])[0])
        n_a, n_b, n_groups, n_links, digest, pairs, links, groups = got.done()
        assert [n_a, n_b, n_groups, n_links] == list(want[0]) and groups.encode() == bytes(want[1]) and digest == hashlib.sha256(want[1]).hexdigest()
        assert pairs.tolist() == want[2].tolist() and links.tolist() == want[3].tolist()


def test_alignment_real_output_and_empty_table(spark):
    df = spark.createDataFrame([(None, "Hello world"), (1, "Hello world"), (1, "Hello world")], DOCS)
    got = rows(alignment.aligned(df, A, B, spelled=True))
    assert len(got) == 3 and len({r["groups"] for r in got}) == 1 and got[0]["groups_sha256"] == hashlib.sha256(got[0]["groups"].encode()).hexdigest()
    assert got[0]["n_links"] == sum(got[0]["links"]) and len(got[0]["a"]) == len(got[0]["b"]) == len(got[0]["links"])
    assert rows(alignment.document_links(df.limit(0), A, B)) == []


# --- 12


def windows_by_hand(texts, length):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    n = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if n[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("length, bucket", [(35, None), (35, 0), (6, None), (6, 0), (9, 1)])
def test_repeated_windows_against_brute_force(spark, monkeypatch, length, bucket):
    if bucket is not None:
        monkeypatch.setattr(superkmers, "BUCKET", bucket)
    shared = prose(99, 50)
    texts = [*ODD, prose(1), prose(1), prose(1) + " end", prose(2, 30) + " " + shared + " " + prose(3, 20), shared, "begin " + shared.replace(" ", "\t\n"), "a " * 90, "a b " * 60, prose(7, 40), " ".join(["w"] * 60), "\x1c ".join(["v"] * 45)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOCS + ", id string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in rows(superkmers.cut(df, length))}
    assert [got[i] for i in range(len(texts))] == windows_by_hand(texts, length)


def test_windows_of_long_texts_repeated_rows_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(superkmers, "BLOCK_BYTES", 500)
    monkeypatch.setattr(superkmers, "BLOCK_WORDS", 40)
    texts = [prose(1, 1500), prose(2, 700) + " " + prose(1, 900), "y" * 5000 + " " + prose(4, 100), prose(8, 3000)]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in rows(superkmers.cut(df, 35))}
    assert [got[i] for i in range(len(texts))] == windows_by_hand(texts, 35)
    twice = spark.createDataFrame([(5, texts[0]), (5, texts[0]), (None, prose(6)), (None, prose(6)), (7, prose(7))], DOCS)
    assert sorted((r["doc_id"] or 0, r["n_words"] - r["n_removed"]) for r in rows(superkmers.cut(twice, 35))) == [(0, 0), (0, 0), (5, 0), (5, 0), (7, 80)]
    assert rows(superkmers.cut(df.limit(0), 35)) == []


# --- 13


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants_by_hand(n, ratio):
    out = {}
    for w in n:
        other = [x for x in n if near(w, x)]
        best = min(other, key=lambda x: (-n[x], x), default=None)
        form = best if best is not None and n[best] >= ratio * n[w] else None
        out[w] = [form, None, n[w], len(other), n[form] if form else None]
    for w, r in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        r[1] = root
    return {w: tuple(r) for w, r in out.items()}


@pytest.mark.parametrize("bucket", [None, 3])
def test_variants_against_brute_force(spark, monkeypatch, bucket):
    if bucket:
        monkeypatch.setattr(spelling, "BUCKET", bucket)
    monkeypatch.setattr(spelling, "_QUERIES", 7)
    r = random.Random(4)
    words = {"zzzzzzz", "zzzzzzzz", "zzzzzzzzz", "zzzzzzy", "y" + "z" * 6, "ÿàéèüöß", "ÿàéèüöa", "q" * 300, "q" * 301, "q" * 299 + "r"}
    for _ in range(60):
        base = "".join(r.choice("abé") for _ in range(r.randrange(7, 12)))
        words.add(base)
        for _ in range(4):
            i = r.randrange(len(base))
            base = r.choice([base[:i] + r.choice("abcé") + base[i:], base[:i] + base[i + 1 :], base[:i] + r.choice("abcé") + base[i + 1 :]])
            if len(base) >= 7:
                words.add(base)
    n = {w: r.choice([2, 3, 25, 30, 400, 4000, 4000]) for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    got = {x["word"]: (x["form"], x["root"], x["n"], x["n_near"], x["form_n"]) for x in rows(spelling.variants(df))}
    assert got == variants_by_hand(n, 10)
    assert rows(spelling.variants(df.limit(0))) == []


def test_words_are_counted_with_their_deletions(spark):
    texts = [None, "", "short Words only", "Überraschung überraschung ÜBERRASCHUNG", "neighbour, Neighbour; neighbours×neighbour NEIGHBOUR_neighbour", "x" * 400, "bäckerei " * 200, " ".join(f"wordform{c}" for c in "abcdefghij") * 3] + ["kindergarten laboratory " * 5] * 40
    docs = [(i, t, "w") for i, t in enumerate(texts)] + [(None, "kindergarten laboratory", "w"), (7, texts[7], "w")]
    want = Counter()
    for i, t, _ in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                want[run] += 1
    got = {r["word"]: r["n"] for r in rows(spelling.counted(spark.createDataFrame(docs, DOCS + ", run string")))}
    assert got == {w: n for w, n in want.items() if n >= 2}
    assert spelling.document_variants(spark.createDataFrame(docs, DOCS + ", run string")).count() == len(got)
    assert any(len(w) == len("kindergarten") - 1 for w in got) or all(zlib.crc32(f"{i}:kindergarten".encode()) % 31 for i in range(8, 48))
