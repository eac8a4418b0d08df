"""Line dedup by pairwise alignment.

Documents overlap if they share evidence: a long line (of 50 words or 200 characters), however many hold it; a full line
(of at least ``least`` characters) that at most ``rare`` distinct texts hold; or two successive full lines, whatever blank
and shorter lines stand between them. Evidence links each document to the first one (smallest id) that holds it, so links
are at most twice as many as lines. Each linked pair is aligned by patience diff over its lines, and blocks of aligned
lines that hold evidence are deleted from the later document; evidence that the order of lines leaves out, as in moved
or repeated passages, is aligned by itself with the equal lines around it. Equal documents are collapsed first: all but the first are
deleted whole. A line that is not long and that many unrelated documents share stays where it stands alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import salted_join, stored

#: Documents that may hold a rare line that is not long.
RARE = 8
#: Characters of a full line; shorter ones, as headings, are no evidence.
LEAST = 25
#: Words, or characters for texts without spaces, of a line that is evidence alone, whatever the number of its holders.
LONG_WORDS, LONG_CHARS = 50, 200


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of two line sequences: lines that are equal at both ends, then those that are unique in both
    and in the longest increasing order, with the gaps between them aligned the same way. Where no line is unique in
    both, lines are told apart by their number among equal ones."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, i2, j, j2 = stack.pop()
        while i < i2 and j < j2 and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            out.append((i2, j2))
        if i == i2 or j == j2:
            continue
        once_a, once_b = _once(a, i, i2), _once(b, j, j2)
        common = sorted((p, once_b[x]) for x, p in once_a.items() if x in once_b)
        anchors = _increasing(common)
        if not anchors:
            nth_a, nth_b = _numbered(a, i, i2), _numbered(b, j, j2)
            anchors = _increasing(sorted((p, nth_b[x]) for x, p in nth_a.items() if x in nth_b))
        if not anchors:
            continue
        edges = [(i - 1, j - 1), *anchors, (i2, j2)]
        out += anchors
        stack += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:], strict=False) if p + 1 < r and q + 1 < s]
    return sorted(out)


def _once(x: list[int], start: int, stop: int) -> dict[int, int]:
    seen: dict[int, int] = {}
    for p in range(start, stop):
        seen[x[p]] = -1 if x[p] in seen else p
    return {k: p for k, p in seen.items() if p >= 0}


def _numbered(x: list[int], start: int, stop: int) -> dict[tuple[int, int], int]:
    """The position of each line and its number among equal ones."""
    seen: Counter[int] = Counter()
    out = {}
    for p in range(start, stop):
        out[x[p], seen[x[p]]] = p
        seen[x[p]] += 1
    return out


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that increases in both."""
    import bisect

    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for n, (_, q) in enumerate(pairs):
        k = bisect.bisect_left(tops, q)
        tops[k:k + 1] = [q]
        at[k:k + 1] = [n]
        back.append(at[k - 1] if k else -1)
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def _with_lines(documents: DataFrame) -> DataFrame:
    return documents.withColumn("__lines", F.split("text", "\n", -1)).withColumn("__t", F.xxhash64("text"))


def _kind(line: Column, least: int) -> Column:
    """2 for a long line, 1 for a full one, else 0."""
    size = F.length(F.trim(line))
    # so many words have at least as many letters and the spaces between them
    long = (size >= LONG_CHARS) | ((size >= 2 * LONG_WORDS - 1) & (F.size(F.split(F.trim(line), r"\s+")) >= LONG_WORDS))
    return F.when(long, 2).when(size >= least, 1).otherwise(0).cast("byte")


def deletions(documents: DataFrame, rare: int = RARE, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(documents to delete whole: doc_id, t; lines to delete: doc_id, t, gone), t being the hash of the text, gone line numbers from 0.

    Earlier means a smaller (doc_id, t), nulls first. Texts that are null or blank take no part.
    """
    base = stored(
        _with_lines(documents.select("doc_id", "text").filter(F.trim("text") != "")).select(
            "doc_id", F.col("__t").alias("t"), F.xxhash64(F.lit(1), "text").alias("t2"),
            F.transform("__lines", lambda x: F.xxhash64(x)).alias("lines"), F.transform("__lines", lambda x: _kind(x, least)).alias("kind"),
        )
    )
    # one row for each distinct text; min() passes over nulls, so a null doc_id comes first by its own flag
    same = base.groupBy("t", "t2").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("f"), F.any_value("lines").alias("lines"), F.any_value("kind").alias("kind"))
    texts = stored(same.select(F.col("f.doc_id").alias("doc_id"), "t", "t2", "lines", "kind"))
    firsts = texts.select(F.col("doc_id").alias("first_id"), F.col("t").alias("ft"), F.col("t2").alias("ft2"))
    whole = base.join(firsts, (F.col("t") == F.col("ft")) & (F.col("t2") == F.col("ft2")) & ~F.col("doc_id").eqNullSafe(F.col("first_id"))).select("doc_id", "t").distinct()

    pairs = F.expr("transform(sequence(0, size(fulls) - 2), i -> xxhash64(fulls[i].h, fulls[i + 1].h))")
    none = F.array().cast("array<struct<h: bigint, two: boolean, long: boolean>>")
    # distinct by numbers, not by structs, which Spark compares each with each
    long = F.array_distinct(F.transform(F.filter("fulls", lambda x: x["long"]), lambda x: x["h"]))
    short = F.array_except(F.transform("fulls", lambda x: x["h"]), long)
    alone = lambda hashes, is_long: F.transform(hashes, lambda h: F.struct(h.alias("h"), F.lit(False).alias("two"), F.lit(is_long).alias("long")))
    single = F.concat(alone(short, False), alone(long, True))
    double = F.when(F.size("fulls") < 2, none).otherwise(F.transform(F.array_distinct(pairs), lambda x: F.struct(x.alias("h"), F.lit(True).alias("two"), F.lit(False).alias("long"))))
    fulls = texts.select("doc_id", "t", F.expr("filter(transform(lines, (x, i) -> if(kind[i] > 0, struct(x as h, kind[i] = 2 as long), null)), x -> x is not null)").alias("fulls"))
    evidence = fulls.select("doc_id", "t", F.explode(F.concat(single, double)).alias("e")).select("doc_id", "t", "e.h", "e.two", "e.long")
    held = evidence.groupBy("h", "two").agg(F.count("*").alias("n"), F.max("long").alias("long"), F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "t")).alias("f"))
    held = held.filter((F.col("n") > 1) & (F.col("two") | F.col("long") | (F.col("n") <= rare))).select("h", "two", "n", F.col("f.doc_id").alias("first_id"), F.col("f.t").alias("first_t"))
    # a line or pair of lines that very many texts hold is dealt out over many tasks
    links = salted_join(evidence.drop("long"), stored(held), ["h", "two"], ["doc_id", "t"]).filter(~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("t") == F.col("first_t"))))
    # a pair is linked by as many rows as it shares evidence, at most twice its lines
    linked = links.groupBy("doc_id", "t", "first_id", "first_t").agg(F.collect_set(F.when(~F.col("two"), F.col("h"))).alias("alone"))
    sides = texts.select(F.col("doc_id").alias("d"), F.col("t").alias("dt"), "lines", "kind")
    linked = stored(linked)
    one = linked.join(sides, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("dt"))).drop("d", "dt")
    # a first text may have very many later ones; nulls are told apart, as the join passes over them
    named = lambda c: F.struct(F.col(c).isNull().alias("none"), F.coalesce(c, F.lit(0)).alias("id"))
    counts = linked.groupBy(named("first_id").alias("w"), F.col("first_t").alias("wt")).agg(F.count("*").alias("n"))
    two = sides.select(named("d").alias("w"), F.col("dt").alias("wt"), F.col("lines").alias("first_lines"), F.col("kind").alias("first_kind")).join(counts, ["w", "wt"])
    both = salted_join(one.withColumns({"w": named("first_id"), "wt": F.col("first_t")}), stored(two), ["w", "wt"], ["doc_id", "t"])
    both = both.select("doc_id", "t", "lines", "kind", "alone", "first_lines", "first_kind")

    def align(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            gone = [_deleted(list(r.first_lines), list(r.lines), list(r.first_kind), list(r.kind), set(r.alone)) for r in frame.itertuples()]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "t": frame["t"], "gone": gone})

    aligned = both.mapInPandas(align, "doc_id long, t long, gone array<int>")
    lines = aligned.filter(F.size("gone") > 0).groupBy("doc_id", "t").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    return whole, lines


def _deleted(first: list[int], later: list[int], first_kind: list[int], kind: list[int], alone: set[int]) -> list[int]:
    """Lines of ``later`` in aligned blocks that hold a line that is evidence ``alone`` or one of two successive full lines; then those of the evidence that is left."""
    aligned = patience(first, later)
    strong = {q for _, q in aligned if later[q] in alone}
    nth, first_nth = list(accumulate(int(k > 0) for k in kind)), list(accumulate(int(k > 0) for k in first_kind))
    fulls = [(p, q) for p, q in aligned if kind[q] > 0]
    for (p, q), (p2, q2) in zip(fulls, fulls[1:], strict=False):
        if first_nth[p2] == first_nth[p] + 1 and nth[q2] == nth[q] + 1:
            strong |= {q, q2}
    out: list[int] = []
    block: list[int] = []
    before = (-2, -2)
    for p, q in [*aligned, (-2, -2)]:
        if (p - 1, q - 1) != before:
            if not strong.isdisjoint(block):
                out.extend(block)
            block = []
        block.append(q)
        before = (p, q)
    return sorted(_moved(first, later, first_kind, kind, alone, set(out)))


def _moved(first: list[int], later: list[int], first_kind: list[int], kind: list[int], alone: set[int], gone: set[int]) -> set[int]:
    """``gone`` with the evidence of ``later`` that is not in it and the equal lines around, each line looked at a few times only."""
    fulls = [p for p, k in enumerate(first_kind) if k > 0]
    single = {first[p]: p for p in reversed(fulls)}
    double = {(first[p], first[p2]): (p, p2) for p, p2 in reversed(list(zip(fulls, fulls[1:], strict=False)))}

    def grow(p: int, q: int) -> None:
        for step in (-1, 1):
            i, j = (p, q) if step < 0 else (p + 1, q + 1)
            while 0 <= i < len(first) and 0 <= j < len(later) and first[i] == later[j] and j not in gone:
                gone.add(j)
                i, j = i + step, j + step

    own = [q for q, k in enumerate(kind) if k > 0]
    for q, q2 in zip(own, own[1:], strict=False):
        if (q not in gone or q2 not in gone) and (at := double.get((later[q], later[q2]))):
            grow(at[0], q)
            grow(at[1], q2)
    for q in own:
        if q not in gone and later[q] in alone and later[q] in single:
            grow(single[later[q]], q)
    return gone


def marked(documents: DataFrame, **options) -> DataFrame:
    """``documents`` with n_lines, n_removed, deleted (nothing but blanks is left of a text that had more) and kept, the text that is left.

    Null texts have no lines. Rows that share doc_id and text are one document and get the same; every row gives one
    row. Columns that already have these names are replaced.
    """
    new = ("n_lines", "n_removed", "deleted", "kept")
    columns = [c for c in documents.columns if c.lower() not in new]
    # the document's own columns travel in one, so that none of them clashes with a working column
    frame = documents.select(F.struct(*columns).alias("row"), F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("t"), F.split("text", "\n", -1).alias("lines"))
    whole, lines = deletions(documents, **options)
    found = lines.withColumn("all", F.lit(False)).unionByName(whole.select("doc_id", "t", F.array().cast("array<int>").alias("gone"), F.lit(True).alias("all")))
    joined = frame.join(found.withColumnRenamed("t", "found_t"), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("found_t")), "left")
    left = F.when(F.col("all"), F.lit("")).when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")), lambda i: F.get("lines", i)), "\n"))
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.coalesce(F.size("lines"), F.lit(0))).cast("long")
    removed = F.when(F.col("all"), n).otherwise(F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0))).cast("long")
    joined = joined.withColumn("left", left)  # apart from the document's columns, of which one may be named lines
    out = joined.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], n.alias("n_lines"), removed.alias("n_removed"), F.col("left").alias("kept"))
    return out.withColumn("deleted", (F.col("n_removed") > 0) & (F.trim("kept") == ""))


def dedup(documents: DataFrame, **options) -> DataFrame:
    """``documents`` with the repeated lines deleted from ``text`` and n_chars, if there, brought up to date; documents of which nothing is left go."""
    columns = documents.columns
    kept = marked(documents.withColumn("__row", F.struct(*columns)).select("doc_id", "text", "__row"), **options).filter(~F.col("deleted"))
    value = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("__row.n_chars")).cast(documents.schema["n_chars"].dataType) if "n_chars" in columns else None}
    return kept.select(*[value[c].alias(c) if c in value else F.col(f"__row.`{c}`").alias(c) for c in columns])
