"""Spelling variants of the words of a corpus: words one edit apart, grouped under the far more frequent one.

Two near words (one inserted, deleted or replaced code point) agree before or after the middle of the shorter one, so
each word is placed under its first and its last half, for its own length and as the longer word of a pair; near words
meet in exactly one such bucket, told by the length of their common prefix. A bucket of more than BUCKET words is split
again at the middle of what is left between prefix and suffix, until it is small; with one code point left it holds
fewer words than two of its letters have spellings, so the split ends for any vocabulary.

In a bucket the words are a sorted list, scanned by dynamic programming. A row of the edit matrix, the three cells
next to the diagonal, depends on a prefix only. So adjacent words reuse the rows of their longest common prefix: a row
is computed once for a range of the list that shares a prefix, for all words that look for neighbours at once, and a
range whose row exceeds one edit is skipped whole.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_groups, ragged, salted_join, stored

#: Words of a bucket that is scanned in one task; not below the number of words of one or two given letters.
BUCKET = 1 << 13
#: Words that look for neighbours at once.
_QUERIES = 1 << 12
_FAR = 9

#: The letters of a run, beside A to Z.
LETTERS = "[A-Za-zÀ-ÿ]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _without(word: Column, at: Column) -> Column:
    """``word`` without its code point ``at``, from 0."""
    return F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))


def counted(documents: DataFrame, least: int = 7, every: int = 31) -> DataFrame:
    """(word, n): the words of at least ``least`` code points of all texts, with their occurrences, two at least.

    A word is a maximal run of letters with A-Z lowered. Where ``every`` divides the crc32 of ``<doc_id>:<run>``, one
    code point is left out, so that any corpus holds misspelt words; 0 leaves none out. Null texts have no words; a null
    doc_id counts as an empty one.
    """
    runs = F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))  # shorter runs can't become words
    found = documents.select(F.col("doc_id").cast("string").alias("id"), F.explode(runs).alias("run"))
    run = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER)).otherwise(F.col("run"))
    found = found.select("id", run.alias("run"))
    word = F.col("run")
    if every:
        h = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), "run").cast("binary"))
        found = found.select("run", h.alias("h"))
        word = F.when(F.col("h") % every == 0, _without(F.col("run"), (F.col("h") % F.length("run")).cast("int"))).otherwise(F.col("run"))
    found = found.select(word.alias("word")).filter(F.length("word") >= least)
    return found.groupBy("word").agg(F.count("*").alias("n")).filter("n >= 2")


def _placed(frame: DataFrame) -> DataFrame:
    """``frame`` with the key of each row's bucket: what lies before ``lo`` and after ``hi`` in a word of ``len + d`` code points."""
    key = F.concat_ws(":", "len", "lo", "hi", F.substr("word", F.lit(1), F.col("lo")), F.substr("word", F.col("hi") + F.col("d") + 1))
    return frame.withColumn("key", key).withColumn("g", F.xxhash64("key"))


def _halves(frame: DataFrame) -> DataFrame:
    """Both places of each row when its bucket, with ``lo`` and ``hi``, is split at the middle."""
    mid = ((F.col("lo") + F.col("hi")) / 2).cast("int")
    place = F.explode(F.array(F.struct(mid.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), mid.alias("hi"))))
    return _placed(frame.withColumn("at", place).select("word", "n", "len", "d", "at.lo", "at.hi"))


def _buckets(words: DataFrame, least: int) -> DataFrame:
    """(g, key, word, n, len, d, lo, hi): every word in the buckets where it may meet near ones."""
    length = F.length("word")
    roles = F.array_compact(F.array(F.struct(length.alias("len"), F.lit(0).alias("d")), F.when(length > least, F.struct((length - 1).alias("len"), F.lit(1).alias("d")))))
    frame = words.withColumn("role", F.explode(roles)).select("word", "n", "role.len", "role.d", F.lit(0).alias("lo"), F.col("role.len").alias("hi"))
    frame, done = _halves(frame), []
    while True:
        # the bucket of one code point is small by itself
        full = stored(frame.groupBy("key").agg(F.count("*").alias("n"), F.max(F.col("hi") - F.col("lo")).alias("wide")).filter(f"n > {BUCKET} and wide > 1").select("key", "n"))
        if full.isEmpty():
            return functools.reduce(DataFrame.unionByName, [*done, frame])
        frame = stored(frame.withColumnRenamed("n", "of"))
        done.append(salted_join(frame, full, ["key"], ["word"], "left_anti").withColumnRenamed("of", "n"))
        frame = stored(_halves(salted_join(frame, full, ["key"], ["word"], "left_semi").withColumnRenamed("of", "n")))


def _codes(words: list[str], start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ``size`` code points from ``start`` of each word, as a row padded with zeros."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    out = np.zeros((len(words), int(size.max()) if len(size) else 0), np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = flat[ragged(np.cumsum(lengths) - lengths + start, size)]
    return out


class SortedList:
    """Words of many buckets in sorted order, with the ranges that share a prefix at every depth."""

    def __init__(self, bucket: np.ndarray, codes: np.ndarray, size: np.ndarray) -> None:
        """``bucket`` of each word, ascending; the words of a bucket in ascending order of ``codes``."""
        self.codes, self.size = codes, size
        new = np.diff(bucket, prepend=-1) != 0
        #: by depth: the first word of each range, and the range of each word
        self.first, self.range = [], []
        for depth in range(codes.shape[1] + 1):
            if depth:  # adjacent words part where their common prefix ends
                new = new | (np.diff(codes[:, depth - 1].astype(np.int64), prepend=-1) != 0)
            self.first.append(np.flatnonzero(new))
            self.range.append(np.cumsum(new) - 1)

    def near(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, near word) for the places ``asked``: pairs of one bucket that are one edit apart."""
        q, node = asked, self.range[0][asked]
        row = np.tile(np.array([_FAR, 0, 1], np.int8), (len(q), 1))
        found = []
        for depth in range(self.codes.shape[1]):
            first = self.first[depth]
            end = np.append(first[1:], len(self.codes))[node] - 1
            low, high = self.range[depth + 1][first[node]], self.range[depth + 1][end]
            of = np.repeat(np.arange(len(q)), high - low + 1)
            node = ragged(low, high - low + 1)
            word = self.first[depth + 1][node]
            own = self.size[word] > depth  # else the words of this range have ended
            of, node, word = of[own], node[own], word[own]
            q, row = q[of], row[of]
            letter = self.codes[word, depth]
            cells = []
            for k in range(3):  # the query's prefixes of depth, depth + 1 and depth + 2 letters
                j = depth + k - 1
                other = np.ones(len(q), np.int8) if j < 0 or j >= self.codes.shape[1] else (self.codes[q, j] != letter).astype(np.int8)
                cell = row[:, k] + other
                if k < 2:
                    cell = np.minimum(cell, row[:, k + 1] + 1)
                if k:
                    cell = np.minimum(cell, cells[-1] + 1)
                cells.append(np.where(j + 1 > self.size[q], _FAR, np.minimum(cell, _FAR)).astype(np.int8))
            row = np.stack(cells, 1)
            live = row.min(1) <= 1
            q, node, word, row = q[live], node[live], word[live], row[live]
            k = self.size[q] - depth
            ended = np.flatnonzero((self.size[word] == depth + 1) & (k >= 0) & (k <= 2))
            ended = ended[row[ended, k[ended]] == 1]
            found.append((q[ended], word[ended]))
            if not len(q):
                break
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (asked[:0], asked[:0])


def _neighbours(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """(word, n_near, best_n, best) of the words of whole buckets: a row for each word that has near ones there."""
    keys = np.asarray(batch.column(1).dictionary_encode().indices).astype(np.int64)
    counts = np.bincount(keys)
    together = np.flatnonzero(counts[keys] > 1)
    if not len(together):
        return None
    batch = batch.take(pa.array(together))
    keys = keys[together]
    words = batch.column(2).to_pylist()
    n, length, d, lo, hi = (batch.column(k).to_numpy().astype(np.int64) for k in range(3, 8))
    parts = []
    width = hi - lo + d
    for wide in np.unique(width >> 4):  # buckets of about one width at once, so that rows have little padding
        own = np.flatnonzero(((hi - lo) >> 4 == wide))
        if not len(own):
            continue
        codes = _codes([words[i] for i in own], lo[own], width[own])
        order = np.lexsort((*codes.T[::-1], keys[own]))
        own, codes = own[order], codes[order]
        listed = SortedList(keys[own], codes, width[own])
        short = np.flatnonzero(d[own] == 0)
        for at in range(0, len(short), _QUERIES):
            a, b = listed.near(short[at : at + _QUERIES])
            # a pair belongs to the bucket that its common prefix tells
            room = (hi - lo)[own[a]]
            inside = np.arange(codes.shape[1]) < room[:, None]
            kept = (hi[own[a]] == length[own[a]]) | ((codes[a] != codes[b]) & inside).any(1)
            a, b = own[a[kept]], own[b[kept]]
            back = d[b] == 1
            parts.append((np.concatenate([a, b[back]]), np.concatenate([b, a[back]])))
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (keys[:0], keys[:0])
    if not len(a):
        return None
    rank = np.unique(np.array(words, object), return_inverse=True)[1].reshape(-1)
    order = np.lexsort((rank[b], -n[b], rank[a]))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.diff(rank[a], prepend=-1) != 0)
    count = np.diff(np.append(first, len(a)))
    take = lambda rows: batch.column(2).take(pa.array(rows))
    return pa.RecordBatch.from_arrays([take(a[first]), pa.array(count), pa.array(n[b[first]]), take(b[first])], names=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, least: int = 7) -> DataFrame:
    """(word, n_near, best_n, best) for (word, n): of each word that has near ones their number, and the most frequent with its n (ties: the smallest word)."""
    found = map_groups(_buckets(words, least).select("g", "key", "word", "n", "len", "d", "lo", "hi"), "g", _neighbours, "word string, n_near long, best_n long, best string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b"))
    return best.select("word", "n_near", (-F.col("b.m")).alias("best_n"), "b.best")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): where following forms ends. Forms lead to ever larger n, so there are no circles; each pass doubles the way."""
    at = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = at.groupBy("root").agg(F.count("*").alias("n")).join(at.select(F.col("word").alias("root"), F.col("root").alias("onward")), "root", "left")
        onward = stored(onward)
        if onward.filter("onward is not null").isEmpty():
            return at
        at = stored(salted_join(at, onward, ["root"], ["word"], "left").select("word", F.coalesce("onward", "root").alias("root")))


def variants(words: DataFrame, least: int = 7, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for (word, n), a row per distinct word of at least ``least`` code points.

    ``form`` is the near word of largest n, ties to the smallest word, if it has ``ratio`` times the word's n; else null,
    with ``form_n``. ``root`` is where forms lead from the word, the word itself without a form. Words without near ones
    have n_near 0; an empty table gives an empty one.
    """
    words = stored(words.select("word", "n"))
    near = near_words(words, least)
    formed = F.col("best_n") >= ratio * F.col("n")
    done = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n"))
    done = stored(done)
    roots = _roots(done.filter("form is not null").select("word", "form"))
    return done.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def document_variants(documents: DataFrame, least: int = 7, every: int = 31, ratio: int = 10) -> DataFrame:
    """The variants of the words of all texts, repeated rows counting anew; see ``counted`` and ``variants``."""
    return variants(counted(documents, least, every), least, ratio)
