"""Repeated runs of words, by super-k-mer partitioning, and their removal.

A window is ``length`` consecutive words of one document. Its minimiser is, of its strings of MINIMISER words, the one
with the smallest hash, the first of equals. Consecutive windows that share a minimiser are one super-k-mer: it travels
as one packed string (its words, joined by spaces) to the bucket of the minimiser, where its windows are sorted against
those of the other strings. Equal windows have equal minimisers at equal offsets, so they meet in one bucket.

Before any text travels, super-k-mers are counted by minimiser and a 128-bit digest, combined before the shuffle. One
that occurs more than once is repeated as a whole and sends one string for all its copies; a minimiser with one
super-k-mer sends none. Buckets of more than BUCKET strings don't meet in one task: their windows travel one by one,
by 128-bit digests, and are counted by combined sums; so a passage that a third of all documents hold is no task of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, map_groups, mix, ragged, salted_join, stored

MINIMISER = 8
#: Packed strings of a bucket that is sorted in one task.
BUCKET = 1 << 12
#: Bytes of a text that are cut into words at once, and words that are hashed at once.
BLOCK_BYTES, BLOCK_WORDS = 1 << 20, 1 << 16
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_blocks(raw: bytes, size: int | None = None) -> Iterator[list[bytes]]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in lists from about ``size`` bytes each."""
    size = BLOCK_BYTES if size is None else size
    at = 0
    while at < len(raw):
        space = _SPACE.search(raw, at + size)
        end = space.start() if space else len(raw)
        yield raw[at:end].split()  # bytes.split takes just these six characters as space
        at = end


class Stretch(NamedTuple):
    """Words of a row of a batch, from word ``first`` of its text."""

    row: int
    first: int
    words: list[bytes]


def _stretches(texts: pa.Array, length: int) -> Iterator[list[Stretch]]:
    """Lists of stretches of about BLOCK_WORDS words, each window of each text in one of them."""
    held: list[Stretch] = []
    size = 0
    for row, value in enumerate(texts):
        first, words = 0, []
        for block in word_blocks((value.as_py() or "").encode()):
            words = words + block
            if len(words) < length:
                continue
            held.append(Stretch(row, first, words))
            size += len(words)
            if size >= BLOCK_WORDS:
                yield held
                held, size = [], 0
            cut = len(words) - length + 1
            first, words = first + cut, words[cut:]
    if held:
        yield held


def _ids(words: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    coded = pa.array(words, pa.binary()).dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary


def _hashes(words: list[bytes]) -> list[np.ndarray]:
    """Two 64-bit hashes of each word."""
    ids, distinct = _ids(words)
    own = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in distinct.to_pylist()), np.uint64).reshape(-1, 2)
    return [own[ids, 0], own[ids, 1]]


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _LEFT + mix(right * _RIGHT))


def _doubled(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of ``size`` words, a power of two, from those of single words."""
    n = 1
    while n < size:
        h = _joined(h[:-n], h[n:])
        n *= 2
    return h


def _half(length: int) -> int:
    return 1 << (length.bit_length() - 1)


def _digest(block: np.ndarray, size: int, first: np.ndarray, words: np.ndarray, most: int) -> np.ndarray:
    """Hash of ``words`` words (``size`` to ``most``) from ``first``, by blocks of ``size`` words that cover them."""
    end = first + words - size
    h = block[end] + words.astype(np.uint64)
    for k in range(-(-most // size) - 1):
        at = first + k * size
        inside = at < end
        h = np.where(inside, _joined(block[np.where(inside, at, end)], h), h)
    return mix(h)


def _minimisers(grams: np.ndarray, n: int, span: int) -> np.ndarray:
    """Where the smallest of ``span`` grams from each of the first ``n`` places is, the first of equals."""
    packed = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    rows = np.concatenate([packed, np.full(-len(packed) % span, np.iinfo(np.uint64).max)]).reshape(-1, span)
    ahead = np.minimum.accumulate(rows, 1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].reshape(-1)
    return (np.minimum(behind[:n], ahead[span - 1 : span - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _superkmers(held: list[Stretch], length: int, m: int) -> list[np.ndarray]:
    """Row, first and last window (in words of the text), minimiser and digest of every super-k-mer of the stretches."""
    sizes = np.array([len(s.words) for s in held])
    hashes = _hashes([w for s in held for w in s.words])
    n = len(hashes[0]) - length + 1
    grams = _doubled(hashes[0], m)
    least = _minimisers(grams, n, length - m + 1)
    of = np.repeat(np.arange(len(held)), sizes)
    fits = of[:n] == of[length - 1 :]
    cut = np.flatnonzero((np.diff(least, prepend=-1) != 0) | (np.diff(of[:n], prepend=-1) != 0) | np.diff(fits, prepend=not fits[0]))
    last = np.append(cut[1:], n) - 1
    cut, last = cut[fits[cut]], last[fits[cut]]
    half = _half(length)
    place = mix((least[cut] - cut).astype(np.uint64))  # equal words with another minimiser are another super-k-mer
    digests = [_digest(_doubled(h, half), half, cut, last - cut + length, 2 * length - m) ^ place for h in hashes]
    shift = np.array([s.first for s in held])[of[cut]] - (np.cumsum(sizes) - sizes)[of[cut]]
    return [np.array([s.row for s in held])[of[cut]], cut + shift, last + shift, *(d.view(np.int64) for d in (grams[least[cut]], *digests))]


def superkmers(texts: DataFrame, length: int, m: int = MINIMISER) -> DataFrame:
    """(id, t, first, last, g, w1, w2) for (id, t, text): the super-k-mers of each text, with minimiser and digest, without their words."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        parts = [_superkmers(held, length, m) for held in _stretches(batch.column(2), length)]
        if not parts:
            return None
        row, first, last, *digests = (np.concatenate(x) for x in zip(*parts, strict=True))
        take = pa.array(row)
        columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(first, pa.int32()), pa.array(last, pa.int32()), *map(pa.array, digests)]
        return pa.RecordBatch.from_arrays(columns, names=["id", "t", "first", "last", "g", "w1", "w2"])

    return map_batches(texts, rows, "id long, t long, first int, last int, g long, w1 long, w2 long", rows=200)


_PACKED = "g long, id long, t long, first int, last int, n int, large boolean, packed binary"


def _packed(texts: DataFrame, length: int) -> DataFrame:
    """(g, id, t, first, last, n, large, packed) for (id, t, text, runs): the words of each super-k-mer, joined by spaces."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
    names = [x.split()[0] for x in _PACKED.split(", ")]

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for i in range(batch.num_rows):
            who = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
            at, words = 0, []
            runs = sorted(batch.column(3)[i].as_py(), key=lambda r: r["first"])
            blocks = word_blocks(batch.column(2)[i].as_py().encode())
            for r in runs:
                while at + len(words) < r["last"] + length:
                    past = max(0, min(r["first"] - at, len(words)))
                    words, at = words[past:] + next(blocks), at + past
                out.append((r["g"], *who, r["first"], r["last"], r["n"], r["large"], b" ".join(words[r["first"] - at : r["last"] + length - at])))
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)], names=names)

    return map_batches(texts, rows, _PACKED, rows=100)


def _windows(batch: pa.RecordBatch, length: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The words of a batch of packed strings; row, place among the words, and start in its text of each window."""
    first, last = (batch.column(j).to_numpy().astype(np.int64) for j in (3, 4))
    words = b" ".join(x.as_py() for x in batch.column(7)).split()
    begin = np.cumsum(last - first + length) - (last - first + length)
    count = last - first + 1
    row = np.repeat(np.arange(len(first)), count)
    at = ragged(begin, count)
    return words, row, at, at - begin[row] + first[row]


def _ranks(ids: np.ndarray, length: int) -> np.ndarray:
    """The rank of the ``length`` words from each place among all such strings: equal for equal strings only."""
    rank, n = ids, 1
    while n < length:
        step = min(n, length - n)
        rank = np.unique(rank[:-step] * (rank.max() + 1) + rank[step:], return_inverse=True)[1].reshape(-1)
        n += step
    return rank


def _sorted(packed: DataFrame, length: int) -> DataFrame:
    """(id, t, start): the repeated windows of the buckets, each sorted in one task."""

    def settle(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, row, at, start = _windows(batch, length)
        n = batch.column(5).to_numpy()[row]
        rank = _ranks(_ids(words)[0], length)[at]
        found = (np.bincount(rank, n)[rank] > 1) & (n == 1)
        take = pa.array(row[found])
        return pa.RecordBatch.from_arrays([batch.column(1).take(take), batch.column(2).take(take), pa.array(start[found], pa.int32())], names=["id", "t", "start"])

    return map_groups(packed, "g", settle, "id long, t long, start int", rows=1000)


def _single(packed: DataFrame, length: int) -> DataFrame:
    """(id, t, start, n, h1, h2): every window of the packed strings with its digest."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, row, at, start = _windows(batch, length)
        half = _half(length)
        sized = np.full(len(at), length)
        h1, h2 = (_digest(_doubled(h, half), half, at, sized, length).view(np.int64) for h in _hashes(words))
        take = pa.array(row)
        return pa.RecordBatch.from_arrays([batch.column(1).take(take), batch.column(2).take(take), pa.array(start, pa.int32()), batch.column(5).take(take), pa.array(h1), pa.array(h2)], names=["id", "t", "start", "n", "h1", "h2"])

    return map_batches(packed, rows, "id long, t long, start int, n int, h1 long, h2 long", rows=500)


def _named(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("t"), F.coalesce("text", F.lit("")).alias("text"))


def repeats(documents: DataFrame, length: int = 35) -> DataFrame:
    """(id, t, runs, starts): where repeated windows start in each document that holds any, in words: runs of starts (first, last) and single ones.

    A document is named by its doc_id and t, the hash of its text.
    """
    texts = _named(documents)
    key = ["g", "w1", "w2"]
    every = stored(superkmers(texts, length, min(MINIMISER, _half(length))))
    kinds = stored(every.groupBy(*key).agg(F.count("*").alias("holders")))
    # buckets of several kinds, unless all of them are repeated as a whole
    open_ = kinds.groupBy("g").agg(F.count("*").alias("n"), F.bool_and(F.col("holders") > 1).alias("settled"))
    open_ = stored(open_.filter("n > 1").select("g", "n", F.when(~F.col("settled"), F.col("n") > BUCKET).alias("large")))
    asked = salted_join(kinds, open_, ["g"], ["w1"], "left").filter("holders > 1 or large is not null")
    hits = stored(salted_join(every, stored(asked.withColumn("n", F.col("holders"))), key, ["id", "t", "first"]))
    sure = hits.filter("holders > 1").select("id", "t", "first", "last")
    # one super-k-mer of each kind goes to its bucket
    wanted = hits.filter("large is not null")
    several = wanted.filter("holders > 1").groupBy(*key, "large").agg(F.min(F.struct(F.col("id").isNotNull(), "id", "t", "first", "last")).alias("one"))
    several = several.select("g", "large", "one.id", "one.t", "one.first", "one.last", F.lit(2).alias("n"))
    wanted = wanted.filter("holders = 1").select("g", "large", "id", "t", "first", "last", F.lit(1).alias("n")).unionByName(several)
    wanted = wanted.groupBy("id", "t").agg(F.collect_list(F.struct("g", "first", "last", "n", "large")).alias("runs"))
    wanted = wanted.withColumnsRenamed({"id": "wid", "t": "wt"})
    packed = stored(_packed(texts.join(wanted, F.col("id").eqNullSafe(F.col("wid")) & (F.col("t") == F.col("wt"))).select("id", "t", "text", "runs"), length))
    windows = _single(packed.filter("large"), length)
    many = stored(windows.groupBy("h1", "h2").agg(F.sum("n").alias("n")).filter("n > 1"))
    single = _sorted(packed.filter("not large"), length).unionByName(salted_join(windows.filter("n = 1").drop("n"), many, ["h1", "h2"], ["id", "t", "start"], "left_semi").select("id", "t", "start"))
    found = sure.groupBy("id", "t").agg(F.collect_list(F.struct("first", "last")).alias("runs")).withColumn("starts", F.array().cast("array<int>"))
    found = found.unionByName(single.groupBy("id", "t").agg(F.array().cast("array<struct<first: int, last: int>>").alias("runs"), F.collect_list("start").alias("starts")))
    return found.groupBy("id", "t").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("starts")).alias("starts"))


def cut(documents: DataFrame, length: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every document: kept is its words without those that a repeated window covers, joined by one space.

    A window is repeated if its sequence of words also starts anywhere else, in the same document too; windows do not
    cross documents and are judged on the input. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; null texts have none.
    Every row gives one row; rows that share doc_id and text are documents that repeat each other. An empty table gives
    an empty one; other columns of ``documents`` are not looked at.
    """
    found = repeats(documents, length).withColumnsRenamed({"id": "__id", "t": "__t"})
    joined = _named(documents).join(found, F.col("id").eqNullSafe(F.col("__id")) & (F.col("t") == F.col("__t")), "left").select("id", "text", "runs", "starts")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for i in range(batch.num_rows):
            gone = np.zeros(0, bool)
            if batch.column(2)[i].is_valid:
                runs, starts = batch.column(2)[i].values, np.asarray(batch.column(3)[i].values).astype(np.int64)
                begin, end = np.concatenate([np.asarray(runs.field(0)), starts]), np.concatenate([np.asarray(runs.field(1)), starts]) + length
                edge = np.zeros(int(end.max()) + 1, np.int64)
                np.add.at(edge, begin, 1)
                np.add.at(edge, end, -1)
                gone = np.cumsum(edge)[:-1] > 0
            n, kept = 0, []
            for words in word_blocks(batch.column(1)[i].as_py().encode()):
                own = gone[n : n + len(words)]
                kept += [words[j] for j in np.flatnonzero(~own)] + words[len(own) :]
                n += len(words)
            out.append((n, int(gone.sum()), b" ".join(kept).decode()))
        columns = [pa.array([r[j] for r in out], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "n_removed", "kept"])

    return map_batches(joined, rows, "doc_id long, n_words long, n_removed long, kept string", rows=200)
