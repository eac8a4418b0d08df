"""Repeated byte strings of a fixed length, by depth-limited radix sorting of suffixes, and their removal.

A suffix matters through its first ``length`` bytes only, its window. Windows are dealt out by most significant digits
and groups of one are dropped pass by pass; the groups left after the last digit are exactly the repeated windows.

The first digit is the window's anchor: of its 64-byte strings the one with the smallest hash, the first of equals.
Equal windows have equal anchors at equal offsets, and successive windows mostly share theirs, so runs of windows move
as one row, about one for every 170 bytes. The second digit is all that a run's windows cover, which settles runs that
are repeated as a whole; the last, for the runs left and one of each settled kind, is the window itself, by a 128-bit
hash: within a task for groups of a bounded size, by a shuffle for large ones. Counts are combined before each shuffle
and keys that hold many rows are salted, so a passage that a third of all documents share is no task of its own.

So digits here are hashes, not a suffix's own leading bytes, which departs from a radix sort to the letter: only which
suffixes are equal matters, not their order, and of successive suffixes each would be a row by its leading bytes, while
a digit that they share moves them as one.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import CHUNK_BYTES, map_batches, map_groups, mix, ragged, salted_join, stored, text_chunks

ANCHOR = 64
#: Bytes under the runs of a group that is compared in one task; the windows of larger groups are shuffled.
GROUP_BYTES = 4 << 20
_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_VALUES = [mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(m)) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """Powers of a base, more of them when first needed; a text needs as many as it has bytes."""
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, 2 * CHUNK_BYTES), base, np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        if len(got) <= 4 * CHUNK_BYTES:
            _POWERS[base] = got
    return got


class _Hashes:
    """Hashes of all substrings of a buffer."""

    def __init__(self, buf: np.ndarray, which: int) -> None:
        self.which = which
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_VALUES[which][buf] * _powers(_BASES[which], len(buf))[: len(buf)], out=self.sums[1:])

    def at(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        down = _powers(pow(_BASES[self.which], -1, 1 << 64), len(self.sums))
        return mix((self.sums[ends] - self.sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _passes(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each run of windows that share an anchor: text, first start, last start, and the digits: the anchor string and all bytes of its windows."""
    raw = b"".join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    if len(raw) < length or not (sizes >= length).any():
        return [np.zeros(0, np.int64)] * 5
    hashes = _Hashes(np.frombuffer(raw, np.uint8), 0)
    places = np.arange(len(raw) - ANCHOR + 1)
    grams = hashes.at(places, places + ANCHOR)
    # the upper half of the hash, then the place: a minimum is the first of the smallest
    packed = (grams >> np.uint64(32) << np.uint64(32)) | places.astype(np.uint64)
    span = length - ANCHOR + 1
    rows = np.concatenate([packed, np.full(-len(packed) % span, np.iinfo(np.uint64).max)]).reshape(-1, span)
    ahead = np.minimum.accumulate(rows, 1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].reshape(-1)
    n = len(raw) - length + 1
    anchor = (np.minimum(behind[:n], ahead[span - 1 : span - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)[:n]
    fits = np.arange(n) + length <= ends[doc]
    cut = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0) | np.diff(fits, prepend=not fits[0]))
    last = np.append(cut[1:], n) - 1
    cut, last = cut[fits[cut]], last[fits[cut]]
    of, at = doc[cut], anchor[cut]
    begin = (ends - sizes)[of]
    # no polynomial: modulo a power of two they are equal for some regular texts as long as a run (Thue-Morse words)
    view = memoryview(raw)
    whole = np.frombuffer(b"".join([blake2b(view[a:b], digest_size=8).digest() for a, b in zip(cut.tolist(), (last + length).tolist(), strict=True)]), np.uint64)
    offsets = ((at - cut) << 20 | (last - cut)).astype(np.uint64)
    digits = [grams[at], mix(whole ^ mix(offsets))]
    return [of, cut - begin, last - begin, *(d.view(np.int64) for d in digits)]


def _runs(texts: DataFrame, length: int) -> DataFrame:
    """(id, t, first, last, g, w) for (id, t, text): the runs of each text with their digits."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        parts = []
        for first, run in text_chunks(batch.column(2)):
            doc, *rest = _passes(run, length)
            parts.append([first + doc, *rest])
        if not parts:
            return None
        doc, first, last, *digits = (np.concatenate(x) for x in zip(*parts, strict=True))
        take = pa.array(doc)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), batch.column(1).take(take), pa.array(first, pa.int32()), pa.array(last, pa.int32()), *map(pa.array, digits)], names=["id", "t", "first", "last", "g", "w"]
        )

    return map_batches(texts, rows, "id long, t long, first int, last int, g long, w long")


def _pieces(texts: DataFrame, length: int) -> DataFrame:
    """(g, id, t, first, last, n, large, piece) for (id, t, text, runs): the bytes that each run's windows cover."""

    names = ["g", "id", "t", "first", "last", "n", "large", "piece"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for i in range(batch.num_rows):
            raw = batch.column(2)[i].as_py().encode()
            who = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
            out += [(r["g"], *who, r["first"], r["last"], r["n"], r["large"], raw[r["first"] : r["last"] + length]) for r in batch.column(3)[i].as_py()]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)], names=names)

    return map_batches(texts, rows, "g long, id long, t long, first int, last int, n int, large boolean, piece binary", rows=200)


def _windows(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start in its text, two hashes) of every window of a batch of pieces."""
    first, last = (batch.column(j).to_numpy().astype(np.int64) for j in (3, 4))
    raw = [x.as_py() for x in batch.column(7)]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    count = last - first + 1
    starts = ragged(np.cumsum(sizes) - sizes, count)
    buf = np.frombuffer(b"".join(raw), np.uint8)
    row = np.repeat(np.arange(len(raw)), count)
    h1, h2 = (_Hashes(buf, w).at(starts, starts + length).view(np.int64) for w in range(2))
    return row, starts - (np.cumsum(sizes) - sizes)[row] + first[row], h1, h2


def _compared(pieces: DataFrame, length: int) -> DataFrame:
    """(id, t, start): repeated windows of pieces, compared within each ``g``."""

    def settle(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, start, h1, h2 = _windows(batch, length)
        n = batch.column(5).to_numpy()[row]
        order = np.lexsort((h2, h1))
        new = np.ones(len(order), bool)
        new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        group = np.cumsum(new) - 1
        total = np.bincount(group, n[order])
        found = order[(total[group] > 1) & (n[order] == 1)]
        take = pa.array(row[found])
        return pa.RecordBatch.from_arrays([batch.column(1).take(take), batch.column(2).take(take), pa.array(start[found], pa.int32())], names=["id", "t", "start"])

    return map_groups(pieces, "g", settle, "id long, t long, start int")


def _hashed(pieces: DataFrame, length: int) -> DataFrame:
    """(id, t, start, n, h1, h2): every window of the pieces."""

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                row, start, h1, h2 = _windows(part, length)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(1).take(take), part.column(2).take(take), pa.array(start, pa.int32()), part.column(5).take(take), pa.array(h1), pa.array(h2)], names=["id", "t", "start", "n", "h1", "h2"])

    return pieces.mapInArrow(rows, "id long, t long, start int, n int, h1 long, h2 long")


def _named(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("t"), F.coalesce("text", F.lit("")).alias("text"))


def repeats(documents: DataFrame, length: int = 400) -> DataFrame:
    """(id, t, runs, starts): where repeated windows start in each document that holds any: runs of starts (first, last) and single ones.

    A document is named by its doc_id and t, the hash of its text.
    """
    texts = _named(documents)
    all_runs = stored(_runs(texts, length))
    # digits 1 and 2, the anchor string and all bytes of the run's windows, in one map-side combined count: a row per kind of run
    kinds = all_runs.groupBy("g", "w").agg(F.count("*").alias("n"), F.min(F.struct(F.col("id").isNotNull(), "id", "t", "first", "last")).alias("one"))
    kinds = stored(kinds.select("g", "w", "n", "one.id", "one.t", "one.first", "one.last"))
    # runs of a kind with others are repeated as a whole
    sure = salted_join(all_runs, stored(kinds.filter("n > 1").select("g", "w", "n")), ["g", "w"], ["id", "t", "first"], "left_semi").select("id", "t", "first", "last")
    # digit 3: every window of the others, against each other and one run of each sure kind; an anchor with one kind is settled
    left = kinds.groupBy("g").agg(F.count("*").alias("n"), F.sum(F.col("last") - F.col("first") + length).alias("bytes"), F.bool_and(F.col("n") > 1).alias("settled"))
    left = stored(left.filter("n > 1 and not settled").select("g", "n", (F.col("bytes") > GROUP_BYTES).alias("large")))
    wanted = salted_join(kinds.withColumnRenamed("n", "holders"), left, ["g"], ["w"])
    wanted = wanted.groupBy("id", "t").agg(F.collect_list(F.struct("g", "first", "last", F.when(F.col("holders") > 1, 2).otherwise(1).alias("n"), "large")).alias("runs"))
    wanted = wanted.withColumnsRenamed({"id": "wid", "t": "wt"})
    pieces = _pieces(texts.join(wanted, F.col("id").eqNullSafe(F.col("wid")) & (F.col("t") == F.col("wt"))).select("id", "t", "text", "runs"), length)
    # groups of a bounded size are compared where they lie, the windows of larger ones dealt out by their hashes
    small = _compared(pieces.filter("not large"), length)
    windows = _hashed(pieces.filter("large"), length)
    many = stored(windows.groupBy("h1", "h2").agg(F.sum("n").alias("n")).filter("n > 1"))
    single = small.unionByName(salted_join(windows.filter("n = 1").drop("n"), many, ["h1", "h2"], ["id", "t", "start"], "left_semi").select("id", "t", "start"))
    found = sure.groupBy("id", "t").agg(F.collect_list(F.struct("first", "last")).alias("runs")).withColumn("starts", F.array().cast("array<int>"))
    found = found.unionByName(single.groupBy("id", "t").agg(F.array().cast("array<struct<first: int, last: int>>").alias("runs"), F.collect_list("start").alias("starts")))
    return found.groupBy("id", "t").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("starts")).alias("starts"))


def cut(documents: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every document: kept, as binary, is the text without the bytes that a repeated string of ``length`` bytes covers.

    A string is repeated if it also starts anywhere else, in the same document too; strings do not cross documents and
    are judged on the input. Null texts count as empty. Every row gives one row; rows that share doc_id and text are
    documents that repeat each other.
    """
    found = repeats(documents, length).withColumnsRenamed({"id": "__id", "t": "__t"})
    joined = _named(documents).join(found, F.col("id").eqNullSafe(F.col("__id")) & (F.col("t") == F.col("__t")), "left").select("id", "text", "runs", "starts")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for i in range(batch.num_rows):
            raw = batch.column(1)[i].as_py().encode()
            if not batch.column(2)[i].is_valid:
                out.append((len(raw), 0, 0, raw))
                continue
            runs, starts = batch.column(2)[i].values, np.asarray(batch.column(3)[i].values).astype(np.int64)
            edge = np.zeros(len(raw) + 1, np.int64)
            np.add.at(edge, np.concatenate([np.asarray(runs.field(0)), starts]), 1)
            np.add.at(edge, np.concatenate([np.asarray(runs.field(1)), starts]) + length, -1)
            gone = np.cumsum(edge)[:-1] > 0
            spans = int(np.count_nonzero(np.diff(gone, prepend=False) & gone))
            out.append((len(raw), int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes()))
        columns = [pa.array([r[j] for r in out], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return map_batches(joined, rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
