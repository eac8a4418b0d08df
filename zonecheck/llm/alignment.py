"""Alignment of the tokens of two tokenizers, and how often their ids meet in a corpus.

Inside a task, all is Arrow. Token lists are flattened with the index of their document as parent; a cumulative sum of
token lengths, less its value where the document begins, gives every token's end; a full hash join of both sides on the
document and the end tells where only one tokenizer cuts and where both do. Sorted by that key, each row is a stretch of
bytes between two cuts, so a pair of overlapping tokens is one row, and rows with both ends close a group. Pairs are
counted by ``Table.group_by``, first in a document, then over the documents of a task; Spark merges these counts.

Corpus counts come back to the documents in two ways: the most frequent pairs, at most HOT of them, are broadcast, and
links of all other pairs, of which each is rare, are joined by a shuffle.

A text splits into units, mostly a space and a word, or the signs between. Byte-level BPE begins a match at such a
border and no piece of the model reaches over one (else texts stay whole), so a worker remembers the ids of units.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import ragged, stored, text_slices

#: Pairs of ids that are broadcast at most.
HOT = 1 << 19
#: Distinct units that a worker remembers, and characters of them.
_KNOWN, _KNOWN_CHARS = 300_000, 1 << 24
#: Units that are aligned at once; a text with more is aligned in parts, which end where both tokenizers cut.
_UNITS = 1 << 17
#: Distinct pairs that a task counts before it hands them on.
_PAIRS = 1 << 20
#: A unit ends between a letter of these and any other sign of ASCII, and before a space after a character that is none.
_LETTER, _SIGN = "A-Za-zÀ-ÖØ-öø-ÿ", "\\x00-@\\[-`{-\x7f"
_UNIT = re.compile(rf" ?[{_LETTER}]+(?=[{_SIGN}]|\Z)|.+?(?:(?<=[{_LETTER}])(?=[{_SIGN}])|(?<=\S)(?= )|\Z)", re.DOTALL)
_REACHES = re.compile(rf"[{_LETTER}][{_SIGN}]|[^▁]▁")
_BITS = 20


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be seen, else the next from 256."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in seen)}


class Tokenizers:
    """Both tokenizers; ids of units, with a memory of those met."""

    def __init__(self, bpe: str, pieces: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        letters = _byte_letters()
        vocabulary = self.a.get_vocab()
        a = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            a[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        b = [bytes([int(x[1:-1], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        plain = [x for i, x in enumerate(names) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.whole = any(map(_REACHES.search, plain))
        self.space = [self.b.piece_to_id("▁")]
        #: for A and B: the bytes of all tokens, where each token's begin, and how many they are
        self.spelled = []
        for tokens in (a, b):
            length = np.fromiter(map(len, tokens), np.int64, len(tokens))
            self.spelled.append((np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(length) - length, length))
        numbers = [b"%d," % i for i in range(max(len(a), len(b)))]
        self.digits = np.frombuffer(b"".join(numbers), np.uint8)
        self.n_digits = np.fromiter(map(len, numbers), np.int64, len(numbers))
        self.digits_start = np.cumsum(self.n_digits) - self.n_digits
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        none = np.zeros(0, np.int64)
        self.ids, self.first, self.count, self.right = [none, none], [none, none], [none, none], np.zeros(0, bool)

    def units(self, text: str) -> Iterator[list[str]]:
        """The units of a space and the text, in lists."""
        spaced = " " + text
        if self.whole:
            yield [spaced]
        elif len(spaced) <= 4 * _UNITS:
            yield _UNIT.findall(spaced)
        else:
            found = (m.group() for m in _UNIT.finditer(spaced))
            while part := list(itertools.islice(found, _UNITS)):
                yield part

    def pieces(self, units: list[str]) -> list[list[int]]:
        """The ids of B. The model puts a space before what it reads, so a unit without one is read after a letter."""
        got = self.b.encode([u[1:] if u[0] == " " else "a" + u for u in units], num_threads=1)
        return [(self.space if u == " " else ids) if u[0] == " " else ids[1:] for u, ids in zip(units, got, strict=True)]

    def learn(self, units: list[str]) -> None:
        raw = [u.encode() for u in units]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        text = np.frombuffer(b"".join(raw), np.uint8)
        right = np.ones(len(units), bool)
        for k, got in enumerate(([e.ids for e in self.a.encode_batch(units, add_special_tokens=False)], self.pieces(units))):
            count = np.fromiter(map(len, got), np.int64, len(got))
            ids = np.fromiter(itertools.chain.from_iterable(got), np.int64, int(count.sum()))
            self.first[k] = np.concatenate([self.first[k], len(self.ids[k]) + np.cumsum(count) - count])
            self.count[k] = np.concatenate([self.count[k], count])
            self.ids[k] = np.concatenate([self.ids[k], ids])
            # the bytes of the tokens against those of the unit
            flat, start, length = self.spelled[k]
            of = np.repeat(np.arange(len(units)), count)
            right &= np.bincount(of, length[ids], len(units)) == size
            own = ids[right[of]]
            differ = flat[ragged(start[own], length[own])] != text[np.repeat(right, size)]
            right[np.repeat(np.flatnonzero(right), size[right])[differ]] = False
        self.right = np.concatenate([self.right, right])
        self.known.update(zip(units, range(len(self.known), len(self.known) + len(units)), strict=True))
        self.chars += sum(map(len, units))

    def places(self, lists: list[list[str]]) -> np.ndarray:
        """Where the ids of the units of all lists are."""
        if len(self.known) > _KNOWN or self.chars > _KNOWN_CHARS:
            self.forget()
        known = self.known
        if new := [u for u in set().union(*lists) if u not in known]:
            self.learn(new)
        return np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(lists)), np.int64, sum(map(len, lists)))


@functools.lru_cache(2)
def tokenizers_of(bpe: str, pieces: str) -> Tokenizers:
    return Tokenizers(bpe, pieces)


def _ends(ids: pa.ListArray, length: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(ids of all documents, key of each token): the key is the document, then where in it the token ends."""
    flat, parent = pc.list_flatten(ids), pc.list_parent_indices(ids)
    total = pc.cumulative_sum(pc.take(pa.array(length), flat))
    before = pc.take(pa.array(np.concatenate([[0], np.asarray(total)])), ids.offsets[:-1].cast(pa.int64()))
    end = pc.subtract(total, pc.take(before, parent))
    return flat, pc.add(pc.shift_left(parent.cast(pa.int64()), pa.scalar(32, pa.int64())), end)


class Aligned:
    """What one text has so far: a long one is aligned part by part."""

    def __init__(self, spelled: bool) -> None:
        self.right, self.n, self.sha, self.spelled, self.pairs = True, np.zeros(4, np.int64), hashlib.sha256(), [] if spelled else None, []

    def add(self, n: np.ndarray, text: memoryview, pairs: np.ndarray, counts: np.ndarray) -> None:
        for piece in ([b";"] if self.n[0] else []) + [text]:
            self.sha.update(piece)
            if self.spelled is not None:
                self.spelled.append(bytes(piece))
        self.n += n
        self.pairs.append((pairs, counts))

    def done(self) -> tuple:
        """n_a, n_b, n_groups, n_links, digest, pairs, counts, groups as text."""
        if not self.right or not self.n[0]:
            return (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64), "")
        pairs, counts = (np.concatenate(x) for x in zip(*self.pairs, strict=True))
        if len(self.pairs) > 1:
            pairs, of = np.unique(pairs, return_inverse=True)
            counts = np.bincount(of.reshape(-1), counts).astype(np.int64)
        return (*self.n.tolist(), self.sha.hexdigest(), pairs, counts, b"".join(self.spelled or []).decode())


def _align(both: Tokenizers, lists: list[list[str]]) -> list[tuple | None]:
    """For the units of each text: (n_a, n_b, n_groups, n_links), the groups as text, pairs of ids and their links; None if tokens and text differ."""
    places = both.places(lists)
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    of = np.repeat(np.arange(len(lists)), sizes)
    wrong = np.zeros(len(lists), bool)
    wrong[of[~both.right[places]]] = True
    places, of = places[~wrong[of]], of[~wrong[of]]
    out: list[tuple | None] = [None] * len(lists)
    if not len(places):
        return out
    tables, ids = [], []
    for k, (_, _, length) in enumerate(both.spelled):
        count = both.count[k][places]
        tokens = pa.array(both.ids[k][ragged(both.first[k][places], count)])
        ends = np.concatenate([[0], np.cumsum(np.bincount(of, count, len(lists)))]).astype(np.int32)
        flat, key = _ends(pa.ListArray.from_arrays(ends, tokens), length)
        tables.append(pa.table({"key": key, "ab"[k]: np.arange(len(flat))}))
        ids.append(np.asarray(flat))
    cuts = tables[0].join(tables[1], "key", join_type="full outer", use_threads=False).combine_chunks()
    cuts = cuts.take(pc.sort_indices(cuts["key"]))
    row = np.asarray(cuts["key"]) >> 32
    has = [np.asarray(pc.is_valid(cuts[c])) for c in "ab"]
    cut = has[0] & has[1]
    # the token of a stretch of bytes is the next that ends
    a, b = (ids[k][np.asarray(pc.fill_null_backward(cuts["ab"[k]]))] for k in range(2))
    # groups, as text: the tokens in their order, A's before B's in each group, each followed by its sign
    ends = [cut[h] for h in has]
    group = [np.cumsum(e) - e for e in ends]
    of_group = [np.bincount(g) for g in group]
    place_a = np.arange(len(ids[0])) + (np.cumsum(of_group[1]) - of_group[1])[group[0]]
    place_b = np.arange(len(ids[1])) + np.cumsum(of_group[0])[group[1]]
    listed = np.zeros(len(place_a) + len(place_b), np.int64)
    sign = np.zeros(len(listed), np.uint8)
    for k, place in enumerate((place_a, place_b)):
        listed[place] = ids[k]
        sign[place] = np.where(ends[k], ord("|;"[k]), ord(","))
    width = both.n_digits[listed]
    text = both.digits[ragged(both.digits_start[listed], width)]
    after = np.cumsum(width)
    text[after - 1] = sign
    n = np.stack([np.bincount(row[h], minlength=len(lists)) for h in (has[0], has[1], cut, np.ones(len(row), bool))], 1)
    stop = np.append(0, after)[np.cumsum(n[:, 0] + n[:, 1])]
    start = np.append(0, stop[:-1])
    met = pa.table({"key": (row << 2 * _BITS) | (a << _BITS) | b}).group_by("key", use_threads=False).aggregate([([], "count_all")])
    key, links = np.asarray(met["key"]), np.asarray(met["count_all"])
    order = np.argsort(key)
    key, links = key[order], links[order]
    edge = np.searchsorted(key, np.arange(len(lists) + 1) << 2 * _BITS)
    pair = key & ((1 << 2 * _BITS) - 1)
    view = memoryview(text)
    for i in np.flatnonzero(n[:, 0]):
        out[i] = (n[i], view[start[i] : stop[i] - 1], pair[edge[i] : edge[i + 1]], links[edge[i] : edge[i + 1]])
    return out


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate(arrays).astype(np.int32))


_COLUMNS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, links array<int>"


def aligned(documents: DataFrame, bpe: str, pieces: str, spelled: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, a, b, links), and with ``spelled`` also groups, of every document; no shuffle.

    ``bpe`` (a tokenizers file, A) reads a space and the text, ``pieces`` (a sentencepiece model that puts the space
    itself, B) the text, without special tokens. Byte offsets where tokens of both end part them into groups, written
    ``a1,a2|b1;a3|b2,b3``. ``a``, ``b``, ``links``: each pair of ids of which occurrences overlap, and how many do. A text
    that is null or empty, or that the tokens of A or B don't give back byte by byte, has zeros, empty lists and ''. Every
    row gives one row, an empty table an empty one; other columns are not looked at.
    """
    names = ["doc_id", *(x.split()[0] for x in _COLUMNS.split(", ")), *["groups"] * spelled]

    def rows(batches):
        both = tokenizers_of(bpe, pieces)
        for batch in batches:
            for part in text_slices(batch, 1):
                texts = part.column(1).to_pylist()
                found = [Aligned(spelled) for _ in texts]
                held: list[tuple[int, list[str]]] = []

                def settle() -> None:
                    for (i, _), got in zip(held, _align(both, [u for _, u in held]), strict=True):
                        if got is None:
                            found[i].right = False
                        elif found[i].right:
                            found[i].add(*got)
                    held.clear()

                size = 0
                for i, text in enumerate(texts):
                    for units in both.units(text) if text else ():
                        held.append((i, units))
                        size += len(units)
                        if size >= _UNITS:
                            settle()
                            size = 0
                if held:
                    settle()
                got = [x.done() for x in found]
                columns = [pa.array([r[k] for r in got], pa.int64()) for k in range(4)] + [pa.array([r[4] for r in got], pa.string())]
                mask = (1 << _BITS) - 1
                columns += [_lists([r[5] >> _BITS for r in got]), _lists([r[5] & mask for r in got]), _lists([r[6] for r in got])]
                columns += [pa.array([r[7] for r in got], pa.string())] * spelled
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, f"doc_id long, {_COLUMNS}" + ", groups string" * spelled)


def pair_counts(found: DataFrame) -> DataFrame:
    """(a, b, n) for rows with lists ``a`` and ``b`` of distinct pairs: how many rows hold each pair."""

    def counted(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["a", "b", "n"])

    def rows(batches):
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                a, b = (pc.list_flatten(part.column(k)) for k in range(2))
                held.append(counted([pa.table({"a": a, "b": b, "n": pa.array(np.ones(len(a), np.int64))})]))
                size += held[-1].num_rows
                if size > _PAIRS:
                    held = [counted(held)]
                    size = held[0].num_rows
                    if size > _PAIRS // 2:
                        yield from held[0].to_batches()
                        held, size = [], 0
        if held:
            yield from counted(held).to_batches()

    return found.select("a", "b").mapInArrow(rows, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def document_links(documents: DataFrame, bpe: str, pieces: str, hot: int = HOT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document, from ``aligned``.

    The count of a pair of ids is the number of documents that hold it linked; ``n_best`` are the links whose count is the
    highest of their A id, ties included, ``count_sum`` is the sum of counts over all links. At most ``hot`` pairs are
    broadcast, the most frequent; the links of the others are joined by a shuffle.
    """
    found = stored(aligned(documents, bpe, pieces).withColumn("row", F.monotonically_increasing_id()))
    counts = stored(pair_counts(found))
    best = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row per A id: bounded by the vocabulary
    counts = stored(counts.join(F.broadcast(best), "a").select((F.col("a").cast("long") * (1 << _BITS) + F.col("b")).alias("pair"), "n", (F.col("n") == F.col("most")).alias("best"), F.floor(F.log2("n")).cast("int").alias("size")))
    # whole classes of counts, from the largest, while they are at most ``hot`` pairs: at most 64 classes
    total, least = 0, 64
    for r in sorted(counts.groupBy("size").count().collect(), key=lambda r: -r["size"]):
        total += r["count"]
        if total > hot:
            break
        least = r["size"]
    links = found.select("row", F.inline(F.arrays_zip("a", "b", "links"))).select("row", (F.col("a").cast("long") * (1 << _BITS) + F.col("b")).alias("pair"), "links")
    often, seldom = (counts.filter(x).drop("size") for x in (F.col("size") >= least, F.col("size") < least))
    sums = lambda joined: joined.groupBy("row").agg(F.sum(F.col("links") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"))
    summed = sums(links.join(F.broadcast(often), "pair"))
    if total > hot:
        rest = links.join(F.broadcast(often.select("pair")), "pair", "left_anti")
        both = summed.unionByName(sums(rest.join(seldom, "pair")))
        summed = both.groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    named = found.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(summed, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return named.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
