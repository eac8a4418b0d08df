"""Byte-level BPE: texts to token ids and back, by the ranks of a vocabulary file.

Each match of the split pattern is encoded for itself. Over its byte positions lies a segment tree whose leaves hold
the rank of the pair that starts there (none: a large value) and whose nodes hold the leftmost minimum below them. The
root names the next merge; a merge changes three leaves (the merged pair, its live left and right neighbour), each
with one update per level. Short matches, nearly all, go through their trees together, one merge of each per step.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, ragged, text_slices

#: Above every rank; times 128 it still fits 32 bits.
_NONE = 1 << 23
#: Matches with more bytes than this are encoded one by one.
_TOGETHER = 128
#: Distinct matches that a worker remembers, and characters of them.
_KNOWN, _KNOWN_CHARS = 250_000, 1 << 24
#: Matches of a text that are encoded at once.
_MATCHES = 1 << 18


class Vocabulary:
    """Ranks of byte strings, and the rank of every pair of them that joins to a third."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        pairs = [(left << 20 | right, r) for token, r in self.rank.items() for k in range(1, len(token)) if (left := self.rank.get(token[:k])) is not None and (right := self.rank.get(token[k:])) is not None]
        pairs.sort()
        self.pair_key = np.array([k for k, _ in pairs] or [-1], np.int64)
        self.pair_rank = np.array([r for _, r in pairs] or [_NONE], np.int64)
        self.pairs = dict(pairs)
        self.bytes_joined = self.joined(np.repeat(self.single, 256), np.tile(self.single, 256)).astype(np.int32)
        by_id = {r: t for t, r in self.rank.items()}
        tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        numbers = [b"%d," % i for i in range(len(tokens))]
        self.digits = np.frombuffer(b"".join(numbers), np.uint8)
        self.n_digits = np.array([len(x) for x in numbers], np.int64)
        self.digits_start = np.cumsum(self.n_digits) - self.n_digits

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where((self.pair_key[at] == key) & (left >= 0) & (right >= 0), self.pair_rank[at], _NONE)

    def encode_together(self, pieces: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of ids of each) for pieces of 1 to ``size`` bytes, ``size`` a power of two."""
        n, length = len(pieces), np.array([len(p) for p in pieces])
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        inside = np.arange(size) < length[:, None]
        ids = np.full((n, size + 1), -1, np.int32)
        ids[:, :size][inside] = self.single[flat]
        after = np.tile(np.arange(1, size + 1, dtype=np.int16), (n, 1))
        after[after >= length[:, None]] = size
        before = np.tile(np.arange(-1, size, dtype=np.int16), (n, 1))
        # a node: rank of the pair * size + its position, so that the smaller is the leftmost minimum
        tree = np.full((n, 2 * size), _NONE * size, np.int32)
        pairs = np.full(len(flat), _NONE, np.int32)
        pairs[:-1] = self.bytes_joined[flat[:-1].astype(np.int32) << 8 | flat[1:]]
        pairs[np.cumsum(length) - 1] = _NONE
        tree[:, size:][inside] = pairs * size + np.nonzero(inside)[1].astype(np.int32)
        for k in range(size - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])

        def put(r: np.ndarray, at: np.ndarray, rank: np.ndarray) -> None:
            node = at + size
            tree[r, node] = rank * size + at
            while size > 1:
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
                if node[0] == 1:  # all leaves are equally deep
                    break

        live = np.flatnonzero(tree[:, 1] < _NONE * size)
        while len(live):
            rank, at = tree[live, 1] // size, tree[live, 1] % size
            gone = after[live, at]
            beyond = after[live, gone]
            ids[live, at], ids[live, gone] = rank, -1
            after[live, at] = beyond
            before[live, beyond] = at
            put(live, gone, np.full(len(live), _NONE))
            put(live, at, self.joined(rank, ids[live, beyond]))
            left = before[live, at]
            has = left >= 0
            if has.any():
                put(live[has], left[has], self.joined(ids[live[has], left[has]], rank[has]))
            live = live[tree[live, 1] < _NONE * size]
        kept = ids[:, :size] >= 0
        return ids[:, :size][kept], kept.sum(1)

    def encode_alone(self, piece: bytes) -> list[int]:
        """The same for one piece of any length."""
        n = len(piece)
        size = 1 << (n - 1).bit_length() if n > 1 else 1
        none, pairs = _NONE * size, self.pairs
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist() + [-1]
        after, before = [*range(1, n + 1), n], [*range(-1, n)]
        tree = [none] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = pairs.get(ids[i] << 20 | ids[i + 1], _NONE) * size + i
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(at: int, value: int) -> None:
            node = at + size
            tree[node] = value
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        while n > 1 and tree[1] < none:
            rank, at = divmod(tree[1], size)
            gone = after[at]
            beyond = after[gone]
            ids[at], ids[gone] = rank, -1
            after[at] = beyond
            before[beyond] = at
            put(gone, none)
            put(at, pairs.get(rank << 20 | ids[beyond], _NONE) * size + at if beyond < n else none)
            if (left := before[at]) >= 0:
                put(left, pairs.get(ids[left] << 20 | rank, _NONE) * size + left)
        return [x for x in ids[:n] if x >= 0]

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of ids of each), in the order given."""
        length = np.array([len(p) for p in pieces], np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 1
        while size <= _TOGETHER:
            own = np.flatnonzero((length <= size) & (length > size // 2))
            for part in np.array_split(own, max(1, -(-len(own) * size // (1 << 18)))):
                if len(part):
                    done.append((part, *self.encode_together([pieces[i] for i in part], size)))
            size *= 2
        for i in np.flatnonzero(length > _TOGETHER):
            ids = self.encode_alone(pieces[i])
            done.append((np.array([i]), np.array(ids, np.int64), np.array([len(ids)])))
        count = np.zeros(len(pieces), np.int64)
        for part, _, n in done:
            count[part] = n
        first = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int32)
        for part, ids, n in done:
            out[ragged(first[part], n)] = ids
        return out, count

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        return self.bytes[ragged(self.start[ids], self.length[ids])].tobytes()

    def listed(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return self.digits[ragged(self.digits_start[ids], self.n_digits[ids])].tobytes()[:-1]


class Encoder:
    """Texts to ids; remembers the ids of the matches that it has met, up to a number of them."""

    def __init__(self, path: str, pattern: str) -> None:
        self.vocabulary, self.pattern = vocabulary(path), regex.compile(pattern)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.ids, self.count, self.first = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; a text with very many matches by itself, a stretch of them at a time."""
        out: list[np.ndarray] = []
        for t in texts:
            if len(t) > 4 * _MATCHES:
                found = (m.group() for m in self.pattern.finditer(t))
                parts = [self._encode([p])[0] for p in iter(lambda: list(itertools.islice(found, _MATCHES)), [])]
                out.append(np.concatenate(parts) if parts else np.zeros(0, np.int32))
            else:
                out.append(np.zeros(0, np.int32))
        short = [i for i, t in enumerate(texts) if len(t) <= 4 * _MATCHES]
        for i, ids in zip(short, self._encode([self.pattern.findall(texts[i]) for i in short]), strict=True):
            out[i] = ids
        return out

    def _encode(self, pieces: list[list[str]]) -> list[np.ndarray]:
        if len(self.known) > _KNOWN or self.chars > _KNOWN_CHARS:
            self.forget()
        known = self.known
        new = [p for p in set().union(*pieces) if p not in known]
        if new:
            ids, count = self.vocabulary.encode([p.encode() for p in new])
            known.update(zip(new, range(len(self.count), len(self.count) + len(new)), strict=True))
            self.chars += sum(map(len, new))
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
            self.count, self.ids = np.concatenate([self.count, count]), np.concatenate([self.ids, ids])
        out = []
        for p in pieces:
            own = np.fromiter(map(known.__getitem__, p), np.int64, len(p))
            out.append(self.ids[ragged(self.first[own], self.count[own])])
        return out


@functools.lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(documents: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``documents`` with the token ids of ``text`` in the column ``ids``; no shuffle.

    Null and empty texts have no ids. Every row gives one row, repeated rows too; a column that is already named as
    ``ids`` is replaced. An empty table gives an empty one.
    """
    kept = [c for c in documents.columns if c.lower() != ids.lower()]
    frame = documents.select(*kept)
    schema = frame.withColumn(ids, F.array().cast("array<int>")).schema

    def rows(batches):
        enc = encoder(path, pattern)
        for batch in batches:
            for part in text_slices(batch, batch.schema.get_field_index(text)):
                got = enc.encode([t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()])
                ends = np.cumsum([0, *map(len, got)]).astype(np.int32)
                column = pa.ListArray.from_arrays(ends, np.concatenate(got))
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*kept, ids])

    return frame.mapInArrow(rows, schema)


def decode(frame: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``frame`` with the bytes that ``ids`` stands for in the binary column ``text``; null ids give no bytes."""
    kept = [c for c in frame.columns if c.lower() != text.lower()]
    source = frame.select(*kept)
    schema = source.withColumn(text, F.lit(b"")).schema

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        voc = vocabulary(path)
        column = batch.column(batch.schema.get_field_index(ids))
        got = [voc.decode(np.asarray(x.values)) if x.is_valid else b"" for x in column]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], names=[*kept, text])

    return map_batches(source, rows, schema)


def encoded(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256) of every document.

    The digests, in lowercase hex, are of the decimal ids joined by commas and of the bytes that the ids decode to.
    """
    coded = encode(documents.select("doc_id", "text"), path, pattern).select("doc_id", "ids")
    names = ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        voc = vocabulary(path)
        ids = [np.asarray(x.values) for x in batch.column(1)]
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        columns = [pa.array(map(len, ids), pa.int64()), pa.array([sha(voc.listed(x)) for x in ids], pa.string()), pa.array([sha(voc.decode(x)) for x in ids], pa.string())]
        return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)

    return map_batches(coded, rows, coded.select("doc_id", "ids", F.lit(0).cast("long").alias(names[2]), F.lit("").alias(names[3]), F.lit("").alias(names[4])).schema)


def digests(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    return encoded(documents, path, pattern).drop("ids")
