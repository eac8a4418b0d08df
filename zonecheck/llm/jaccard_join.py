"""Near-duplicate join by the Jaccard similarity of word shingles: a chosen-path join.

Documents with equal shingle sets are one class, and a class is one set of the join. Each set has MinHash values at
``WIDTH`` coordinates. In every run the sets are split on the shared value at one coordinate; a bucket with more sets
than ``small`` is split again on three sampled coordinates, until it is small, or splitting no longer thins it (its
sets are alike), or ``depth`` is reached. Buckets are compared by brute force: large ones in blocks, each pair of
blocks on its own. A pair that several buckets share belongs to the first of them, so it is counted once. First the
MinHash values are compared; sets that may be similar to another of a bucket are compared there exactly. Runs repeat
until a pair at the threshold has been met with the target recall.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, map_groups, mix, ragged, salted_join, stored
from .shingles import shingle_chunks

WIDTH = 64
_SEEDS = mix(np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)) | np.uint64(1)
#: Sets of a block in the comparison of large buckets, and about the shingles of a block at most.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20


def signatures(documents: DataFrame, width: int) -> DataFrame:
    """(doc_id, t, a, b, m, sig): two hashes of the shingle set, its size and its MinHash values, 32 bits each; only texts with words. ``t`` is the hash of the text."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        at, a, b, m, sigs = [], [], [], [], []
        for first, hashes, counts in shingle_chunks(batch.column(2), width):
            has = np.flatnonzero(counts)
            if not len(has):
                continue
            starts = (np.cumsum(counts) - counts)[has]
            sig = np.empty((len(has), WIDTH), np.uint32)
            for k, seed in enumerate(_SEEDS):
                h = (hashes ^ (hashes >> np.uint64(29))) * seed
                sig[:, k] = np.minimum.reduceat(h >> np.uint64(32), starts)
            at.append(first + has)
            a.append(np.add.reduceat(mix(hashes), starts))
            b.append(np.add.reduceat(mix(hashes * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)), starts))
            m.append(counts[has])
            sigs += [x.tobytes() for x in sig]
        if not at:
            return None
        take = pa.array(np.concatenate(at))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64)), pa.array(np.concatenate(m), pa.int64()), pa.array(sigs, pa.binary())], names=["doc_id", "t", "a", "b", "m", "sig"]
        )

    frame = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    return map_batches(frame, rows, "doc_id long, t long, a long, b long, m long, sig binary")


def runs_needed(threshold: float, recall: float) -> int:
    """Runs after which a pair at the threshold has shared a bucket: one run splits once at the top, later splits lose 1 - (1 - t)^3 at most."""
    once = threshold * (1 - (1 - threshold) ** 3) ** 3
    return math.ceil(math.log(1 - recall) / math.log(1 - once))


def _children(keys: np.ndarray, sigs: np.ndarray, coordinates: np.ndarray) -> np.ndarray:
    """Bucket below ``keys`` on the values at ``coordinates``."""
    value = np.take_along_axis(sigs, coordinates[:, None], 1)[:, 0].astype(np.uint64)
    return mix(keys + mix(value | coordinates.astype(np.uint64) << np.uint64(32)))


def _split(frame: DataFrame, runs: int | None) -> DataFrame:
    """(bucket, parent, s): at the top one bucket per run, below three per bucket."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, WIDTH)
        out = []
        if runs is None:
            parents = batch.column(2).to_numpy().view(np.uint64)
            for k in range(3):
                out.append((parents, _children(parents, sigs, (mix(parents + np.uint64(k + 1)) % np.uint64(WIDTH)).astype(np.int64))))
        else:
            for r in range(runs):
                parents = np.full(len(sigs), r, np.uint64)
                out.append((parents, _children(parents, sigs, np.full(len(sigs), r * (WIDTH // runs)))))
        ids = pa.chunked_array([batch.column(0)] * len(out)).combine_chunks()
        return pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate([x[0] for x in out]).view(np.int64)), pa.array(np.concatenate([x[1] for x in out]).view(np.int64))], names=["s", "parent", "bucket"])

    return map_batches(frame, rows, "s long, parent long, bucket long")


def buckets(sets: DataFrame, threshold: float, recall: float, small: int, depth: int) -> DataFrame:
    """(s, bucket, size): the buckets of at least two sets that are to be compared; ``sets`` has (s, sig)."""
    found = None
    now = stored(_split(sets.select("s", "sig"), runs_needed(threshold, recall)))
    now = now.withColumn("old", F.lit(None).cast("long"))
    for level in range(depth + 1):
        sizes = now.groupBy("bucket").agg(F.count("*").alias("size"), F.max("old").alias("old")).filter("size > 1")
        ready = (F.col("size") <= small) | (F.col("size") > 0.6 * F.col("old")) | F.lit(level == depth)
        sizes = stored(sizes.withColumn("n", F.col("size")))
        sized = stored(salted_join(now.select("s", "bucket"), sizes, ["bucket"], ["s"]).withColumn("ready", F.coalesce(ready, F.lit(False))))
        done = sized.filter("ready").select("s", "bucket", "size")
        found = done if found is None else found.unionByName(done)
        rest = sized.filter("not ready")
        if level == depth or rest.isEmpty():
            break
        below = rest.join(sets.select("s", "sig"), "s").select("s", "sig", "bucket")
        olds = rest.select(F.col("bucket").alias("parent"), F.col("size").alias("old")).distinct()
        now = stored(_split(below, None).join(olds, "parent"))
    return found.groupBy("s", "bucket").agg(F.max("size").alias("size"))


def _blocked(frame: DataFrame, block: int) -> DataFrame:
    """Adds (i, j, side): the pairs of blocks of its bucket that a set is in; a bucket of n blocks has n (n + 1) / 2 of them."""
    n = F.ceil(F.col("size") / block).cast("int")
    own = frame.withColumn("n", n).withColumn("own", F.pmod(F.xxhash64("s", "bucket"), F.col("n")).cast("int"))
    return own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        "*", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), (F.col("own") >= F.col("other")).alias("right")
    ).withColumn("pair", F.xxhash64("bucket", "i", "j"))


class _Blocks:
    """The rows of a batch by group: each group is a pair of blocks of one bucket."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        key = self.columns["pair"].to_numpy()
        self.starts = np.flatnonzero(np.diff(key, prepend=~key[0]))
        self.sizes = np.diff(np.append(self.starts, len(key)))
        self.bucket = self.columns["bucket"].to_numpy()
        self.left, self.right = (self.columns[c].to_numpy(zero_copy_only=False) for c in ("left", "right"))
        lists = self.columns["all"]
        ends = lists.offsets.to_numpy()
        size = np.diff(ends)
        self.shared = np.full((len(key), int(size.max())), np.iinfo(np.int64).max)
        self.shared[np.arange(self.shared.shape[1]) < size[:, None]] = lists.values.to_numpy()[ends[0] : ends[-1]]

    def first(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether its bucket is the smallest that sets x and y share."""
        out = self.bucket[x] == self.bucket[y]
        for k in range(self.shared.shape[1]):
            mine = self.shared[x, k]
            out &= ~((mine < self.bucket[x]) & (self.shared[y] == mine[:, None]).any(1))
        return out

    def groups(self):
        """(first row, end, left rows, right rows, whether left and right are one block) of each group."""
        for a, n in zip(self.starts, self.sizes, strict=True):
            left, right = a + np.flatnonzero(self.left[a : a + n]), a + np.flatnonzero(self.right[a : a + n])
            yield a, a + n, left, right, len(left) == len(right) == n


def _candidates(batch: pa.RecordBatch, least: float) -> pa.RecordBatch:
    """Sets that may be similar to one on the other side of their pair of blocks, by their MinHash values."""
    blocks = _Blocks(batch)
    sigs = np.frombuffer(b"".join(blocks.columns["sig"].to_pylist()), np.uint32).reshape(-1, WIDTH)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    # small groups together: every pair of rows of a group
    row = np.arange(len(sigs))
    group = np.repeat(np.arange(len(blocks.sizes)), blocks.sizes)
    end = (blocks.starts + blocks.sizes)[group]
    small = blocks.sizes[group] <= 64
    after = np.where(small, end - row - 1, 0)
    for part in np.array_split(row, max(1, int(after.sum()) >> 18)):
        x = np.repeat(part, after[part])
        y = ragged(part + 1, after[part])
        keep = (sigs[x] == sigs[y]).sum(1) >= least * WIDTH
        keep &= (blocks.left[x] & blocks.right[y]) | (blocks.right[x] & blocks.left[y])
        found.append((x[keep], y[keep]))
    for a, b, left, right, one in blocks.groups():
        if b - a <= 64:
            continue
        for at in range(0, len(left), 64):
            part = left[at : at + 64]
            same = np.zeros((len(part), len(right)), np.int16)
            for k in range(WIDTH):
                same += sigs[part, k][:, None] == sigs[right, k]
            p, q = np.nonzero(same >= least * WIDTH)
            x, y = part[p], right[q]
            keep = x < y if one else x != y
            found.append((x[keep], y[keep]))
    hot = np.zeros(len(sigs), bool)
    for x, y in found:
        mine = blocks.first(x, y)
        hot[x[mine]] = hot[y[mine]] = True
    take = pa.array(np.flatnonzero(hot))
    return pa.RecordBatch.from_arrays([blocks.columns[c].take(take) for c in ("s", "bucket", "all")], names=["s", "bucket", "all"])


def _similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in left, place in right) of sets with a Jaccard similarity of at least ``threshold``, exactly."""
    sizes = np.array([len(x) for x in sets])
    doc = np.repeat(np.arange(len(sets)), sizes)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    # only shingles that at least two sets hold count, and of these a stretch at a time
    often = np.bincount(column, minlength=len(values)) > 1
    number = np.cumsum(often) - 1
    doc, column = doc[often[column]], number[column[often[column]]]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    common = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(often.sum()), 4096):
        a, b = np.searchsorted(column, (at, at + 4096))
        x = np.zeros((len(sets), 4096), np.float32)
        x[doc[a:b], column[a:b] - at] = 1
        common += x[left] @ x[right].T
    p, q = np.nonzero(common >= threshold * (sizes[left][:, None] + sizes[right] - common) - 1e-3)
    shared = common[p, q].astype(np.int64)
    keep = shared >= threshold * (sizes[left[p]] + sizes[right[q]] - shared)
    return p[keep], q[keep]


def _links(batch: pa.RecordBatch, threshold: float) -> pa.RecordBatch:
    """(s, links, to): for each set of a pair of blocks the documents it is linked to here, and the smallest set of its linked group here."""
    blocks = _Blocks(batch)
    lists = blocks.columns["shingles"]
    weight, ids = blocks.columns["docs"].to_numpy(), blocks.columns["s"].to_numpy()
    links, group, has = np.zeros(len(ids), np.int64), ids.copy(), np.zeros(len(ids), bool)
    for a, b, left, right, one in blocks.groups():
        p, q = _similar([lists[i].values.to_numpy() for i in range(a, b)], left - a, right - a, threshold)
        x, y = left[p], right[q]
        keep = x < y if one else x != y
        x, y = x[keep], y[keep]
        mine = blocks.first(x, y)
        x, y = x[mine], y[mine]
        if not len(x):
            continue
        np.add.at(links, x, weight[y])
        np.add.at(links, y, weight[x])
        has[x] = has[y] = True
        own = group[a:b]
        while True:  # the smallest id spreads over the links of this group
            low = own.copy()
            np.minimum.at(low, x - a, own[y - a])
            np.minimum.at(low, y - a, own[x - a])
            if (low == own).all():
                break
            own = low
        group[a:b] = own
    return pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(links[has]), pa.array(group[has])], names=["s", "links", "to"])


def components(edges: DataFrame) -> DataFrame:
    """(s, root): the smallest set of the group of each set in ``edges`` (s, to). Alternates: every set points its
    neighbours to the smallest of them, until nothing changes; a table is written each time."""
    edges = stored(edges.filter("s <> to").select(F.greatest("s", "to").alias("s"), F.least("s", "to").alias("to")).distinct())
    while True:
        # larger neighbours of each set go to its smallest neighbour (or itself), and so do the smaller ones then
        both = edges.unionByName(edges.select(F.col("to").alias("s"), F.col("s").alias("to")))
        low = both.groupBy("s").agg(F.least("s", F.min("to")).alias("m"), F.count("*").alias("n"))
        # the smallest set of a group may have all of it beside it
        large = salted_join(both, stored(low), ["s"], ["to"]).filter("to > s").select(F.col("to").alias("s"), F.col("m").alias("to")).filter("s <> to").distinct()
        large = stored(large)
        least = stored(large.groupBy("s").agg(F.min("to").alias("m"), F.count("*").alias("n")))
        small = salted_join(large, least, ["s"], ["to"])
        next_ = small.filter("to <> m").select(F.col("to").alias("s"), F.col("m").alias("to")).unionByName(least.select("s", F.col("m").alias("to"))).distinct()
        next_ = stored(next_)
        same = next_.join(edges, ["s", "to"], "left_anti").isEmpty() and edges.join(next_, ["s", "to"], "left_anti").isEmpty()
        edges = next_
        if same:
            return edges.select("s", F.col("to").alias("root"))


def link(documents: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.9999, small: int = 64, depth: int = 3) -> DataFrame:
    """(doc_id, t, class_id, n_links, leads) for each distinct doc_id and text (t: the text's hash).

    n_links is the number of other documents whose shingle sets have a Jaccard similarity of at least ``threshold``
    with this one's, copies included. class_id is the smallest doc_id of the group that links connect, and leads marks
    the group's first row by (doc_id, t), nulls last. A text without words (null and empty, too) links to nothing; it
    is its own class.
    """
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(signatures(base, width))
    members = signed.select("doc_id", "t", "a", "b").distinct()
    # a class's number is a hash of its set, so that it needs no order
    number = F.xxhash64("a", "b")
    sets = stored(signed.groupBy("a", "b").agg(F.any_value("sig").alias("sig"), F.any_value("m").alias("m"), F.count_distinct("doc_id", "t").alias("docs"), F.min(F.struct(F.col("t"), F.col("doc_id"))).alias("one")).withColumn("s", number))
    found = buckets(sets, threshold, recall, small, depth)
    lists = found.groupBy("s").agg(F.collect_list("bucket").alias("all"))  # as many as runs and splits
    ready = found.join(lists, "s").join(sets.select("s", "sig"), "s")
    near = map_groups(_blocked(ready, BLOCK).select("pair", "bucket", "s", "sig", "all", "left", "right"), "pair", lambda b: _candidates(b, threshold - 0.25), "s long, bucket long, all array<long>")
    near = stored(near.groupBy("s", "bucket").agg(F.any_value("all").alias("all")))
    # long sets make more and smaller blocks
    weighed = near.join(sets.select("s", "m"), "s").groupBy("bucket").agg(F.count("*").alias("n"), F.sum("m").alias("m"))
    weighed = weighed.withColumn("size", F.ceil(F.greatest(F.col("n"), F.col("m") / BLOCK_SHINGLES * BLOCK)).cast("long")).drop("m")
    near = salted_join(near, stored(weighed), ["bucket"], ["s"])
    # texts of the sets that are compared exactly
    texts = sets.join(near.select("s").distinct(), "s", "left_semi").select("s", "docs", F.col("one.t").alias("one_t"), F.col("one.doc_id").alias("one_id"))
    hashed = base.withColumn("t", F.xxhash64("text"))
    texts = hashed.join(texts, (F.col("t") == F.col("one_t")) & F.col("doc_id").eqNullSafe(F.col("one_id"))).select("s", "docs", "text").dropDuplicates(["s"])
    exact = near.join(_sets(texts, width), "s")
    pairs = _blocked(exact, BLOCK).select("pair", "bucket", "s", "docs", "shingles", "all", "left", "right")
    linked = stored(map_groups(pairs, "pair", lambda b: _links(b, threshold), "s long, links long, to long", rows=256))
    degree = linked.groupBy("s").agg(F.sum("links").alias("links"))
    roots = components(linked.select("s", "to"))
    per_set = sets.select("a", "b", "s", "docs").join(degree, "s", "left").join(roots, "s", "left").select("a", "b", F.col("docs").alias("n"), (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("n_links"), F.coalesce("root", "s").alias("root"))
    # copies of one text, and the documents of one group, may be a third of all rows
    full = stored(salted_join(members, stored(per_set), ["a", "b"], ["doc_id", "t"]).select("doc_id", "t", "n_links", "root"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "t")
    first = stored(full.groupBy("root").agg(F.min(order).alias("f"), F.count("*").alias("n")))
    marked = salted_join(full, first, ["root"], ["doc_id", "t"]).select("doc_id", "t", F.coalesce("f.doc_id", "doc_id").alias("class_id"), "n_links", (order == F.col("f")).alias("leads"))
    others = hashed.select("doc_id", "t").distinct().join(members.select(F.col("doc_id").alias("d"), F.col("t").alias("mt")), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("mt")), "left_anti")
    return marked.unionByName(others.select("doc_id", "t", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("leads")))


def _sets(texts: DataFrame, width: int) -> DataFrame:
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for _, hashes, counts in shingle_chunks(batch.column(2), width):
            out += [x.view(np.int64) for x in np.split(hashes, np.cumsum(counts)[:-1])]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["s", "docs", "shingles"])

    return map_batches(texts, rows, "s long, docs long, shingles array<long>")


def keep_one(documents: DataFrame, **options) -> DataFrame:
    """``documents`` with one document, the first, of each group; rows that share doc_id and text are one and stay once each."""
    leads = link(documents.select("doc_id", "text"), **options).filter("leads").select("doc_id", "t")
    return documents.join(leads, documents["doc_id"].eqNullSafe(leads["doc_id"]) & (F.xxhash64(documents["text"]) == leads["t"]), "left_semi")
