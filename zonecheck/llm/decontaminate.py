"""Benchmark decontamination: test items that documents contain, by size-partitioned MinHash containment search.

Items are partitioned by their number of shingles, two classes to an octave. The shingles of all items make a filter
of fixed size that tells which classes a shingle may belong to; what a document has of a class is its domain there, and
a domain smaller than the share of the class's least item is none. Domains are partitioned by size in turn. In the
partition of sizes up to u, an item of at least q shingles with containment c has a Jaccard similarity of at least
c q / (u + q - c q), from which follows how many MinHash functions find it with the wanted recall. Equal domains, as
copies have, are one. Domains and the items of their class meet in a join on (class, minimum), and each pair met is
verified by exact shingle containment. Only a domain with no more shingles than it would need functions, as one that
holds many items at once, asks by its shingles instead, which misses nothing; ``probes`` tells the path of each domain.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, mix, salted_join, stored
from .shingles import shingle_chunks

#: Places of the filter, a mask of classes each: the broadcast array has four times as many bytes, whatever the number of items.
PLACES = 1 << 21
#: Classes of item sizes; the last one has no upper end.
CLASSES = 32
#: MinHash functions of an item, and of a domain at most.
FUNCTIONS = 64
_SEEDS = mix(np.arange(1, FUNCTIONS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def minima(hashes: np.ndarray, n: int) -> np.ndarray:
    """The minimum of a set under each of the first ``n`` functions; the function's number is mixed in."""
    return mix((hashes[None, :] ^ _SEEDS[:n, None]) * np.uint64(0x9E3779B97F4A7C15)).min(1)


def item_shingles(items: DataFrame, width: int = 5) -> DataFrame:
    """(item_id, shingles, n, class): the distinct shingle hashes of each item that has any, and its size class; rows that share an id are separate."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, out_ids, out = batch.column(0).to_pylist(), [], []
        for first, hashes, counts in shingle_chunks(batch.column(1), width):
            for i, part in enumerate(np.split(hashes, np.cumsum(counts)[:-1])):
                if len(part):
                    out_ids.append(ids[first + i])
                    out.append(part.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(out_ids, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["item_id", "shingles"])

    own = map_batches(items.select("item_id", "text"), rows, "item_id long, shingles array<long>").withColumn("n", F.size("shingles"))
    return own.withColumn("class", F.least(F.floor(2 * F.log2("n") + 1e-9), F.lit(CLASSES - 1)).cast("int"))


def functions_needed(size: int, least_item: int, containment: float, recall: float) -> int | None:
    """MinHash functions that find an item of at least ``least_item`` shingles in a domain of ``size`` with the wanted recall; None: looking up every shingle is no dearer."""
    upper = 1  # of the size's partition
    while upper < size:
        upper = max(upper + 1, upper * 5 // 4)
    shared = containment * least_item
    jaccard = shared / (max(upper + least_item, shared + 1) - shared)
    n = math.ceil(math.log(1 - recall) / math.log(1 - min(jaccard, 0.999)))
    return n if n < size and n <= FUNCTIONS else None


def _places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a shingle in the filter."""
    return (hashes >> np.uint64(43)).astype(np.int64), (hashes & np.uint64(PLACES - 1)).astype(np.int64)


def probes(documents: DataFrame, own: DataFrame, containment: float = 0.8, width: int = 5, recall: float = 0.9999) -> DataFrame:
    """(doc_id, class, set, set2, domain, path, probes): the domains of each document that may contain an item of the class.

    ``own`` is a stored table of ``item_shingles``. ``probes`` are MinHash values if ``path`` is ``minhash``, the
    domain itself if it is ``shingles``; set and set2 are hashes of the domain.
    """
    spark = documents.sparkSession
    # at most CLASSES rows, and at most one row per place of the filter
    least = {r["class"]: r["least"] for r in own.groupBy("class").agg(F.min("n").alias("least")).collect()}
    held = own.select("class", F.explode("shingles").alias("s"))
    place = F.explode(F.array(F.shiftrightunsigned("s", 43).cast("int"), F.col("s").bitwiseAND(PLACES - 1).cast("int")))
    found = held.select("class", place.alias("place")).groupBy("place").agg(F.bit_or(F.expr("shiftleft(1L, class)")).alias("mask")).toPandas()
    masks = np.zeros(PLACES, np.uint32)
    masks[found["place"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64).astype(np.uint32)
    shared = spark.sparkContext.broadcast(masks)

    def domains(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, out = batch.column(0).to_pylist(), []
        for first, hashes, counts in shingle_chunks(batch.column(1), width):
            a, b = _places(hashes)
            mask = shared.value[a] & shared.value[b]
            some = np.flatnonzero(mask)
            doc, mask, kept = np.repeat(np.arange(len(counts)), counts)[some], mask[some], hashes[some]
            for k, q in least.items():
                mine = np.flatnonzero(mask >> np.uint32(k) & np.uint32(1))
                many = np.bincount(doc[mine], minlength=len(counts))
                for d in np.flatnonzero(many >= max(1, math.ceil(containment * q - 1e-9))):
                    part = kept[mine[np.searchsorted(doc[mine], d) :][: many[d]]]
                    n = functions_needed(len(part), q, containment, recall)
                    out.append((ids[first + d], k, part.view(np.int64), "shingles" if n is None else "minhash", (part if n is None else minima(part, n)).view(np.int64)))
        if not out:
            return None
        kind = pa.list_(pa.int64())
        columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), kind, pa.string(), kind), strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "class", "domain", "path", "probes"])

    got = map_batches(documents.select("doc_id", "text"), domains, "doc_id long, class int, domain array<long>, path string, probes array<long>")
    return got.select("doc_id", "class", F.xxhash64("domain").alias("set"), F.xxhash64(F.lit(1), "domain").alias("set2"), "domain", "path", "probes")


def with_rarest(own: DataFrame, containment: float = 0.8) -> DataFrame:
    """``own``, a stored table of distinct rows of ``item_shingles``, with ``rarest``: of n shingles the rarest n - ceil(containment n) + 1 among the items of the class.

    A domain that holds an item to ``containment`` holds one of these, so the others, such as a beginning that all items
    of a benchmark share, need not be looked up.
    """
    row = ["item_id", "class", "n", "__row"]
    each = own.select("item_id", "class", "n", F.xxhash64("shingles").alias("__row"), F.explode("shingles").alias("s"))
    held = stored(each.groupBy("class", "s").agg(F.count("*").alias("n")).withColumn("__often", F.col("n")))
    counted = salted_join(each.withColumnRenamed("n", "__size"), held, ["class", "s"], ["item_id", "__row"]).withColumnRenamed("__size", "n")
    ranked = counted.groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("__often", "s"))).alias("r"))
    need = F.greatest(F.ceil(F.col("n") * containment - 1e-9).cast("int"), F.lit(1))
    return ranked.select("item_id", "class", "n", F.array_sort("r.s").alias("shingles"), F.slice("r.s", F.lit(1), F.col("n") - need + 1).alias("rarest"))


def item_keys(own: DataFrame) -> DataFrame:
    """(item_id, class, path, probe): what each item answers to: its minima, and its rarest shingles for the domains that ask by shingles. ``own`` is a table of ``with_rarest``."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [minima(np.asarray(x.values).view(np.uint64), FUNCTIONS).view(np.int64) for x in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(found, pa.list_(pa.int64()))], names=["item_id", "rarest", "class", "minima"])

    keyed = map_batches(own.select("item_id", "shingles", "rarest", "class"), rows, "item_id long, rarest array<long>, class int, minima array<long>")
    one = lambda path, column: keyed.select("item_id", "class", F.lit(path).alias("path"), F.explode(F.array_distinct(column)).alias("probe"))
    return one("minhash", "minima").unionByName(one("shingles", "rarest"))


def contaminated(documents: DataFrame, items: DataFrame, containment: float = 0.8, width: int = 5, recall: float = 0.9999) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment): the items whose shingles a document holds to at least ``containment``.

    An item of fewer than ``width`` words is one shingle of all its words and meets documents of just those words.
    Null and empty texts contain nothing. Repeated rows of an id and text are one; several texts of one doc_id are
    judged apart and the best is returned. Columns other than doc_id (item_id) and text are not looked at. More items
    fill the filter and make domains larger, not results different.
    """
    own = stored(with_rarest(stored(item_shingles(items, width).distinct()), containment))
    held = stored(probes(documents, own, containment, width, recall))
    name = ["class", "set", "set2"]
    sets = stored(held.groupBy(*name).agg(F.count("*").alias("n"), F.any_value("domain").alias("domain"), F.any_value("path").alias("path"), F.any_value("probes").alias("probes")))
    # a pair met under several keys is one pair; the domain and the shingles follow by joins on the few pairs left
    asked = sets.select(*name, "path", F.explode(F.array_distinct("probes")).alias("probe"))
    # a key that many domains ask by is dealt out: its row holds the items that answer to it, of the benchmark's number at most
    key = ["class", "path", "probe"]
    answers = item_keys(own).groupBy(*key).agg(F.collect_set("item_id").alias("ids"), F.max(F.col("item_id").isNull()).alias("unnamed"))
    answers = stored(answers.join(asked.groupBy(*key).agg(F.count("*").alias("n")), key))
    met = F.explode(F.when(F.col("unnamed"), F.array_append("ids", F.lit(None).cast("long"))).otherwise(F.col("ids")))
    pairs = salted_join(asked, answers, key, ["set", "set2"]).select(*name, met.alias("item_id")).distinct()
    checked = (
        pairs.join(sets.select(*name, "n", "domain"), name)
        .join(own.select(F.col("item_id").alias("own_id"), F.col("class").alias("own_class"), "shingles", F.col("n").alias("n_item")), F.col("item_id").eqNullSafe(F.col("own_id")) & (F.col("class") == F.col("own_class")))
        .withColumn("n_shared", F.size(F.array_intersect("shingles", "domain")))
        .filter(F.col("n_shared") >= containment * F.col("n_item"))
    )
    matched = stored(checked.groupBy(*name).agg(F.max("n").alias("n"), F.collect_list(F.struct("item_id", "n_shared", "n_item")).alias("found")))
    hits = salted_join(held.select("doc_id", *name), matched, name, ["doc_id"]).select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")
    best = hits.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("c"), "n_shared", "n_item")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_shared", "b.n_item", F.col("b.c").alias("containment"))


def remove(documents: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``documents`` without those whose doc_id is contaminated; a document without doc_id goes if any such is."""
    found = contaminated(documents, items, **options).select("doc_id").distinct()
    return documents.join(found, documents["doc_id"].eqNullSafe(found["doc_id"]), "left_anti")
