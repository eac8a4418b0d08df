"""Nearest neighbours by inner product over balanced posting lists.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm, so that all lie on a sphere and the largest
inner product is the smallest distance. Centroids are fitted on a bounded sample. Every vector is posted to its nearest
centroid and, near a boundary, to others whose distance is within a ratio of the nearest one's. Lists longer than a
bound are split evenly by a hash, queries of a list likewise, so that a task meets a bounded block of both. A query
finds centroids by a walk over a neighbour graph of the centroids and probes the lists within a distance ratio.
"""

from __future__ import annotations

import functools
import math
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Vectors that the centroids are fitted on: so many at least, and so many for each centroid.
SAMPLE, PER_CENTROID = 20_000, 16
#: Rows whose distances to all centroids are held at once.
_ROWS = 2048


class Index(NamedTuple):
    """Centroids (lifted), their neighbour graph, walk entries and the largest norm; a size set by parameters."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    top: float


def usable(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that take part, as doubles; not null, not zero, all components finite."""
    v = F.col(vec).cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(fine)


def _lift(x: np.ndarray, top: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(top * top - np.einsum("ij,ij->i", x, x), 0.0))
    return np.concatenate([x, rest[:, None]], 1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(np.einsum("ij,ij->i", a, a)[:, None] - 2 * a @ b.T + np.einsum("ij,ij->i", b, b), 0.0))


def lists_for(n: int, per_list: int, most_lists: int) -> int:
    """Lists for ``n`` vectors: one for every ``per_list``, but from 9 * per_list^2 vectors on 3 * sqrt(n), so that lists and their number grow alike."""
    return max(1, min(-(-n // per_list), 3 * math.isqrt(n) + 1, most_lists))


def _nearest(x: np.ndarray, centroids: np.ndarray, extra: np.ndarray) -> np.ndarray:
    return np.concatenate([(_distances(x[i : i + _ROWS], centroids) + extra).argmin(1) for i in range(0, len(x), _ROWS)])


def fit(vectors: DataFrame, per_list: int = 128, most_lists: int = 32_768, sample: int = SAMPLE, rounds: int = 8, degree: int = 16, seed: int = 1) -> Index:
    """Centroids by k-means with a weight against full clusters, on a sample of the rows of small hash.

    The sample has ``sample`` distinct rows or PER_CENTROID for each centroid, whichever is more; so ``most_lists``
    bounds the sample (524,288 rows), the index and what the driver gets, at whatever number of vectors. Beyond some
    120 million vectors lists grow in place of their number; they are split, so that tasks do not grow.

    ``vectors`` has (vec_id, v). Only the sample, the largest norm and the count reach the driver.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    top, n = vectors.agg(F.max(norm), F.count("*")).first()
    size = max(sample, PER_CENTROID * lists_for(n, per_list, most_lists))
    place = F.pmod(F.xxhash64(F.lit(seed), "vec_id", "v"), F.lit(1 << 40))
    # a tenth more than wanted, so that fewer are hardly ever got; each task filters its own rows
    rows = vectors.withColumn("place", place).filter(F.col("place") < int(min(1.0, 1.1 * size / max(n, 1)) * (1 << 40))).distinct().toPandas()
    if not len(rows):
        return Index(np.zeros((0, 1)), np.zeros((0, 0), int), np.zeros(0, int), 0.0)
    rows = rows.sort_values(["place", "vec_id"], kind="stable").head(size)
    width = int(rows["v"].map(len).mode()[0])
    x = _lift(np.stack([v for v in rows["v"] if len(v) == width]), top)
    random = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    k = min(lists_for(n, per_list, most_lists), len(distinct))
    centroids = distinct[random.choice(len(distinct), k, replace=False)]
    extra = np.zeros(k)
    for _ in range(rounds):
        own = _nearest(x, centroids, extra)
        held = np.bincount(own, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        centroids = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], distinct[random.choice(len(distinct), k)])
        # a full cluster becomes a little dearer, an empty one cheaper
        extra += 0.02 * top * np.clip(held / (len(x) / k) - 1, -1, 1)
    near = np.concatenate([np.argsort(_distances(centroids[i : i + _ROWS], centroids), 1, kind="stable")[:, 1 : degree + 1] for i in range(0, k, _ROWS)])
    # links that lead far keep the graph in one piece
    far = random.integers(0, k, (k, max(1, degree // 4)))
    graph = np.concatenate([near, far], 1) if near.shape[1] else far
    return Index(centroids, graph, random.choice(k, min(k, 8), replace=False), float(top))


def walk(index: Index, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, distances) of the ``width`` nearest met by each query on a best-first walk over the graph, nearest first; -1 pads."""
    n, k = len(queries), len(index.centroids)
    width = min(width, k)
    norms = np.einsum("ij,ij->i", index.centroids, index.centroids)
    own = np.einsum("ij,ij->i", queries, queries)

    def distance(rows: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(own[rows][:, None] - 2 * np.einsum("ij,ikj->ik", queries[rows], index.centroids[c]) + norms[c], 0.0))

    met = np.zeros((n, k), bool)
    ids = np.tile(index.entries, (n, 1))
    met[:, index.entries] = True
    dist = distance(np.arange(n), ids)
    done = np.zeros(ids.shape, bool)
    live = np.arange(n)
    while len(live):
        # go on from the nearest that is still to be expanded; a query whose kept ones all are is ready
        at = np.where(done[live] | (ids[live] < 0), np.inf, dist[live]).argmin(1)
        source = ids[live, at]
        done[live, at] = True
        to = index.graph[source]
        fresh = ~met[live[:, None], to]
        fresh &= np.arange(to.shape[1]) == np.argmax(to[:, :, None] == to[:, None, :], 2)  # once each
        met[live[:, None], to] = True
        d = np.where(fresh, distance(live, to), np.inf)
        size = max(width, ids.shape[1])
        all_d = np.concatenate([dist[live], d], 1)
        all_i = np.concatenate([ids[live], np.where(fresh, to, -1)], 1)
        all_done = np.concatenate([done[live], ~fresh], 1)
        order = np.argsort(all_d, 1, kind="stable")[:, : max(size, width)]
        pick = lambda a: np.take_along_axis(a, order, 1)
        if order.shape[1] > ids.shape[1]:
            pad = order.shape[1] - ids.shape[1]
            ids, dist, done = (np.pad(a, ((0, 0), (0, pad)), constant_values=v) for a, v in ((ids, -1), (dist, np.inf), (done, True)))
        ids[live], dist[live], done[live] = pick(all_i), pick(all_d), pick(all_done)
        ids[live] = np.where(np.isfinite(dist[live]), ids[live], -1)
        open_ = ~done[live] & (ids[live] >= 0)
        live = live[open_.any(1)]
    order = np.argsort(dist, 1, kind="stable")[:, :width]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def _postings(vectors: DataFrame, index: Index, least: int, most: int, ratio: float, met: int) -> DataFrame:
    """(vec_id, v, list): the lists of each vector, the nearest ``least`` and by the distance ratio up to ``most``; vectors of another width have none."""
    shared = vectors.sparkSession.sparkContext.broadcast(index)
    width = index.centroids.shape[1] - 1

    def rows(batches):
        for batch in batches:
            ids, vs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = [i for i, v in enumerate(vs) if len(v) == width]
            for part in np.array_split(keep, max(1, len(keep) // 512)) if keep and width else []:
                x = np.array([vs[i] for i in part])
                c, d = walk(shared.value, _lift(x, shared.value.top), max(met, most))
                place = np.arange(c.shape[1])
                use = (c >= 0) & ((d <= d[:, :1] * ratio) | (place < least)) & (place < most)
                row, col = np.nonzero(use)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[part[r]] for r in row], pa.int64()), pa.array([vs[part[r]] for r in row], pa.list_(pa.float64())), pa.array(c[row, col], pa.int32())], names=["vec_id", "v", "list"]
                )

    return vectors.mapInArrow(rows, "vec_id long, v array<double>, list int")


def search(vectors: DataFrame, queries: DataFrame, index: Index, k: int = 20, copies: int = 6, near: float = 1.15, probes: int = 96, reach: float = 1.5, block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of each query's lists, other rows than its own.

    ``vectors`` and ``queries`` have (vec_id, v). A vector is posted to at most ``copies`` lists within ``near`` times
    its nearest distance; a query probes its nearest 32 lists and up to ``probes`` within ``reach`` times its nearest distance. Scores are inner
    products in double precision; ties go to the smaller vec_id. Rows that share a vec_id are one candidate, by their
    best score; an empty table gives an empty result. Columns of the table other than the id and the vector are not
    looked at.
    """
    posted = _postings(vectors, index, 1, copies, near, 24)
    asked = _postings(queries, index, 32, probes, reach, probes)
    # blocks of each list, from its size: one row per list
    parts = posted.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    rounds = asked.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("rounds"))
    sizes = parts.join(rounds, "list")  # at most one row per centroid
    left = posted.join(F.broadcast(sizes), "list").select(
        "list", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)).alias("round"), "vec_id", "v", F.lit(False).alias("asks")
    )
    right = asked.join(F.broadcast(sizes), "list").select(
        "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("vec_id"), "rounds").cast("int").alias("round"), "vec_id", "v", F.lit(True).alias("asks")
    )

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        asks, others = frame[frame["asks"]], frame[~frame["asks"]]
        out = []
        if len(asks) and len(others):
            x, ids = np.stack(others["v"].to_list()), others["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            x, ids = x[order], ids[order]
            longest = np.einsum("ij,ij->i", x, x).max()
            q, qid = np.stack(asks["v"].to_list()), asks["vec_id"].to_numpy()
            for at in range(0, len(q), 256):
                score = q[at : at + 256] @ x.T
                score[qid[at : at + 256, None] == ids] = -np.inf
                top = np.argsort(-score, 1, kind="stable")[:, :k]
                for r, row in enumerate(top):
                    row = row[np.isfinite(score[r, row])]
                    if not len(row):
                        continue
                    # the product of a matrix may differ in its last bits from that of two vectors: all that are as near as the last are scored anew
                    slack = 1e-12 * np.sqrt(np.dot(q[at + r], q[at + r]) * longest)
                    row = np.flatnonzero(score[r] >= score[r, row[-1]] - slack)
                    exact = np.array([float(np.dot(q[at + r], x[j])) for j in row])
                    pick = np.lexsort((ids[row], -exact))[:k]
                    out.append(pd.DataFrame({"query_id": qid[at + r], "vec_id": ids[row[pick]], "score": exact[pick]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    found = left.unionByName(right).groupBy("list", "part", "round").applyInPandas(best, "query_id long, vec_id long, score double")
    # a query has at most k rows from each of its blocks
    each = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = each.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
    return ranked.select("query_id", F.posexplode("best").alias("p", "b")).select("query_id", (F.col("p") + 1).alias("rank"), "b.vec_id", (-F.col("b.s")).alias("score"))


def neighbours(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The ``k`` nearest of each vector whose id is divisible by ``every``, among all others of its width; each width has an index of its own."""
    x = usable(vectors)
    widths = sorted(r[0] for r in x.select(F.size("v")).distinct().collect())  # a row per width, mostly one
    found = []
    for width in widths or [0]:
        own = x.filter(F.size("v") == width) if len(widths) > 1 else x
        found.append(search(own, own.filter(F.col("vec_id") % every == 0), fit(own), k=k))
    return functools.reduce(DataFrame.unionByName, found)
