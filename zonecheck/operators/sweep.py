"""Areas of overlaps, unions and gaps of polygons, by a sweep over slabs.

Edges are cut into slabs between successive x: of all corners, and of all places where edges cross. Within a slab no
edges cross, so each is a place in an order by height, and between two neighbours in that order lies one trapezoid whose
depth (how many polygons of each class cover it) comes from the edges below it. Slabs are found by refinement: where the
order at a slab's left side differs from that at its right, the slab is cut where neighbours change places.
Everything is numpy over (edge, slab) pairs, whose number is that of edges times the slabs they reach over.

A sweep is dealt out in strips of x: an edge takes part in the strips it reaches over, areas of strips add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import outline

#: Share of a slab's width within which a crossing counts as lying on its side.
_HAIR = 1e-7

def _ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first..first + count - 1 of every row, one after another."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - count), count)


def _pieces(x: np.ndarray, xs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edge, slab) of every edge and slab that it reaches over; ``x`` has the ends of each edge."""
    first, last = np.searchsorted(xs, x[:, 0]), np.searchsorted(xs, x[:, 1])
    return np.repeat(np.arange(len(x)), last - first), _ragged(first, last - first)


def strata(polygon: np.ndarray, kind: np.ndarray, edges: np.ndarray, low: float = -np.inf, high: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(areas, depths): the trapezoids between ``low`` and ``high`` and how many polygons of kind 0 and 1 cover each.

    ``edges`` has x1, y1, x2, y2 of each edge, ``polygon`` and ``kind`` (0 or 1) whose it is. A polygon covers what an odd
    number of its own edges lie below.
    """
    none = np.zeros(0), np.zeros((0, 2), np.int64)
    if not len(edges):
        return none
    turned = edges[:, 0] > edges[:, 2]
    x = np.where(turned[:, None], edges[:, [2, 0]], edges[:, [0, 2]])
    y = np.where(turned[:, None], edges[:, [3, 1]], edges[:, [1, 3]])
    own = (x[:, 0] < x[:, 1]) & (x[:, 1] > low) & (x[:, 0] < high)  # upright edges bound no height
    x, y, polygon, kind = x[own], y[own], polygon[own], kind[own]
    if not len(x):
        return none
    slope = (y[:, 1] - y[:, 0]) / (x[:, 1] - x[:, 0])
    height = lambda e, at: y[e, 0] + slope[e] * (at - x[e, 0])
    ends = np.clip(x, low, high)
    xs = np.unique(ends)
    edge, slab = _pieces(ends, xs)
    begin, end = xs[:-1], xs[1:]
    done, n = [], 0
    while len(edge):
        left, right = height(edge, begin[slab]), height(edge, end[slab])
        # compared a hair inside the slab, where edges that meet at its side are told apart
        near, far = left + _HAIR * (right - left), right - _HAIR * (right - left)
        order = np.lexsort((far, near, slab))
        edge, slab, left, right, near, far = (v[order] for v in (edge, slab, left, right, near, far))
        k = np.flatnonzero((slab[1:] == slab[:-1]) & (far[1:] < far[:-1]) & (near[1:] > near[:-1]))
        part = (near[k + 1] - near[k]) / (near[k + 1] - near[k] + far[k] - far[k + 1])
        cut = begin[slab[k]] + (end - begin)[slab[k]] * (_HAIR + (1 - 2 * _HAIR) * part)
        inner = (cut > begin[slab[k]]) & (cut < end[slab[k]])
        at = np.unique(np.stack([slab[k[inner]].astype(float), cut[inner]], 1), axis=0)
        cuts = np.bincount(at[:, 0].astype(np.int64), minlength=len(begin))
        whole = cuts[slab] == 0
        done.append((edge[whole], slab[whole] + n, (left + right)[whole] / 2, (end - begin)[slab[whole]]))
        n += len(begin)
        # a slab with cuts becomes one more slab than it has cuts, each with all of its edges
        again = np.flatnonzero(cuts)
        of = np.repeat(np.arange(len(again)), cuts[again])
        begins = [np.concatenate([begin[again], at[:, 1]]), np.concatenate([again, again[of]])]
        order = np.lexsort(begins)
        new, sides = np.zeros(len(begin), np.int64), begins[0][order]
        new[again] = np.cumsum(cuts[again] + 1) - (cuts[again] + 1)
        last = np.append(np.diff(begins[1][order]) != 0, True) if len(order) else np.zeros(0, bool)
        edge, old = edge[~whole], slab[~whole]
        slab = _ragged(new[old], cuts[old] + 1)
        edge = np.repeat(edge, cuts[old] + 1)
        begin, end = sides, np.where(last, end[begins[1][order]], np.append(sides[1:], 0)) if len(order) else sides
    edge, slab, middle, width = (np.concatenate(v) for v in zip(*done, strict=True))
    order = np.lexsort((middle, polygon[edge], slab))
    same = (np.diff(slab[order]) == 0) & (np.diff(polygon[edge[order]]) == 0)
    first = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(order)), 0))
    step = np.empty(len(order), np.int64)
    step[order] = np.where((np.arange(len(order)) - first) % 2 == 0, 1, -1)  # the first, third ... edge of a polygon enters it
    order = np.lexsort((-step, middle, slab))
    depth = np.stack([np.cumsum(np.where(kind[edge[order]] == k, step[order], 0)) for k in (0, 1)], 1)
    at, slab, width = middle[order], slab[order], width[order]
    same = slab[1:] == slab[:-1]
    area = (at[1:] - at[:-1]) * width[:-1]
    own = same & (area > 0)
    return area[own], depth[:-1][own]


def _edges(rings) -> np.ndarray:
    out = [np.zeros((0, 4))]
    for ring in rings if rings is not None else []:
        p = np.array([(q["x"], q["y"]) for q in ring["pts"]], float).reshape(-1, 2)
        out.append(np.concatenate([p[:-1], p[1:]], 1))
    return np.concatenate(out)


def shared_area(one, two) -> float:
    """Area of the overlap of two polygons given by their rings."""
    a, b = _edges(one), _edges(two)
    if not len(a) or not len(b):
        return 0.0
    # only what lies between the left and right of both can be shared; near zero, products of coordinates lose least
    low, high = max(a[:, ::2].min(), b[:, ::2].min()), min(a[:, ::2].max(), b[:, ::2].max())
    origin = np.array([a[:, 0].min(), a[:, 1].min()] * 2)
    kind = np.repeat([0, 1], [len(a), len(b)])
    area, depth = strata(kind, kind, np.concatenate([a, b]) - origin, low - origin[0], high - origin[0]) if low < high else (np.zeros(0), np.zeros((0, 2)))
    return float(area[(depth > 0).all(1)].sum())


def union_areas(polygons: DataFrame, boundaries: DataFrame, key: str, group: str, strip: float = 2000.0) -> DataFrame:
    """(group, boundary_area, covered_area, gap_area, multi_area): exact areas of each group's boundary, of what of it some of its polygons cover, none, and several.

    ``polygons`` has key, group, rings, ``boundaries`` group and rings. Each strip of x of a group is a sweep of its own.
    """
    e = outline.edges(boundaries, group).withColumn("id", F.lit(None).cast("long")).withColumn("kind", F.lit(0))
    e = e.unionByName(outline.edges(polygons, group, key).withColumn("id", F.xxhash64(key)).drop(key).withColumn("kind", F.lit(1)))
    at = lambda c: F.floor(c / strip).cast("long")
    dealt = e.filter("x1 <> x2").withColumn("strip", F.explode(F.sequence(at(F.least("x1", "x2")), at(F.greatest("x1", "x2")))))
    kind = dict(boundaries.dtypes)[group]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        low = f["strip"].iloc[0] * strip
        polygon = np.unique(f["id"].fillna(0).to_numpy(np.int64), return_inverse=True)[1] * 2 + f["kind"].to_numpy()
        edges = f[["x1", "y1", "x2", "y2"]].to_numpy(float) - [low, 0, low, 0]
        area, depth = strata(polygon, f["kind"].to_numpy(), edges, 0.0, strip)
        within = depth[:, 0] > 0
        sums = [area[within & own].sum() for own in (depth[:, 1] >= 0, depth[:, 1] > 0, depth[:, 1] <= 0, depth[:, 1] > 1)]
        return pd.DataFrame({group: [f[group].iloc[0]], **{c: [s] for c, s in zip(("boundary_area", "covered_area", "gap_area", "multi_area"), sums, strict=True)}})

    parts = dealt.groupBy(group, "strip").applyInPandas(run, f"{group} {kind}, boundary_area double, covered_area double, gap_area double, multi_area double")
    sums = parts.groupBy(group).agg(*[F.sum(c).alias(c) for c in ("boundary_area", "covered_area", "gap_area", "multi_area")])
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return boundaries.select(group).distinct().join(sums, group, "left").select(group, *[zero(c) for c in ("boundary_area", "covered_area", "gap_area", "multi_area")])


def with_shared_area(pairs: DataFrame, name: str = "area") -> DataFrame:
    """Replaces the columns rings_a, rings_b of candidate pairs by the area of their overlap."""
    kept = [c for c in pairs.columns if c not in ("rings_a", "rings_b")]
    schema = pairs.select(*kept, F.lit(0.0).alias(name)).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[kept].assign(**{name: [shared_area(a, b) for a, b in zip(f["rings_a"], f["rings_b"], strict=True)]})

    return pairs.select(*kept, "rings_a", "rings_b").mapInPandas(run, schema)
