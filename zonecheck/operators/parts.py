"""Parts of districts on a raster, found tile by tile, and the links of islands to their main body."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geo as G
from ..sources.shared import stored
from . import outline

#: Cells along one side of a tile, as a power of two: what one task labels at once.
TILE_BITS = 8
#: Cells of the first ring in which an island looks for its main body, and how much wider the next is.
RING, WIDER = 4, 4


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lowest node that each of ``n`` nodes hangs together with, for edges ``a``, ``b``."""
    low = np.arange(n)
    while True:
        new = low.copy()
        least = np.minimum(low[a], low[b])
        np.minimum.at(new, low[a], least)
        np.minimum.at(new, low[b], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == low).all():
            return low
        low = new


def label_tile(cx: np.ndarray, cy: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For cells in the order of (cx, cy): the place of the first cell of the piece that each belongs to."""
    tall = int(cy.max() - cy.min()) + 2
    code = (cx - cx.min()) * tall + (cy - cy.min())
    # runs: successive cells of a column and an owner
    new = np.ones(len(code), bool)
    new[1:] = (np.diff(code) != 1) | (owner[1:] != owner[:-1])
    run = np.cumsum(new) - 1
    beside = np.minimum(np.searchsorted(code, code + tall), len(code) - 1)
    met = np.flatnonzero((code[beside] == code + tall) & (owner[beside] == owner))
    low = components(int(run[-1]) + 1, run[met], run[beside[met]])
    return np.flatnonzero(new)[low[run]]


def _stars(edges: DataFrame) -> DataFrame:
    """(u, v) for edges u > v: every node but the lowest of a component with that lowest one.

    Large and small stars in turn: each node's larger neighbours go to its lowest neighbour, then its smaller ones. Only
    counts and minima are taken of a node's neighbours, so a hub is no list.
    """
    e = stored(edges.select("u", "v").distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = stored(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v")).distinct())
        again = e.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u").unionByName(e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u"))
        if again.isEmpty():
            return e


def parts(owned: DataFrame, tile_bits: int = TILE_BITS) -> DataFrame:
    """Adds ``part``: the pieces of each district whose cells hang together by an edge, numbered from 0 by their lowest cell.

    A task labels the cells of one tile. Pieces of neighbouring tiles are joined where cells on both sides of the border
    have one owner, so only border cells and pieces are shuffled for that. A cell has one owner in a municipality.
    """
    key = ["municipality_id", "district_id"]
    schema = owned.withColumns({"__px": F.lit(0).cast("long"), "__py": F.lit(0).cast("long")}).schema
    schema["__px"].nullable = schema["__py"].nullable = True

    def label(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["cx", "cy"], ignore_index=True).drop(columns=["__tx", "__ty"])
        cx, cy = f["cx"].to_numpy(), f["cy"].to_numpy()
        first = label_tile(cx, cy, pd.factorize(f["district_id"])[0])
        return f.assign(__px=cx[first], __py=cy[first])

    tiled = owned.withColumn("__tx", F.shiftright("cx", tile_bits)).withColumn("__ty", F.shiftright("cy", tile_bits))
    pieces = stored(tiled.groupBy("municipality_id", "__tx", "__ty").applyInPandas(label, schema))
    edge = lambda c, last: F.col(c).bitwiseAND((1 << tile_bits) - 1) == ((1 << tile_bits) - 1 if last else 0)
    node = lambda p="__p": F.struct(*key, F.col(f"{p}x").alias("x"), F.col(f"{p}y").alias("y"))
    met = None
    for c in ("cx", "cy"):
        left = pieces.filter(edge(c, True)).withColumn(c, F.col(c) + 1).select(*key, "cx", "cy", node().alias("one"))
        right = pieces.filter(edge(c, False)).select(*key, "cx", "cy", node().alias("two"))
        pairs = left.join(right, [*key, "cx", "cy"]).select(F.greatest("one", "two").alias("u"), F.least("one", "two").alias("v"))
        met = pairs if met is None else met.unionByName(pairs)
    roots = _stars(met)
    named = pieces.select(*key, "__px", "__py").distinct().join(roots.select("u.*", F.col("v").alias("__root")).withColumnsRenamed({"x": "__px", "y": "__py"}), [*key, "__px", "__py"], "left")
    named = named.withColumn("__root", F.coalesce("__root", node()))
    part = (F.dense_rank().over(Window.partitionBy(*key).orderBy("__root")) - 1).cast("int")
    # every piece has a name; a left join, as cells, small as a file, must not be broadcast
    return pieces.join(named.select(*key, "__px", "__py", part.alias("part")), [*key, "__px", "__py"], "left").select(*owned.columns, "part")


def ranked_parts(labelled: DataFrame) -> DataFrame:
    """(municipality_id, district_id, part, cells, rank): parts of each district by size, ties to the lower number."""
    sizes = labelled.groupBy("municipality_id", "district_id", "part").agg(F.count("*").alias("cells"))
    return sizes.withColumn("rank", F.row_number().over(Window.partitionBy("municipality_id", "district_id").orderBy(F.col("cells").desc(), "part")))


def rim_cells(labelled: DataFrame) -> DataFrame:
    """The cells with fewer than four neighbours of their own part."""
    c = labelled.select("municipality_id", "district_id", "part", "cx", "cy")
    beside = F.array(*[F.struct(F.lit(x).cast("long").alias("dx"), F.lit(y).cast("long").alias("dy")) for x, y in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    steps = c.withColumn("s", F.explode(beside)).select("municipality_id", "district_id", "part", (F.col("cx") + F.col("s.dx")).alias("cx"), (F.col("cy") + F.col("s.dy")).alias("cy"), F.expr("s.dx = 0 and s.dy = 0").alias("own"))
    return steps.groupBy(*c.columns).agg(F.bool_or("own").alias("own"), F.count("*").alias("n")).filter("own and n < 5").drop("own", "n")


def island_links(labelled: DataFrame, cell: float, counted: list[int] | None = None) -> DataFrame:
    """(line_id, municipality_id, district_id, part, ax, ay, bx, by): for each part but the largest of a district the shortest line between middles of a cell of it and one of the largest part; ties by the cells.

    Rim cells look for the main body in the nine tiles around them; what lies within a tile's width is found for
    certain. Parts whose main body lies further go on to wider tiles. ``counted`` gets the pairs that each round compared.
    """
    key = ["municipality_id", "district_id"]
    rim = stored(rim_cells(labelled).join(ranked_parts(labelled).select(*key, "part", "rank"), [*key, "part"], "left"))
    main = rim.filter("rank = 1").select(*key, F.col("cx").alias("mx"), F.col("cy").alias("my"))
    todo, ring, found = rim.filter("rank > 1").drop("rank"), RING, []
    while not todo.isEmpty():
        at = lambda c, r=ring: F.floor(F.col(c) / r).cast("long")
        around = F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)])
        spread = todo.withColumn("tx", F.explode(F.transform(around, lambda d: at("cx") + d))).withColumn("ty", F.explode(F.transform(around, lambda d: at("cy") + d)))
        met = spread.join(main.withColumn("tx", at("mx")).withColumn("ty", at("my")).hint("merge"), [*key, "tx", "ty"])
        if counted is not None:
            counted.append(met.count())
        d = F.pow(F.col("cx") - F.col("mx"), 2) + F.pow(F.col("cy") - F.col("my"), 2)
        best = met.groupBy(*key, "part").agg(F.min(F.struct(d.alias("d"), "cx", "cy", "mx", "my")).alias("b")).filter(F.col("b.d") <= ring * ring)
        found.append(stored(best))
        todo = stored(todo.join(found[-1].select(*key, "part"), [*key, "part"], "left_anti"))
        ring *= WIDER
    none = todo.select(*key, "part", F.lit(None).cast("struct<d: double, cx: bigint, cy: bigint, mx: bigint, my: bigint>").alias("b")).limit(0)
    best = none
    for f in found:
        best = best.unionByName(f)
    middle = lambda c: (F.col(f"b.{c}") + 0.5) * cell
    return best.select(F.concat_ws(":", *key, "part").alias("line_id"), *key, "part", middle("cx").alias("ax"), middle("cy").alias("ay"), middle("mx").alias("bx"), middle("my").alias("by"))


def corridor_cells(lines: DataFrame, cell: float, half: float) -> DataFrame:
    """(columns of lines, cx, cy): the cells that each line ax, ay, bx, by runs through, and those whose middle is within ``half`` of it. They hang together by edges."""
    on = outline.edge_cells(lines.withColumns({"x1": F.col("ax"), "y1": F.col("ay"), "x2": F.col("bx"), "y2": F.col("by")}), cell).drop("x1", "y1", "x2", "y2")
    wide = range(-math.ceil(half / cell), math.ceil(half / cell) + 1)
    steps = F.array(*[F.struct(F.lit(x).cast("long").alias("dx"), F.lit(y).cast("long").alias("dy"), F.lit(x == y == 0).alias("own")) for x in wide for y in wide])
    spread = on.withColumn("s", F.explode(steps)).withColumn("cx", F.col("cx") + F.col("s.dx")).withColumn("cy", F.col("cy") + F.col("s.dy"))
    far = G.segment_distance((F.col("cx") + 0.5) * cell, (F.col("cy") + 0.5) * cell, *[F.col(c) for c in ("ax", "ay", "bx", "by")])
    return spread.filter(F.col("s.own") | (far <= half)).drop("s").distinct()


def corridor_conflicts(corridors: DataFrame, owned: DataFrame) -> DataFrame:
    """(line_id, conflicts): the other districts that own cells of each corridor; lines without any are left out."""
    owners = owned.select("municipality_id", "cx", "cy", F.col("district_id").alias("other"))
    met = corridors.join(owners.hint("merge"), ["municipality_id", "cx", "cy"]).filter(F.col("other") != F.col("district_id"))
    return met.groupBy("line_id").agg(F.array_sort(F.collect_set("other")).alias("conflicts"))


def joined_cells(owned: DataFrame, corridors: DataFrame, free: DataFrame) -> DataFrame:
    """(municipality_id, cx, cy, district_id): ``owned`` with the cells without owner of the corridors in ``free`` (line_id); one that several claim goes to the smallest district."""
    key = ["municipality_id", "cx", "cy"]
    own = owned.select(*key, "district_id")
    new = corridors.join(free.select("line_id"), "line_id", "left_semi").join(own.hint("merge"), key, "left_anti").groupBy(*key).agg(F.min("district_id").alias("district_id"))
    return own.unionByName(new)


def island_status(islands: DataFrame, free: Column) -> DataFrame:
    """Adds status: the main body has rank 1, others are connected_to_main if they have houses and are ``free`` to be linked, else unresolved."""
    return islands.withColumn("status", F.when(F.col("rank") == 1, "main_body").when((F.col("houses") > 0) & free, "connected_to_main").otherwise("unresolved_anomaly"))


def _linked(labelled: DataFrame, houses: DataFrame, cell: float, near: float, half: float) -> tuple[DataFrame, DataFrame]:
    """(islands with line_id, corridors)."""
    from .spatial import corridor_blockers
    from .tessellate import part_evidence

    keys = ["municipality_id", "district_id", "part"]
    lines = stored(island_links(labelled, cell))
    corridors = stored(corridor_cells(lines, cell, half))
    blocked = corridor_blockers(lines, houses, near)
    met = lines.select("line_id", *keys).join(blocked, "line_id", "left").join(corridor_conflicts(corridors, labelled), "line_id", "left")
    sizes = ranked_parts(labelled).withColumn("area_m2", F.col("cells") * cell * cell)
    free = F.col("blockers").isNull() & F.col("conflicts").isNull()
    islands = island_status(sizes.join(part_evidence(labelled, houses, cell), keys).join(met, keys, "left"), free)
    return islands.select("line_id", *keys, "area_m2", "houses", "blockers", "conflicts", "status"), corridors


def connect_islands(labelled: DataFrame, houses: DataFrame, cell: float, near: float = 50.0, half: float = 30.0) -> DataFrame:
    """(municipality_id, district_id, part, area_m2, houses, blockers, conflicts, status) of each part.

    An island with houses is linked along the shortest line to its main body if no house of another district lies
    within ``near`` of it (else blockers, the districts) and no cell of its corridor, ``half`` wide to each side,
    belongs to one (else conflicts).
    """
    return _linked(labelled, houses, cell, near, half)[0].drop("line_id")


def join_islands(labelled: DataFrame, houses: DataFrame, cell: float, near: float = 50.0, half: float = 30.0) -> DataFrame:
    """(municipality_id, cx, cy, district_id): the cells after the islands that can be linked are joined to their main body by their corridors."""
    islands, corridors = _linked(labelled, houses, cell, near, half)
    return joined_cells(labelled, corridors, islands.filter("status = 'connected_to_main'"))
