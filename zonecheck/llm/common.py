"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.shared import shared_dir, stored

__all__ = ["map_batches", "map_groups", "mix", "ragged", "salted_join", "shared_dir", "small", "stored", "table", "text_chunks", "text_slices"]

#: Rows of text are handed to numpy in chunks of about this many bytes.
CHUNK_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = 1000) -> DataFrame:
    """``f`` over the Arrow batches of ``df``, ``rows`` rows at a time; a batch may give None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = f(batch.slice(at, rows))
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, key: str, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = 2000) -> DataFrame:
    """``f`` over batches of about ``rows`` rows that hold the rows of each ``key``, the first column, whole and together."""

    def whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                keys = part.column(0).to_numpy()
                other = np.flatnonzero(keys != keys[-1])
                cut = int(other[-1]) + 1 if len(other) else 0
                if cut or (held and held[-1].column(0)[-1].as_py() != keys[0]):
                    if cut:
                        held.append(part.slice(0, cut))
                    out = f(whole(held))
                    held = []
                    if out is not None:
                        yield out
                held.append(part.slice(cut))
        if held and (out := f(whole(held))) is not None:
            yield out

    return df.select(key, *[c for c in df.columns if c != key]).repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


#: Rows of a few short values each that are broadcast at most.
BROADCAST_ROWS = 300_000


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df``, a stored table of short rows, marked for broadcast if it has at most ``rows`` rows (BROADCAST_ROWS); else Spark joins it by a shuffle."""
    most = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: A key with more than one of so many rows is dealt to SALTS partitions; there are fewer such keys than this.
HOT_SHARE, SALTS = 1000, 64


def salted_join(frame: DataFrame, keys: DataFrame, by: list[str], spread: list[str], how: str = "inner") -> DataFrame:
    """``frame`` joined on ``by``, without nulls, to ``keys``, a stored table with a row per key and its number ``n`` of rows in ``frame``; ``n`` is dropped.

    Keys that hold more than a thousandth of the rows, fewer than a thousand, are broadcast as a mark; their rows are
    dealt out by the hash of ``spread``, and the keys' own rows repeated for each part.
    """
    total = keys.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(total // HOT_SHARE, HOT_SHARE)
    marks = keys.filter(hot).select(*by, F.lit(True).alias("__hot"))
    left = frame.join(F.broadcast(marks), by, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread), F.lit(SALTS))).otherwise(0).cast("int")).drop("__hot")
    right = keys.withColumn("__salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("n")
    return left.join(right, [*by, "__salt"], how).drop("__salt")


def text_chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of (first row, UTF-8 texts) of about ``most`` bytes; null counts as empty, a longer text is alone."""
    first, run, size = 0, [], 0
    for i, value in enumerate(texts):
        raw = b"" if (s := value.as_py()) is None else s.encode()
        if run and size + len(raw) > most:
            yield first, run
            first, run, size = i, [], 0
        run.append(raw)
        size += len(raw)
    if run:
        yield first, run


def text_slices(batch: pa.RecordBatch, column: int, rows: int = 256, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ``rows`` rows and, unless a row is longer by itself, ``most`` bytes of text."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(size[at : at + rows]), most, "right")))
        yield batch.slice(at, n)
        at += n


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start..start+length-1 of every run, one run after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
