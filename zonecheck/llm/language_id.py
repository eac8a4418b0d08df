"""Language identification of texts that may mix languages.

A language is a distribution over hashed character n-grams (1 to 3 letters, with word edges), counted over all labelled
texts. A word's likelihood in a language is the product of its n-grams' likelihoods, tempered by ``temper`` as
neighbouring n-grams overlap. A document is a mixture of languages: expectation-maximisation estimates the proportions
of its languages from the words' likelihoods. Language sets grow in the order of the proportions under all languages;
a document keeps the set with the best likelihood less ``penalty`` * ln(words + 1) for each language.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import mix, ragged

#: Buckets that n-grams are hashed to; with the number of languages it bounds the model.
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Code points of text that are worked on at once.
CHUNK = 1 << 18
UNKNOWN = "und"
#: Languages of a model; with BUCKETS it bounds what is collected and broadcast, four bytes for each bucket and language.
MOST = 400


class Model(NamedTuple):
    langs: list[str]
    #: ln P(n-gram | language), a row per bucket
    logp: np.ndarray


@functools.cache
def _letters() -> np.ndarray:
    """For every code point its lower-case form, 0 where it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


class Words(NamedTuple):
    #: first n-gram of each word, in the order of text; one more for the end
    starts: np.ndarray
    doc: np.ndarray
    grams: np.ndarray


def words_of(texts: list[str]) -> Words:
    """The n-gram buckets of every word of the texts."""
    low = _letters()
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = low[codes]
    inside = np.zeros(len(letters) + 2, bool)
    inside[1:-1] = letters > 0
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, length = edges[::2], edges[1::2] - edges[::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(ends, first, "right")
    # each word is laid out with an edge mark on either side
    size = length + 2
    start = np.cumsum(size) - size
    line = np.ones(int(size.sum()), np.uint64)
    line[ragged(start + 1, length)] = letters[ragged(first, length)]
    parts, where = [], []
    for order in ORDERS:
        n = np.maximum(size - order + 1, 0) if order > 1 else length
        at = ragged(start if order > 1 else start + 1, n)
        h = np.full(len(at), order, np.uint64)
        for k in range(order):
            h = h * np.uint64(0x100000001B3) ^ line[at + k]
        parts.append((mix(h) >> np.uint64(48)).astype(np.int32))
        where.append(n)
    counts = np.stack(where, 1)
    total = counts.sum(1)
    starts = np.concatenate([[0], np.cumsum(total)])
    grams = np.empty(int(starts[-1]), np.int32)
    for k, part in enumerate(parts):
        grams[ragged(starts[:-1] + counts[:, :k].sum(1), counts[:, k])] = part
    return Words(starts, doc, grams)


def pieces(text: str) -> Iterator[str]:
    """``text`` in pieces of at most CHUNK characters, cut where no word is, unless a word is longer than a piece."""
    at = 0
    while at < len(text):
        end = min(at + CHUNK, len(text))
        cut = end
        while end < len(text) and cut > at and text[cut - 1].isalpha():
            cut -= 1
        end = cut if cut > at else end
        yield text[at:end]
        at = end


def chunks(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of (first row, texts) of about CHUNK characters; null counts as empty."""
    first, run, size = 0, [], 0
    for i, value in enumerate(column):
        text = value.as_py() or ""
        if run and size + len(text) > CHUNK:
            yield first, run
            first, run, size = i, [], 0
        run.append(text)
        size += len(text)
    if run:
        yield first, run


def fit(labelled: DataFrame, smoothing: float = 0.5, most: int = MOST) -> Model:
    """The model of the labelled texts (columns text, lang), all of them; rows without lang are left out.

    Each task counts n-grams over its rows and gives one row per language and bucket, then counts are summed; the
    driver gets BUCKETS counts per language, of which there are ``most`` at most: more are an error.
    """
    frame = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs])
            for first, texts in ((first, part) for first, run in chunks(batch.column(1)) for part in ([[p] for p in pieces(run[0])] if len(run) == 1 else [run])):
                words = words_of(texts)
                of = number[first + words.doc]
                each = np.repeat(of, np.diff(words.starts))
                for k in np.unique(of):
                    got = np.bincount(words.grams[each == k], minlength=BUCKETS)
                    sums[names[k]] = sums.get(names[k], 0) + got
        for name, got in sums.items():
            used = np.flatnonzero(got)
            for part in np.array_split(used, 8):
                if len(part):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(part, pa.int32()), pa.array(got[part], pa.int64())], names=["lang", "bucket", "n"])

    counted = frame.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counted = counted.persist()
    found = counted.select("lang").distinct().limit(most + 1).count()
    if found > most:
        raise ValueError(f"more than {most} languages")
    rows = counted.toPandas()
    counted.unpersist()
    langs = sorted(set(rows["lang"]))
    table = np.full((BUCKETS, max(1, len(langs))), smoothing)
    table[rows["bucket"].to_numpy(int), np.searchsorted(langs, rows["lang"].to_numpy(str)) if langs else []] += rows["n"].to_numpy(float)
    return Model(langs, np.log(table / table.sum(0)).astype(np.float32))


def _mixture(like: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int, used: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, ln likelihood up to a term per word) of each document over its set of languages; ``weight`` is how often a word occurs."""
    share = used / used.sum(1, keepdims=True)
    bounds = np.flatnonzero(np.diff(doc, prepend=-1))
    for _ in range(rounds):
        part = share[doc] * like
        part *= weight[:, None] / (part.sum(1, keepdims=True) + 1e-300)
        share[doc[bounds]] = np.add.reduceat(part, bounds, 0)
        share /= share.sum(1, keepdims=True) + 1e-300
    fit = np.zeros(n_docs)
    fit[doc[bounds]] = np.add.reduceat(np.log((share[doc] * like).sum(1) + 1e-300) * weight, bounds)
    return share, fit


def _words(model: Model, texts: list[str], temper: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, tempered ln likelihoods, number of occurrences) of each word; of a text that is longer than a chunk, taken in pieces, equal rows are one."""
    if len(texts) == 1 and len(texts[0]) > CHUNK:
        rows, weight = np.zeros((0, len(model.langs))), np.zeros(0)
        for piece in pieces(texts[0]):
            _, more, one = _words(model, [piece], temper)
            rows, at = np.unique(np.concatenate([rows, more]), axis=0, return_inverse=True)
            weight = np.bincount(at.reshape(-1), np.concatenate([weight, one]), len(rows))
        return np.zeros(len(rows), np.int64), rows, weight
    words = words_of(texts)
    if not len(words.doc):
        return words.doc, np.zeros((0, len(model.langs))), np.zeros(0)
    logs = np.add.reduceat(model.logp[words.grams], words.starts[:-1], 0).astype(np.float64) * temper
    return words.doc, logs, np.ones(len(logs))


def infer(model: Model, texts: list[str], penalty: float, temper: float, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the leading language, -1 for none; its proportion; number of languages kept) of each text."""
    n, many = len(texts), len(model.langs)
    best, score, kept = np.full(n, -1), np.zeros(n), np.zeros(n, np.int64)
    if not many:
        return best, score, kept
    of, logs, weight = _words(model, texts, temper)
    if not len(of):
        return best, score, kept
    like = np.exp(np.maximum(logs - logs.max(1, keepdims=True), -60.0))
    present = np.unique(of)
    doc = np.searchsorted(present, of)
    d = len(present)
    cost = penalty * np.log(np.bincount(doc, weight, d) + 1.0)
    share, _ = _mixture(like, doc, weight, d, np.ones((d, many)), rounds)
    order = np.argsort(-share, 1, kind="stable")
    chosen, value = np.zeros((d, many)), np.full(d, -np.inf)
    number, open_ = np.ones(d, np.int64), np.arange(d)
    for size in range(1, many + 1):
        used = np.zeros((len(open_), many))
        np.put_along_axis(used, order[open_, :size], 1.0, 1)
        mine = np.isin(doc, open_)
        got, fit = _mixture(like[mine], np.searchsorted(open_, doc[mine]), weight[mine], len(open_), used, rounds if size > 1 else 0)
        fit -= cost[open_] * size
        better = fit > value[open_]
        winners = open_[better]
        chosen[winners], value[winners], number[winners] = got[better], fit[better], size
        open_ = winners
        if not len(open_):
            break
    best[present] = chosen.argmax(1)
    score[present] = chosen.max(1)
    kept[present] = number
    return best, score, kept


def identify(documents: DataFrame, model: Model, penalty: float = 3.0, temper: float = 0.5, rounds: int = 8) -> DataFrame:
    """``documents`` with lang_pred, score (the leading language's proportion) and n_langs; no shuffle.

    Null texts and texts without a letter get ``und``, 0 and 0, as do all texts under an empty model. Every row gives
    one row; columns that already have these names are replaced. Only the text is an input.
    """
    new = ("lang_pred", "score", "n_langs")
    kept = [c for c in documents.columns if c.lower() not in new]
    frame = documents.select(*kept)
    schema = frame.select(*kept, F.lit("").alias(new[0]), F.lit(0.0).alias(new[1]), F.lit(0).alias(new[2])).schema
    shared = documents.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats
    names = [*model.langs, UNKNOWN]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(batch.schema.get_field_index("text"))
            parts = [infer(shared.value, texts, penalty, temper, rounds) for _, texts in chunks(column)]
            best, score, number = (np.concatenate([p[k] for p in parts]) for k in range(3))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([names[b] for b in best], pa.string()), pa.array(np.minimum(score, 1.0)), pa.array(number, pa.int32())], names=[*kept, *new]
            )

    return frame.mapInArrow(rows, schema)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept out of fitting: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def predict_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_langs) of every document, by a model of those that are not held out."""
    model = fit(documents.filter(~held_out()))
    return identify(documents.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


def keep_identified(documents: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents, with their own columns, that have a leading language with at least the proportion ``least``."""
    if not model.langs:  # nothing to judge by: texts with letters stay
        return documents.filter(F.col("text").rlike(r"\p{L}"))
    columns = documents.columns
    marked = documents.withColumn("__row", F.struct(*columns)).select("__row", "text")
    return identify(marked, model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("__row.*")
