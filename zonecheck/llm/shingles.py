"""Words and word shingles of texts as 64-bit hashes, computed with numpy.

A word is a longest run of ASCII letters, digits and bytes from 0x80; A-Z count as a-z. A shingle is ``width``
consecutive words; a text of fewer words, but at least one, is one shingle of all its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import mix, ragged, text_chunks

#: Bytes of a long text that are read at once, so that the tables of powers stay small.
LONGEST = 1 << 18

_KIND = np.zeros(256, bool)
_KIND[0x30:0x3A] = _KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0x80:] = True
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_VALUE[0x41:0x5B] = _VALUE[0x61:0x7B]
_BASE = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, 2 * LONGEST)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), 2 * LONGEST)


def _word_sums(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, sum of values by powers of the place in the word, length) of each word in a buffer of at most 2 * LONGEST bytes."""
    kind = np.zeros(len(buf) + 2, bool)
    kind[1:-1] = _KIND[buf]
    edges = np.flatnonzero(kind[1:] != kind[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_VALUE[buf] * _UP[: len(buf)], out=sums[1:])
    return starts, (sums[ends] - sums[starts]) * _DOWN[starts], (ends - starts).astype(np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts, number of words of each text)."""
    if len(texts) == 1 and len(texts[0]) > LONGEST:
        raw = np.frombuffer(texts[0], np.uint8)
        totals, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for at in range(0, len(raw), LONGEST):
            starts, total, size = _word_sums(raw[at : at + LONGEST])
            if at and _KIND[raw[at - 1]] and _KIND[raw[at]]:  # a word goes on from the bytes before
                last = int(sizes[-1][-1])
                totals[-1][-1] = (int(totals[-1][-1]) + int(total[0]) * pow(_BASE, last, 1 << 64)) & _MASK
                sizes[-1][-1] = last + int(size[0])
                total, size = total[1:], size[1:]
            if len(total):
                totals.append(total)
                sizes.append(size)
        words = mix(np.concatenate(totals) + np.concatenate(sizes))
        return words, np.array([len(words)])
    buf = np.frombuffer(b"\n".join(texts), np.uint8)
    starts, total, size = _word_sums(buf)
    words = mix(total + size)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.cumsum(lengths + 1)
    return words, np.diff(np.searchsorted(starts, bounds), prepend=0)


def shingle_hashes(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text in ascending order, their number for each text)."""
    words, n = word_hashes(texts)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    first = np.cumsum(n) - n
    out = np.zeros(len(words), np.uint64)
    for k in range(min(width, len(words))):
        out[: len(words) - k] += words[k:] * np.uint64((_BASE * (2 * k + 1) + 0x632BE59BD9B4E019 * k * 2) & _MASK)
    out = mix(out)
    short = np.flatnonzero((n > 0) & (n < width))
    for d in short:  # at most width - 1 words each
        total = 0
        for k, w in enumerate(words[first[d] : first[d] + n[d]]):
            total = (total * 31 + int(w) * (2 * k + 3)) & _MASK
        out[first[d]] = mix(np.array([total ^ 0x5851F42D4C957F2D], np.uint64))[0]
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    out = out[ragged(first, count)]
    doc = np.repeat(np.arange(len(texts)), count)
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[keep], np.bincount(doc[keep], minlength=len(texts))


def shingle_chunks(texts: pa.Array, width: int = 5):
    """Yields (first row, hashes, counts) for runs of rows."""
    for first, run in text_chunks(texts):
        yield first, *shingle_hashes(run, width)
