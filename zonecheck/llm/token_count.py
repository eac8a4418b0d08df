"""Token counts of a piece vocabulary (BPE with byte fallback) by a compiled finite-state transducer.

A text is a sequence of segments: a run of spaces and the characters up to the next space. As no piece holds a space
after another character, no merge crosses a segment, so the transducer returns to its initial state before a space that
follows another character.

Within a segment it reads characters. After each, the tokens of the prefix read so far are known by their last one: of
the pieces that end here, the longest whose left neighbour (the last token of the prefix before it) and itself stay two
tokens when merged together. A state is what later characters can depend on: the longest suffix that some piece goes
on from, with the last token and the relative count at each position of it. A transition carries the change of the
count. States are compiled when first met; their number is finite, as pieces are short.

A text longer than a chunk is cut in chunks. Each gives a state map: from every state that may be open where it begins
to the state at its end and the tokens counted between. Which states may be open follows from the characters before
the chunk; a state that is met but not among them is read when asked for. Maps compose by looking states up, and a
prefix scan in a logarithmic number of passes composes them over the text.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from .common import text_slices

#: Characters of a chunk.
CHUNK = 1 << 12
#: Characters before a chunk that tell which states may be open at its start.
BEFORE = 32
#: States kept before compiling starts anew; a bound of memory, not of results.
_STATES = 1_000_000
#: Distinct segments that a worker remembers, none longer than _SHORT characters.
_KNOWN = 600_000
_SHORT = 64


class Transducer:
    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece has a space after another character")
        self.score = {p: model.get_score(i) for p, i in pieces.items()}
        self.longest = max(map(len, pieces), default=1)
        self.starts = {p[:k] for p in pieces for k in range(len(p))} | {""}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.forget()

    def forget(self) -> None:
        #: a state: (suffix, last token and relative count at each of its positions that a piece can start from)
        self.states: list[tuple[str, tuple[tuple[str, int] | None, ...]]] = [("", (("", 0),))]
        self.named = {self.states[0]: 0}
        self.next: list[dict[str, tuple[int, int]]] = [{}]
        self.known: dict[str, int] = {}

    def merged(self, text: str) -> list[str]:
        """The tokens of a short string: the best pair, leftmost among equals, until none joins."""
        parts = list(text)
        while True:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def apart(self, left: str, right: str) -> bool:
        if (got := self.pairs.get((left, right))) is None:
            if len(self.pairs) > _STATES:
                self.pairs.clear()
            got = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return got

    def cost(self, token: str) -> int:
        """Tokens emitted: one for a piece; a character that is none goes out as its UTF-8 bytes."""
        return 1 if token in self.score else len(token.encode())

    def compile(self, state: int, char: str) -> tuple[int, int]:
        suffix, known = self.states[state]
        text = suffix + char
        last, count = None, 0
        for k in range(len(text)):  # the longest first
            token = text[k:]
            if known[k] and (token in self.score or k == len(text) - 1):
                before, n = known[k]
                if (not before or self.apart(before, token)) and self.merged_whole(token):
                    last, count = token, n + self.cost(token)
                    break
        known = (*known, (last, count))
        while text not in self.starts:
            text, known = text[1:], known[1:]
        # what stands left of the kept suffix counts as read: counts are relative to the present one
        to = (text, tuple((x[0], x[1] - count) if x and text[k:] in self.starts else None for k, x in enumerate(known)))
        if to not in self.named:
            self.named[to] = len(self.states)
            self.states.append(to)
            self.next.append({})
        self.next[state][char] = out = (self.named[to], count)
        return out

    @functools.lru_cache(1 << 16)  # noqa: B019
    def merged_whole(self, token: str) -> bool:
        """Whether the merges reach this piece from its characters."""
        return self.merged(token) == [token]

    def step(self, state: int, char: str) -> tuple[int, int]:
        """(next state, change of the count); a space after another character begins a segment."""
        if char == "▁" and state and not self.states[state][0].endswith("▁"):
            state = 0
        return self.next[state].get(char) or self.compile(state, char)

    def read(self, state: int, text: str) -> tuple[int, int]:
        """(state, count) after reading a text from a state."""
        total = 0
        for char in text:
            state, change = self.step(state, char)
            total += change
        return state, total

    def segment(self, text: str) -> int:
        """The count of one segment."""
        state = total = 0
        step = self.next
        for char in text:
            state, change = step[state].get(char) or self.compile(state, char)
            total += change
        return total

    def counts(self, segments: list[str]) -> np.ndarray:
        known = self.known
        long = {}
        for s in set(segments):
            if s not in known:
                (known if len(s) <= _SHORT else long)[s] = self.segment(s)
        if long:
            return np.fromiter((known[s] if len(s) <= _SHORT else long[s] for s in segments), np.int64, len(segments))
        return np.fromiter(map(known.__getitem__, segments), np.int64, len(segments))

    def open_after(self, text: str) -> set[int]:
        """States that may be open after ``text``: it was read from the initial state at one of its characters."""
        live: set[int] = set()
        for char in text:
            live = {self.step(s, char)[0] for s in live | {0}}
        return live


def _segments(text: str) -> list[str]:
    """``text``, which starts with a space mark, cut before each run of space marks."""
    if "▁▁" not in text:
        return ["▁" + s for s in text.split("▁")[1:]]
    out, run = [], ""
    for s in text.split("▁")[1:]:
        run += "▁"
        if s:
            out.append(run + s)
            run = ""
    return out + [run] * bool(run)


class StateMap:
    """From a state to (state, count): a table of the states expected, and how to read others."""

    def __init__(self, table: dict[int, tuple[int, int]], read: Callable[[int], tuple[int, int]]) -> None:
        self.table, self.read = table, read

    def __call__(self, state: int) -> tuple[int, int]:
        if (got := self.table.get(state)) is None:
            got = self.table[state] = self.read(state)
        return got


def chunk_map(machine: Transducer, chunk: str, states: set[int]) -> StateMap:
    """The map of one chunk. States flow together where a segment begins, from where the chunk is read once."""
    at = 0
    while (at := chunk.find("▁", at + 1)) > 0 and chunk[at - 1] == "▁":
        pass
    head, rest = (chunk, "") if at < 0 else (chunk[:at], chunk[at:])
    if rest:
        *whole, tail = _segments(rest)
        end, n = machine.read(0, tail)
        n += int(machine.counts(whole).sum())

    def read(state: int) -> tuple[int, int]:
        to, count = machine.read(state, head)
        return (end, count + n) if rest else (to, count)

    # states that have met go on as one
    live: dict[int, dict[int, int]] = {s: {s: 0} for s in states}
    for char in head:
        after: dict[int, dict[int, int]] = {}
        for state, froms in live.items():
            to, change = machine.step(state, char)
            after.setdefault(to, {}).update({s: c + change for s, c in froms.items()} if change else froms)
        live = after
    table = {s: (end, c + n) if rest else (to, c) for to, froms in live.items() for s, c in froms.items()}
    return StateMap(table, read)


def compose(a: StateMap, b: StateMap) -> StateMap:
    """What ``a`` and then ``b`` do."""

    def read(state: int) -> tuple[int, int]:
        to, count = a(state)
        end, more = b(to)
        return end, count + more

    return StateMap({s: read(s) for s in list(a.table)}, read)


def scan(maps: list[StateMap]) -> list[StateMap]:
    """The composition of every prefix, in passes over neighbours at a distance that doubles."""
    distance = 1
    while distance < len(maps):
        maps = [m if i < distance else compose(maps[i - distance], m) for i, m in enumerate(maps)]
        distance *= 2
    return maps


def count_text(machine: Transducer, text: str) -> int:
    """Tokens of one text by the scan of its chunks' maps."""
    starts = range(0, len(text), CHUNK)
    maps = [chunk_map(machine, text[i : i + CHUNK], machine.open_after(text[max(0, i - BEFORE) : i]) if i else {0}) for i in starts]
    return scan(maps)[-1](0)[1]


@functools.lru_cache(2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def count_tokens(documents: DataFrame, path: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """``documents`` without ``text``, with n_bytes, n_tokens and over_limit (n_tokens > limit); no shuffle.

    Null texts count as empty and have no tokens. Every row gives one row. Columns that already have these names are
    replaced.
    """
    new = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in documents.columns if c.lower() not in new and c != text]
    frame = documents.select(*kept, F.coalesce(text, F.lit("")).alias(text))
    schema = frame.select(*kept, F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens")).schema

    def rows(batches):
        machine = transducer(path)
        for batch in batches:
            for part in text_slices(batch, len(kept)):
                if len(machine.known) > _KNOWN or len(machine.states) > _STATES:
                    machine.forget()
                texts = part.column(len(kept)).to_pylist()
                marked = ["▁" + t.replace(" ", "▁") if t else "" for t in texts]
                count = np.zeros(len(marked), np.int64)
                short = [i for i, t in enumerate(marked) if 0 < len(t) <= CHUNK]
                cut = [_segments(marked[i]) for i in short]
                of = machine.counts([s for c in cut for s in c])
                ends = np.cumsum([0, *map(len, cut)])
                sums = np.concatenate([[0], np.cumsum(of)])
                count[short] = sums[ends[1:]] - sums[ends[:-1]]
                for i, t in enumerate(marked):
                    if len(t) > CHUNK:
                        count[i] = count_text(machine, t)
                size = pa.array([len(t.encode()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], size, pa.array(count)], names=[*kept, "n_bytes", "n_tokens"])

    return frame.mapInArrow(rows, schema).withColumn("over_limit", F.col("n_tokens") > limit)
