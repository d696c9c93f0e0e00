"""Order-preserving packing into windows by dynamic programming.

The ids of a task's documents form one stream in their order. Window cuts are chosen among
document ends, sentence ends and a fixed grid by least total cost: padding, plus a penalty where
a cut falls inside a sentence or inside a document. With S[j] = best[j] + position[j], the best
predecessor of j is the least S within the last WINDOW ids, which a monotone queue keeps, so the
whole costs one pass. What is left at the end of the stream is cut into powers of two when that
is cheaper, as those sequences need no padding.

Tokens: the public tokenizer never joins across white space, so each distinct stretch between
blanks is encoded once per worker and the ids are assembled in numpy.

Defined results: null text is empty text; an empty document is its end id alone. Repeated rows
are packed each. An empty table gives no rows. A document longer than a window spans several.
Extra columns are ignored. Sequences never leave a task, so a lost executor repeats only its own.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import batch, lean

WINDOW = 2048
END_ID = 1
#: Costs of a cut, in padding ids: inside a sentence, and between two sentences of one document.
MID_SENTENCE, MID_DOCUMENT = 12, 2
GRID = 64
#: Ids of documents that one dynamic programme takes at most (at least one document).
STREAM = 1 << 19
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0D]] = True
STOPS = np.zeros(256, bool)
STOPS[[ord("."), ord("!"), ord("?")]] = True


class Words:
    """Ids by hash of a stretch, ascending by hash."""

    def __init__(self):
        self.keys, self.start, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint16)

    def add(self, keys: np.ndarray, start: np.ndarray, length: np.ndarray, flat: np.ndarray) -> None:
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.start = np.insert(self.start, at, (start + len(self.flat)).astype(np.int32))
        self.length = np.insert(self.length, at, length.astype(np.int32))
        self.flat = np.concatenate([self.flat, flat])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return at, self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)


_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of whole texts. It remembers the ids of each stretch between blanks, up to BOUND stretches, after which it starts afresh; one is kept per Python worker."""

    BOUND, RECENT, SLICE = 1_500_000, 100_000, 4096

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.old, self.recent = Words(), Words()
        self.ids = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32

    @staticmethod
    def of(path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def learn(self, hashes: np.ndarray, stretches: list[str]) -> None:
        if len(self.recent.keys) > self.RECENT:
            if len(self.old.keys) + len(self.recent.keys) > self.BOUND:
                self.old = Words()
            x = self.recent
            self.old.add(x.keys, x.start, x.length, x.flat)
            self.recent = Words()
        for i in range(0, len(stretches), self.SLICE):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(stretches[i : i + self.SLICE], add_special_tokens=False)]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            self.recent.add(hashes[i : i + self.SLICE], np.cumsum(n) - n, n, np.fromiter(itertools.chain.from_iterable(ids), self.ids, int(n.sum())))

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and length of each key's ids in the old ones followed by the recent ones; which keys are unknown."""
        (a, old), (b, new) = self.old.find(keys), self.recent.find(keys)
        start, length = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        start[old], length[old] = self.old.start[a[old]], self.old.length[a[old]]
        start[new], length[new] = self.recent.start[b[new]] + len(self.old.flat), self.recent.length[b[new]]
        return start, length, ~(old | new)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all rows with END_ID after each, the rows' offsets in them, and places after which a sentence ends."""
        ink = ~BLANK[data]
        first, last = ink.copy(), ink.copy()
        if len(data):
            first[1:] &= ~ink[:-1]
            last[:-1] &= ~ink[1:]
            some = np.diff(offsets) > 0
            first[offsets[:-1][some]] = ink[offsets[:-1][some]]
            last[offsets[1:][some] - 1] = ink[offsets[1:][some] - 1]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        h = K.word_hashes(data, a, b)
        rows = np.searchsorted(a, offsets)
        u, where, back = np.unique(h, return_index=True, return_inverse=True)
        start, length, new = self.look_up(u)
        if new.any():
            raw = data.tobytes()
            self.learn(u[new], [raw[a[i] : b[i]].decode("utf-8", "replace") for i in where[new]])
            start, length, new = self.look_up(u)
            if new.any():  # room was made for the new ones
                self.learn(u[new], [raw[a[i] : b[i]].decode("utf-8", "replace") for i in where[new]])
                start, length, _ = self.look_up(u)
        start, length = start[back], length[back]
        ends = np.cumsum(length)
        # ids of stretch i begin at ends[i] - length[i], moved by one for each document end before it
        row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        total = int(ends[-1]) if len(ends) else 0
        source = np.repeat(start - (ends - length), length) + np.arange(total)
        out = np.full(total + len(rows) - 1, END_ID, np.uint32)
        of_old = source < len(self.old.flat)
        ids = np.empty(total, np.uint32)
        ids[of_old], ids[~of_old] = self.old.flat[source[of_old]], self.recent.flat[source[~of_old] - len(self.old.flat)]
        out[np.arange(total) + np.repeat(row, length)] = ids
        bounds = np.concatenate([[0], ends])[rows] + np.arange(len(rows))
        stop = STOPS[data[b - 1]] if len(b) else np.zeros(0, bool)
        newline = np.zeros(len(b), bool)
        if len(b) > 1:
            lines = np.cumsum(data == 0x0A)
            newline[:-1] = lines[a[1:]] > lines[b[:-1] - 1]
        return out, bounds, (ends + row)[stop | newline]


def choose_cuts(n: int, sentences: np.ndarray, documents: np.ndarray, window: int = WINDOW) -> list[int]:
    """Ends of the windows over ids 0..n-1, least cost first by the recurrence above."""
    cost = np.full(n + 1, -1, np.int8)
    cost[GRID:n:GRID] = MID_SENTENCE
    if n:
        cost[window:n:window] = MID_SENTENCE
    cost[sentences[(sentences > 0) & (sentences < n)]] = MID_DOCUMENT
    cost[documents[(documents > 0) & (documents < n)]] = 0
    cost[n] = 0
    where = np.flatnonzero(cost[1:] >= 0) + 1
    places, penalties = [0, *where.tolist()], [0, *cost[where].tolist()]
    m = len(places)
    back = [0] * m
    queue: deque = deque([(0, 0, 0)])  # best + place, place, index; values rise from left to right
    push, pop, popleft = queue.append, queue.pop, queue.popleft
    for j in range(1, m):
        p = places[j]
        while queue[0][1] < p - window:
            popleft()
        least, _, back[j] = queue[0]
        s = least + window + penalties[j]  # best[j] + p
        while queue and queue[-1][0] >= s:
            pop()
        push((s, p, j))
    # the end may also be reached from any place within one window by powers of two without padding
    tail = None
    if n:
        last = places[back[m - 1]]
        rest = n - last
        powers = [1 << k for k in range(11, -1, -1) if rest >> k & 1]
        if MID_SENTENCE * (len(powers) - 1) < window - rest:
            tail = powers
    ends, j = [], m - 1
    while j:
        ends.append(places[j])
        j = back[j]
    ends.reverse()
    if tail:
        ends.pop()
        at = n - sum(tail)
        for x in tail:
            at += x
            ends.append(at)
    return ends


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece; `ids` (little-endian, 32 bits each) only if asked for."""

    def run(batches):
        from pyspark import TaskContext

        encode = Encoder.of(tokenizer)
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        size = 0

        def flush():
            nonlocal sequence
            ids = np.concatenate([x[1] for x in held])
            shift = np.cumsum([0, *(len(x[1]) for x in held)])
            bounds = np.concatenate([[0], *(x[2][1:] + s for x, s in zip(held, shift, strict=False))]).astype(np.int64)
            sentences = np.concatenate([x[3] + s for x, s in zip(held, shift, strict=False)])
            names = pa.concat_arrays([x[0] for x in held])
            cuts = np.array(choose_cuts(len(ids), sentences, bounds), np.int64)
            edges = np.union1d(cuts, bounds)
            a, b = np.append(0, edges[edges > 0])[:-1], edges[edges > 0]
            row = np.searchsorted(bounds, a, "right") - 1
            window = np.searchsorted(cuts, a, "right")
            window_start = np.append(0, cuts)[window]
            raw = memoryview(ids.astype("<u4").tobytes())
            parts = [raw[4 * x : 4 * y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            own = [bytes(x) for x in parts] if with_ids else [None] * len(parts)
            yield batch(PIECES, names.take(pa.array(row)), a - bounds[row], b - a, [zlib.crc32(x) for x in parts], (bounds[1:] - bounds[:-1])[row], sequence + window, a - window_start, own)
            sequence += len(cuts)
            held.clear()

        for b in batches:
            for i, j, data, offsets in K.chunks(b.column("text"), 1 << 20):
                held.append((b.column("doc_id").slice(i, j - i).cast(pa.int64()), *encode(data, offsets)))
                size += len(held[-1][1])
                if size >= STREAM:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    return out if with_ids else out.drop("ids")
