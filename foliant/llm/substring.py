"""Substring dedup by relative Lempel-Ziv parsing, on words.

Texts are cut into stretches of 35-word windows that share an anchor; equal stretches are one,
and repeat if they occur twice (see segments). Stretches around the same anchor in different
surroundings come together in reference blocks: for each binary digit of their numbers, those
with a 0 are indexed by a suffix array and those with a 1 are parsed against it, then the other
way round, so every stretch is parsed against every other one. Parsing is greedy: the longest
match at each place is a factor, and the next begins behind it. Factors of at least 35 words
are duplicate spans, and the windows across a factor's boundary, which a greedy parse can miss,
are looked up on their own. A document's factors are then joined where they continue each other.

Results are exact up to hashes: 128 bits for equal stretches, 64 bits in a block.

Defined results: null text has no words; a text without words keeps the empty string. Rows equal
in id and text count as one document, but still as occurrences of each other: all their windows
repeat. A null id ranks last. Documents shorter than a window keep all words. Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .segments import Stretches, beside, by_document, cutter, gathered, judged, keyed, ranks, settle, suffix_array
from .shared import LAST_ID, batch, cut, lean

WINDOW = 35
ANCHOR, LONG_ANCHOR = 10, 30


def word_symbols(data: np.ndarray, offsets: np.ndarray):
    starts, ends, at = K.words(data, offsets)
    return K.word_hashes(data, starts, ends), at


def parse(s0: np.ndarray, n: np.ndarray, ref: np.ndarray, ref_s0: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, words, reference, its start) from the indexed phrases of one document: phrase i says that windows s0..s0+n-1 equal those of ref from ref_s0."""
    order = np.lexsort((-n, s0))
    factors: list[list[int]] = []
    reach = -1  # windows below it are factored
    for i in order.tolist():
        a, end = int(s0[i]), int(s0[i] + n[i])
        if end <= reach:
            continue
        a2 = max(a, reach)
        shift = int(ref_s0[i]) + a2 - a
        last = factors[-1] if factors else None
        if last and a2 == last[0] + last[1] and ref[i] == last[2] and shift == last[3] + last[1]:
            last[1] += end - a2
        else:
            factors.append([a2, end - a2, int(ref[i]), shift])
        reach = end
    return [(a, k + window - 1, r, s) for a, k, r, s in factors]


class Block:
    """A reference block: stretches of words with a suffix array, for longest matches by binary search."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.text, self.starts, self.ends = gathered(symbols, starts, ends, 0)
        self.order = suffix_array(self.text, self.ends)
        self.left = np.append(self.ends, len(self.text))[np.searchsorted(self.ends, np.arange(len(self.text)))] - np.arange(len(self.text))
        self.sums = K.Prefix(K.mix(self.text.astype(np.uint64) + np.uint64(1)))

    def common(self, other: K.Prefix, at: np.ndarray, most: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Words that the other text at `at` and the block at `place` have in common, up to `most`."""
        most = np.minimum(most, self.left[place])
        n = np.zeros(len(at), np.int64)
        step = 1 << int(most.max(initial=1)).bit_length()
        while step:
            ok = np.flatnonzero(n + step <= most)
            same = other.span(at[ok] + n[ok], at[ok] + n[ok] + step) == self.sums.span(place[ok] + n[ok], place[ok] + n[ok] + step)
            n[ok[same]] += step
            step >>= 1
        return n

    def longest(self, text: np.ndarray, sums: K.Prefix, at: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place in another text: how many words from there, up to `most`, some place of the block has too, and that place."""
        low, high = np.full(len(at), -1), np.full(len(at), len(self.order))
        best, spot = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for _ in range(int(len(self.order)).bit_length()):
            middle = (low + high) >> 1
            live = np.flatnonzero(high - low > 1)
            place = self.order[middle[live]]
            n = self.common(sums, at[live], most[live], place)
            more = n > best[live]
            best[live[more]], spot[live[more]] = n[more], place[more]
            # behind the common words: the end of a stretch ranks below every word
            own = np.where(n < most[live], text[np.minimum(at[live] + n, len(text) - 1)] + 1, 0)
            theirs = np.where(n < self.left[place], self.text[np.minimum(place + n, len(self.text) - 1)] + 1, 0)
            up = own > theirs
            low[live[up]], high[live[~up]] = middle[live][up], middle[live][~up]
        return best, spot


def factor(block: Block, text: np.ndarray, sums: K.Prefix, starts: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Parse stretches of a text greedily against a block, and check the windows across the factors' boundaries.

    Returns stretch, first window, windows, place in the block, of all windows that the block has.
    """
    at = starts.copy()
    last = ends - window  # the last window's start
    live = np.flatnonzero(at <= last)
    found, across = [], []
    while len(live):
        n, spot = block.longest(text, sums, at[live], ends[live] - at[live])
        long = n >= window
        found.append((live[long], at[live][long], n[long] - window + 1, spot[long]))
        # windows that start in the factor and end behind it
        begin = np.maximum(at[live] + 1, at[live] + n - window + 1)
        to = np.minimum(at[live] + n, last[live] + 1)
        size = np.maximum(to - begin, 0)
        across.append((np.repeat(live, size), np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())))
        at[live] += np.maximum(n, 1)
        live = live[at[live] <= last[live]]
    which, place = (np.concatenate(x) for x in zip(*across, strict=True)) if across else (starts[:0], starts[:0])
    if len(which):
        n, spot = block.longest(text, sums, place, np.full(len(place), window))
        hit = n >= window
        found.append((which[hit], place[hit], np.ones(int(hit.sum()), np.int64), spot[hit]))
    which, place, n, spot = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [starts[:0]] * 4
    return which, place - starts[which], n, spot


def phrases(source: DataFrame, window: int, anchor: int) -> DataFrame:
    """id, th, phrase: struct(s0, n, ref, ref_s0) for all windows that occur more than once."""
    long_anchor = window * LONG_ANCHOR // WINDOW
    settled = cut(settle(source, cutter(source, word_symbols, window, (anchor, long_anchor)), all_go=True), wide=True)

    def bounds(data, offsets, row, s0, n):
        starts, ends, at = K.words(data, offsets)
        first = at[row] + s0
        return starts[first], ends[first + n + window - 2]

    def judge(x: Stretches):
        size = np.fromiter(map(len, x.text), np.int64, len(x.text))
        data = np.frombuffer(b"".join(x.text), np.uint8)
        begin, end, at = K.words(data, np.concatenate([[0], np.cumsum(size)]))
        _, symbols = np.unique(K.word_hashes(data, begin, end), return_inverse=True)
        sums = K.Prefix(K.mix(symbols.astype(np.uint64) + np.uint64(1)))
        # stretches none of whose long anchors is in another one share no window with any
        row, _, _, far, _ = K.anchored_runs(sums, at, window, long_anchor)
        _, back, times = np.unique(far, return_inverse=True, return_counts=True)
        some = np.unique(row[times[back] > 1])
        number, many = ranks(x.key[some])
        known, first_word, last_word = x.known[some], at[some], at[some + 1]
        parts = []
        # any two stretches of a key differ in some digit of their numbers: there each side is parsed against the other as its reference
        for level in range(int(many.max(initial=1) - 1).bit_length()):
            digit = number >> level & 1
            for side in (0, 1):
                own, other = np.flatnonzero((digit == side) & ~known & (many > 1 << level)), np.flatnonzero((digit != side) & (many > 1 << level))
                if len(own) and len(other):
                    block = Block(symbols, first_word[other], last_word[other])
                    which, first, n, spot = factor(block, symbols, sums, first_word[own], last_word[own], window)
                    ref = np.searchsorted(block.ends, spot)
                    parts.append((some[own[which]], first, n, x.ids[some[other[ref]]], x.s0[some[other[ref]]] + spot - block.starts[ref]))
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else tuple(np.zeros(0, np.int64) for _ in range(5))

    found = settled.where("block is null").drop("block").unionByName(judged(source, settled, bounds, judge))
    return found.select("id", "th", F.struct("s0", "n", "ref", "ref_s0").alias("phrase"))


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, factors (start, words, ref, ref_start), and on request the kept text."""
    source = keyed(docs, doc_id, text)
    rows = by_document(phrases(source, window, anchor), "phrase")
    factor = pa.struct([("start", pa.int32()), ("words", pa.int32()), ("ref", pa.int64()), ("ref_start", pa.int32())])
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("factors", pa.list_(factor)), ("text", pa.string())])

    def remove(batches):
        for b in batches:
            own = b.column("phrase")
            flat, counts = own.flatten(), pa.compute.list_value_length(own).fill_null(0).to_numpy()
            fields = [flat.field(x).to_numpy() for x in ("s0", "n", "ref", "ref_s0")]
            edges = np.concatenate([[0], np.cumsum(counts)])
            for i, j, data, offsets in K.chunks(b.column("text")):
                starts, ends, at = K.words(data, offsets)
                factors = [parse(*(x[edges[r] : edges[r + 1]] for x in fields), window) if counts[r] else [] for r in range(i, j)]
                spans = np.array([(at[r] + f[0], at[r] + f[0] + f[1]) for r, own in enumerate(factors) for f in own], np.int64).reshape(-1, 2)
                gone = K.cover(len(starts), spans[:, 0], spans[:, 1])
                sums = np.concatenate([[0], np.cumsum(gone)])
                removed = sums[at[1:]] - sums[at[:-1]]
                # a kept word's bytes and the blank after it, but for the last kept word of a row
                kept = np.flatnonzero(~gone)
                after = kept[1:]
                row = np.searchsorted(at, kept, "right") - 1
                more = np.zeros(len(kept), np.int64)
                more[:-1] = row[1:] == row[:-1] if len(after) else more[:-1]
                mask = K.cover(len(data), starts[kept], ends[kept] + more)
                blank = data.copy()
                blank[(ends[kept] + more - 1)[more > 0]] = 0x20
                blank, bounds = blank[mask].tobytes(), np.concatenate([[0], np.cumsum(mask)])[offsets]
                texts = [blank[x:y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                lists = pa.array([[dict(zip(("start", "words", "ref", "ref_start"), f, strict=True)) for f in x] for x in factors], pa.list_(factor))
                yield batch(out, b.column("doc_id").slice(i, j - i), np.diff(at), removed, [hashlib.sha256(x).hexdigest() for x in texts], lists, [x.decode() for x in texts] if with_text else pa.nulls(j - i, pa.string()))

    joined = beside(source, rows, "left").select(F.when(F.col("id") != LAST_ID, F.col("id")).alias("doc_id"), "text", "phrase")
    done = joined.mapInArrow(lean(remove), "doc_id long, n_words long, n_removed long, kept_sha256 string, factors array<struct<start:int,words:int,ref:long,ref_start:int>>, text string")
    return done if with_text else done.drop("text")
