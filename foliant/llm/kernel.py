"""Vectorised text kernels shared by the operators: they turn the UTF-8 buffer of an
Arrow string column into word and n-gram hashes without a Python loop over words.

Hashes are polynomials modulo 2**64 over mixed symbols; the hash of any stretch comes from
two prefix sums, so windows of any length cost the same. Every function of this module is
deterministic across processes and machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE2 = 0xD6E8FEB86659FD93 | 1
#: Bytes of text handled at once; a longer single document is handled alone.
CHUNK = 1 << 18
#: Low bits of a sliding-minimum key that hold the position.
POS_BITS = 31
POS_MASK = U((1 << POS_BITS) - 1)

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


SYMBOL = mix((np.arange(256, dtype=U) + U(1)) * U(0xA0761D6478BD642F))


class Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0
        self.up = self.down = np.zeros(0, U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 12)
            with np.errstate(over="ignore"):
                for name, base in (("up", self.base), ("down", self.inverse)):
                    x = np.full(self.n, base, U)
                    x[0] = 1
                    setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


_powers, _powers2 = Powers(BASE), Powers(BASE2)


class Prefix:
    """Prefix sums over symbols (uint64); `span(a, b)` hashes symbols a..b-1, at any place alike."""

    def __init__(self, symbols: np.ndarray, second: bool = False):
        up, self.down = (_powers2 if second else _powers)(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, U)
        np.cumsum(symbols * up[:-1], out=self.sums[1:])

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.down[a]

    def grams(self, k: int) -> np.ndarray:
        """The mixed hash of each k symbols in a row."""
        if len(self.sums) <= k:
            return np.zeros(0, U)
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k] + U(k))


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw, at


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of groups of rows of about `limit` bytes, at least one row."""
    raw, at = strings(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (stretches without the bytes 9-13 and 32), and the n + 1 word offsets of the rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~WHITE[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    first[heads] = ink[heads]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    tails = offsets[1:][np.diff(offsets) > 0] - 1
    last[tails] = ink[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    symbols = Prefix(SYMBOL[data], second)
    return mix(symbols.span(starts, ends) + (ends - starts).astype(U))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w values in a row, by doubling."""
    if len(x) < w:
        return x[:0]
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def anchored_runs(prefix: Prefix, offsets: np.ndarray, length: int, k: int, content: Prefix | None = None) -> tuple[np.ndarray, ...]:
    """Cut all windows of `length` symbols of the rows into runs that share an anchor.

    The anchor of a window is the k-gram in it with the least hash (leftmost among equals), a
    function of the window's content alone, so equal windows have equal anchors wherever they
    are. Neighbouring windows with the same anchor form a run. Returns for each run the row, the
    first window's start in the row, the number of windows, the anchor's hash, and a hash of all
    symbols that the run covers (from the sums `content`, if given, so that it is independent of the anchor's).
    """
    none = np.zeros(0, np.int64)
    n = int(offsets[-1])
    grams = prefix.grams(k)
    w = length - k + 1
    if n < length:
        return none, none, none, none.astype(U), none.astype(U)
    keys = (grams >> U(POS_BITS) << U(POS_BITS)) | np.arange(len(grams), dtype=U)
    at = (sliding_min(keys, w) & POS_MASK).astype(np.int64)
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    valid = np.zeros(len(at) + 1, np.int8)
    some = counts > 0
    np.add.at(valid, offsets[:-1][some], 1)
    np.add.at(valid, offsets[:-1][some] + counts[some], -1)
    valid = np.cumsum(valid[:-1]).astype(bool)
    head = valid.copy()
    head[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    head[offsets[:-1][some]] = True
    tail = valid.copy()
    tail[:-1] &= head[1:] | ~valid[1:]
    first, last = np.flatnonzero(head), np.flatnonzero(tail)
    row = np.searchsorted(offsets, first, "right") - 1
    sig = mix((content or prefix).span(first, last + length) + (last - first).astype(U))
    return row, first - offsets[row], last - first + 1, grams[at[first]], sig


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mask of n places that marks each place in any of the stretches."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, ends, -1)
    return np.cumsum(delta[:-1]) > 0
