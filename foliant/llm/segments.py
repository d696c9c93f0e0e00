"""Repeated windows of symbols, found without listing every window: what the two substring
operators share.

Windows of `length` symbols are cut into runs that share an anchor (kernel.anchored_runs). Equal
windows have equal anchors, so all occurrences of a window meet where the runs of its anchor meet:
one shuffle by anchor. Runs equal in anchor and content (128 bits) are one stretch of text, so
only one of them is looked at any further. An anchor with one stretch is done: either it occurs
once, or its copies repeat as a whole. Where one anchor has several stretches, their texts go to
a block, in which an index of the operator's own kind says which windows they share.

An anchor in ever other surroundings, as a common line has, would gather a stretch from every
document. Such crowded anchors are found beforehand by counts in a table of fixed size (SLOTS),
over all texts; their runs are cut anew by a longer anchor, and by the whole window where that is
crowded too. Then a key is the window itself and has one stretch, so no group is left that grows
with the input, but as a slot's share does. The threshold is relative to the mean count of a slot:
the table cannot fill up, and the same plan runs at every size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import LAST_ID, batch, lean, narrow_batches

#: data, offsets -> (symbols, the rows' offsets in them)
Symbols = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: Stretches of one anchor from which it may count as crowded, and how many times the mean of a slot.
CROWD, TIMES = 1000, 4
#: Slots in which anchors are counted, and in how many parts they travel.
SLOTS, PARTS = 1 << 20, 64
#: Bytes of stretches from which a block is judged.
BLOCK = 1 << 20
#: Runs that a task holds at once, whatever the batches it gets; only among these are equal stretches found before the shuffle.
RUNS = 1 << 18

SURE, MULTI = 1, 2


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id (null ranks last), th (hash of the text) and text. Rows equal in id and text are one document."""
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))


def _slot(anchor: np.ndarray) -> np.ndarray:
    return (anchor >> np.uint64(64 - (SLOTS - 1).bit_length())).astype(np.int64)


class Cutter(NamedTuple):
    """Cuts texts into runs: by anchors of anchors[0] symbols, where those are crowded by anchors[1], and so on."""

    symbols: Symbols
    length: int
    anchors: tuple[int, ...]
    crowded: tuple[Broadcast, ...]  # a bit for each slot, for each but the last of the anchors

    def levels(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """For each kind of anchor in use: row, s0, n, anchor, sig, and whether the anchor is crowded."""
        text, at = self.symbols(data, offsets)
        rows, base = np.arange(len(at) - 1), np.zeros(len(at) - 1, np.int64)
        for level, k in enumerate(self.anchors):
            row, s0, n, anchor, sig = K.anchored_runs(K.Prefix(text), at, self.length, k, K.Prefix(text, second=True))
            slot = _slot(anchor)
            many = (self.crowded[level].value[slot >> 3] >> (slot & 7) & 1).astype(bool) if level < len(self.crowded) else np.zeros(len(row), bool)
            yield rows[row], base[row] + s0, n, anchor, sig, many
            if not many.any():
                return
            rows, base, size = rows[row[many]], base[row[many]] + s0[many], n[many] + self.length - 1
            new = np.concatenate([[0], np.cumsum(size)])
            text = text[np.repeat(at[row[many]] + s0[many] - new[:-1], size) + np.arange(new[-1])]
            at = new

    def runs(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """row, s0, n, anchor, sig in the order of the texts."""
        parts = [[x[~many] for x in run] for *run, many in self.levels(data, offsets)]
        cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
        order = np.lexsort((cols[1], cols[0]))
        return tuple(x[order] for x in cols)


def _grouped(parts: Iterator[tuple[np.ndarray, ...]], rows: int | None = None) -> Iterator[list[np.ndarray]]:
    """Columns of runs that come in small parts, joined until they have `rows` rows (RUNS by default), at least one part."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= (rows or RUNS):
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, size = [], 0
    if size:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _crowds(source: DataFrame, cutter: Cutter) -> np.ndarray:
    """A bit for each slot in which anchors of the cutter's last kind are crowded.

    Each RUNS of a task count their different stretches (so copies don't make a crowd), each task
    sends its sums of fixed size, and the driver gets the total, 8 MB at any input size.
    """
    level = len(cutter.crowded)
    part = SLOTS // PARTS

    def count(batches):
        sums = np.zeros(SLOTS, np.int32)

        def found():
            for b in batches:
                for _, _, data, offsets in K.chunks(b.column("text")):
                    for k, (_, _, _, anchor, sig, _) in enumerate(cutter.levels(data, offsets)):
                        if k == level:
                            yield anchor, sig

        for anchor, sig in _grouped(found()):
            _, first = np.unique(anchor ^ K.mix(sig), return_index=True)
            slot, n = np.unique(_slot(anchor[first]), return_counts=True)
            sums[slot] += n.astype(np.int32)
        for p in range(PARTS):
            x = sums[p * part : (p + 1) * part]
            if x.any():  # bytes of one weight together, as most counts are small
                yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "data": [x.view(np.uint8).reshape(-1, 4).T.tobytes()]})

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for p, x in zip(b.column("part").to_pylist(), b.column("data"), strict=True):
                own = np.ascontiguousarray(np.frombuffer(x.as_py(), np.uint8).reshape(4, -1).T).view(np.int32)[:, 0]
                sums[p] = sums.get(p, 0) + own.astype(np.int64)
        for p, x in sums.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "data": [x.tobytes()]})

    schema = "part int, data binary"
    counts = np.zeros((PARTS, part), np.int64)
    with narrow_batches(source.sparkSession):
        for p, x in source.select("text").mapInArrow(lean(count), schema).repartition("part").mapInArrow(lean(total), schema).toLocalIterator():
            counts[p] = np.frombuffer(x, np.int64)
    counts = counts.ravel()
    return np.packbits(counts > max(CROWD, TIMES * counts.sum() // SLOTS), bitorder="little")


def cutter(source: DataFrame, symbols: Symbols, length: int, anchors: tuple[int, ...]) -> Cutter:
    """anchors: lengths of the anchors in turn; the window itself comes last."""
    out = Cutter(symbols, length, (*anchors, length), ())
    for _ in anchors:
        bits = _crowds(source, out)
        out = out._replace(crowded=(*out.crowded, source.sparkSession.sparkContext.broadcast(bits)))
        if not bits.any():
            break
    return out


def _places(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (place >> 30).astype(np.int32), (place >> 2 & (1 << 28) - 1).astype(np.int32)


def _classes(key: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted rows: where classes of one key and content begin, and the first row of each row's class."""
    head = np.ones(len(key), bool)
    head[1:] = (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])
    return head, np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))


def settle(source: DataFrame, cut_by: Cutter, all_go: bool) -> DataFrame:
    """id, th, s0, n, block, ref, ref_s0: runs that repeat (block null, with one occurrence that is their reference), and stretches that a block must judge (ref is 1 if they repeat anyway).

    all_go: of stretches that occur several times all repeat; else all but the earliest. One
    shuffle: of equal stretches among a task's RUNS only the earliest goes to its anchor; the others
    are sure to repeat, are joined with their neighbours and dealt out evenly.
    """
    found = pa.schema([(x, pa.int64()) for x in ("key", "sig", "id", "th", "place")])

    def first_of(sig_at, ids, ths, place):
        return (ids == ids[sig_at]) & (ths == ths[sig_at]) & (place >> 2 == place[sig_at] >> 2)

    def cut_runs(batches):
        before = 0
        for b in batches:
            ids, ths = b.column("id").to_numpy(), b.column("th").to_numpy()
            for i, j, data, offsets in K.chunks(b.column("text")):
                row, s0, n, key, sig = cut_by.runs(data, offsets)
                yield row + before, s0, n, K.signed(key), K.signed(sig), ids[i + row], ths[i + row]
                before += j - i

    def find(batches):
        for row, s0, n, key, sig, own, th in _grouped(cut_runs(batches)):
            place = s0 << 30 | n << 2
            order = np.lexsort((place, th, own, sig, key))
            head, at = _classes(key[order], sig[order])
            size = np.diff(np.append(np.flatnonzero(head), len(order)))
            first = head if all_go else first_of(at, own[order], th[order], place[order])
            sure, ref = np.zeros(len(row), bool), np.zeros(len(row), np.int64)
            sure[order], ref[order] = ~first, order[at]
            if all_go:
                place[order[head]] |= np.where(size > 1, MULTI, 0)
            keep = np.flatnonzero(~sure)
            gone = np.flatnonzero(sure)
            # neighbouring windows that repeat one stretch are one row
            new = np.ones(len(gone), bool)
            a, c = gone[1:], gone[:-1]
            new[1:] = (row[a] != row[c]) | (s0[a] != s0[c] + n[c]) | (s0[a] >> 27 != s0[c] >> 27)
            if all_go:
                new[1:] |= (row[ref[a]] != row[ref[c]]) | (s0[ref[a]] - s0[a] != s0[ref[c]] - s0[c])
            heads = np.flatnonzero(new)
            total = np.add.reduceat(n[gone], heads) if len(gone) else n[:0]
            gone = gone[heads]
            spread = K.signed(K.mix(own[gone].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + s0[gone].astype(np.uint64)) << np.uint64(31) | s0[ref[gone]].astype(np.uint64))
            cols = (
                np.concatenate([key[keep], spread]),
                np.concatenate([sig[keep], own[ref[gone]]]),
                np.concatenate([own[keep], own[gone]]),
                np.concatenate([th[keep], th[gone]]),
                np.concatenate([place[keep], s0[gone] << 30 | total << 2 | SURE]),
            )
            for i in range(0, len(cols[0]), 1 << 16):
                yield batch(found, *(x[i : i + (1 << 16)] for x in cols))

    out = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("s0", pa.int32()), ("n", pa.int32()), ("block", pa.int64()), ("ref", pa.int64()), ("ref_s0", pa.int32())])

    def rows(key, sig, ids, ths, place):
        yes = place & SURE > 0
        s0, n = _places(place)
        yield batch(out, ids[yes], ths[yes], s0[yes], n[yes], pa.nulls(int(yes.sum()), pa.int64()), sig[yes], (key[yes] & (1 << 31) - 1).astype(np.int32))
        key, sig, ids, ths, place, s0, n = (x[~yes] for x in (key, sig, ids, ths, place, s0, n))
        if not len(key):
            return
        head, at = _classes(key, sig)
        heads = np.flatnonzero(head)
        group = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
        kinds = np.bincount(group[heads])[group]
        if all_go:
            members = np.diff(np.append(heads, len(key))) + (np.add.reduceat(place & MULTI, heads) > 0)
            gone = members[np.cumsum(head) - 1] > 1
        else:
            gone = ~first_of(at, ids, ths, place)
        yield batch(out, ids[gone], ths[gone], s0[gone], n[gone], pa.nulls(int(gone.sum()), pa.int64()), ids[at[gone]], s0[at[gone]])
        to = head & (kinds > 1)
        yield batch(out, ids[to], ths[to], s0[to], n[to], key[to], gone[to].astype(np.int64), np.zeros(int(to.sum()), np.int32))

    def resolve(batches):
        held: list[np.ndarray] | None = None
        for new in _grouped((tuple(b.column(x).to_numpy() for x in found.names) for b in batches), 1 << 14):
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            change = np.flatnonzero(held[0][1:] != held[0][:-1])
            if len(change):  # an anchor's rows are taken together
                end = int(change[-1]) + 1
                yield from rows(*(x[:end] for x in held))
                held = [x[end:] for x in held]
        if held is not None:
            yield from rows(*held)

    dealt = source.mapInArrow(lean(find), "key long, sig long, id long, th long, place long").repartition("key").sortWithinPartitions("key", "sig", "id", "th", "place")
    return dealt.mapInArrow(lean(resolve), "id long, th long, s0 int, n int, block long, ref long, ref_s0 int")


def by_document(spans: DataFrame, value: str) -> DataFrame:
    """One row per document with its structs `value` as an array."""
    return spans.groupBy("id", "th").agg(F.collect_list(value).alias(value))


def beside(source: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Bring per-document arrays to the texts, on the row key. Always by a shuffle: the arrays grow with the corpus, and so the plan is the same at every size."""
    return source.join(rows.hint("merge"), ["id", "th"], how)


class Stretches(NamedTuple):
    """A block's stretches, ordered by key and then place."""

    key: np.ndarray
    ids: np.ndarray
    ths: np.ndarray
    s0: np.ndarray
    known: np.ndarray  # they repeat anyway
    text: list[bytes]


#: (which, first window in it, windows, reference's id, its first window) of repeats that a block finds
Judge = Callable[[Stretches], tuple[np.ndarray, ...]]


def judged(source: DataFrame, settled: DataFrame, bounds: Callable[..., tuple[np.ndarray, np.ndarray]], judge: Judge) -> DataFrame:
    """id, th, s0, n, ref, ref_s0 of the windows that the blocks of `settled` find to repeat.

    bounds: data, offsets, row, s0, n -> first and end byte of a stretch. Blocks of whole keys are
    filled up to BLOCK bytes and judged at once.
    """
    open_ = settled.where("block is not null").select("id", "th", F.struct("s0", "n", "block", "ref").alias("segment"))
    pieces = pa.schema([("block", pa.int64()), ("id", pa.int64()), ("th", pa.int64()), ("s0", pa.int32()), ("known", pa.bool_()), ("bytes", pa.binary())])

    def slices(batches):
        for b in batches:
            ids, ths = b.column("id").to_numpy(), b.column("th").to_numpy()
            own = b.column("segment")
            flat, counts = own.flatten(), pa.compute.list_value_length(own).to_numpy()
            s0, n, key, ref = (flat.field(x).to_numpy() for x in ("s0", "n", "block", "ref"))
            edges = np.concatenate([[0], np.cumsum(counts)])
            for i, j, data, offsets in K.chunks(b.column("text")):
                x = slice(edges[i], edges[j])
                row = np.repeat(np.arange(i, j), counts[i:j])
                begin, end = bounds(data, offsets, row - i, s0[x].astype(np.int64), n[x].astype(np.int64))
                raw = data.tobytes()
                yield batch(pieces, key[x], ids[row], ths[row], s0[x], pa.array(ref[x] > 0), [raw[p:q] for p, q in zip(begin.tolist(), end.tolist(), strict=True)])

    found = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("s0", pa.int32()), ("n", pa.int32()), ("ref", pa.int64()), ("ref_s0", pa.int32())])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(rows: pa.Table):
            cols = [rows.column(c).to_numpy() for c in ("block", "id", "th", "s0", "known")]
            order = np.lexsort((cols[3], cols[2], cols[1], cols[0]))
            new = np.ones(len(order), bool)  # rows that are one document bring a stretch several times
            new[1:] = np.any([x[order][1:] != x[order][:-1] for x in cols[:4]], axis=0)
            order = order[new]
            cols = [x[order] for x in cols]
            text = rows.column("bytes").to_pylist()
            which, first, n, ref, ref_s0 = judge(Stretches(*cols, [text[i] for i in order.tolist()]))
            yield batch(found, cols[1][which], cols[2][which], (cols[3][which] + first).astype(np.int32), n.astype(np.int32), ref, ref_s0.astype(np.int32))

        for b in batches:
            for i in range(0, b.num_rows, 1024):
                held.append(b.slice(i, 1024))
                size += held[-1].column("bytes").nbytes
                if size < BLOCK:
                    continue
                rows = pa.Table.from_batches(held)
                key = rows.column("block").to_numpy()
                end = int(np.searchsorted(key, key[-1]))  # keys are sorted; the last may go on
                if end:
                    yield from flush(rows.slice(0, end))
                    held = rows.slice(end).to_batches()
                    size = sum(x.column("bytes").nbytes for x in held)
        if held:
            yield from flush(pa.Table.from_batches(held))

    cols = "block long, id long, th long, s0 int, known boolean, bytes binary"
    texts = beside(source, by_document(open_, "segment"), "inner").select("id", "th", "text", "segment")
    dealt = texts.mapInArrow(lean(slices), cols).repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(lean(run), "id long, th long, s0 int, n int, ref long, ref_s0 int")


def suffix_array(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffixes of a text of pieces, by prefix doubling: symbols from 0 up, and at `ends` separators (each ranks by its place, below all symbols)."""
    n = len(text)
    bits = max(int(text.max(initial=0)) + 2, 2).bit_length()
    span = max(1, min(63 // bits, n))
    wide = np.zeros(n + span, np.int64)
    wide[:n] = text + 1
    wide[ends] = 0
    gap = np.zeros(n, np.int64)
    gap[ends] = 1
    to_end = np.append(ends, n)[np.cumsum(gap) - gap] - np.arange(n)
    key = np.zeros(n, np.int64)
    for i in range(span):
        key = key << bits | np.where(i < to_end, wide[i : i + n], 0)
    near = np.where(to_end < span, np.arange(n) + to_end + 1, 0)  # a separator within the first symbols decides ties
    order = np.lexsort((near, key))
    new = np.ones(n, np.int64)
    new[1:] = (key[order][1:] != key[order][:-1]) | (near[order][1:] != near[order][:-1])
    rank = np.zeros(n, np.int64)
    rank[order] = np.cumsum(new)
    while rank.max() < n:
        second = np.zeros(n, np.int64)
        second[: max(n - span, 0)] = rank[span:] if span < n else 0
        both = rank * (n + 1) + second
        order = np.argsort(both, kind="stable")
        new = np.ones(n, np.int64)
        new[1:] = both[order][1:] != both[order][:-1]
        rank[order] = np.cumsum(new)
        span *= 2
    return order


def gathered(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, separator: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chosen stretches of symbols one after the other, each followed by a separator; their new starts and ends."""
    size = ends - starts
    to = np.cumsum(size + 1) - 1
    out = np.full(int(to[-1]) + 1 if len(to) else 0, separator, symbols.dtype)
    begin = to - size
    where = np.arange(int(size.sum()))
    shift = np.repeat(np.cumsum(size) - size, size)
    out[where - shift + np.repeat(begin, size)] = symbols[where - shift + np.repeat(starts, size)]
    return out, begin, to


def ranks(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted groups: each member's number in its group, and the group's size."""
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else group[:0]
    size = np.diff(np.append(heads, len(group)))
    return np.arange(len(group)) - np.repeat(heads, size), np.repeat(size, size)
