"""Many block-sorted streams at once: the coder of `coder`, with each step taken by all streams together.

One stream is serial by nature, but streams are independent of each other, so a step is a few array
operations over all that are still running. Ranks are decoded without symbols (contexts depend on ranks
alone), then put back into symbols, then unsorted. The last few streams of a group go on in plain Python,
and a stream that isn't as an encoder makes it is left to `coder.decompress`, which has the last word.
`compress_all` is for fixtures, as is `coder.compress`, and gives the same bytes.
"""

from __future__ import annotations

import numpy as np

from foliant.functions import coder as C

#: Streams still running below which plain Python is faster.
FEW = 64
#: Bytes of text, and of streams, that are handled at once; symbols sorted or spelled at once.
GROUP, PACKED, PART = 12 << 20, 4 << 20, 1 << 20
#: Block size, as a stream tells it, from which one is decoded on its own.
LARGE = 1 << 18
#: Bytes of filler read behind a stream from which the rules for corrupt streams may matter.
BEHIND = 1 << 10

RAW, CONTEXTS = 260, 261
#: A state beyond the format's: a bit without a context is one at even odds that never adapts.
EVEN = 254
PROB, LIMIT = np.array(C.P, np.int32), np.array(C.M, np.int32)
UP, DOWN = np.array(C.UP, np.int64), np.array(C.DOWN, np.int64)
PROB[EVEN], LIMIT[EVEN], UP[EVEN], DOWN[EVEN] = 0x8000, 0, EVEN, EVEN
LEAD = np.array([C.ONES[a >> 8] if a < 0xFF00 else C.ONES[a & 0xFF] + 8 for a in range(1 << 16)], np.int32)


def _paths() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By 2 * context + bit, the next context and the rank that is complete (or -1); by rank, how many decisions spell it and which (2 * context + bit)."""
    follow, rank_of = np.zeros(2 * RAW, np.int64), np.full(2 * RAW, -1, np.int16)
    n, spelled = np.zeros(257, np.int64), np.zeros((257, 16), np.uint16)
    for rank in range(257):
        path = [(0, int(rank == 0))] + [(C.FIRST, int(rank == 1))] * (rank > 0) + (C._rank_path(rank) if rank > 1 else [])
        n[rank] = len(path)
        spelled[rank, : len(path)] = [2 * at + bit for at, bit in path]
        for c in range(C.FIRST):
            own = [2 * (at + (c if k < 2 else 0)) + bit for k, (at, bit) in enumerate(path)]
            for here, there in zip(own, own[1:], strict=False):
                follow[here] = there >> 1
            follow[own[-1]], rank_of[own[-1]] = min(rank, C.FIRST - 1), rank
    return follow, rank_of, n, spelled


FOLLOW, RANK, SPELLS, SPELLED = _paths()


def _groups(sizes: list[int], limit: int) -> list[list[int]]:
    """Numbers of rows in groups of up to `limit` bytes, at least one row."""
    out, held, size = [], [], 0
    for i, n in enumerate(sizes):
        if held and size + n > limit:
            out.append(held)
            held, size = [], 0
        held.append(i)
        size += n
    return [*out, held] if held else out


class _Orders:
    """coder.Ranks of many blocks of one speed, which all are at the same step; blocks are sorted by falling size."""

    def __init__(self, n: int, speed: int):
        self.order = np.tile(np.arange(256, dtype=np.uint8), (n, 1))
        self.flat, self.freq = self.order.reshape(-1), np.zeros((n, C.TRACKED), np.int64)
        self.gain, self.speed, self.column = 4, speed, np.arange(C.TRACKED)

    def move(self, rank: np.ndarray) -> None:
        self.gain += self.gain >> self.speed
        if self.gain > 0x10000000:
            self.gain >>= 24
            self.freq >>= 24
        self.freq[: len(rank), 0] += self.gain * (rank == 0)
        some = rank.nonzero()[0]
        if not len(some):
            return
        rank, freq, each = rank[some], self.freq[some], np.arange(len(some))
        top = np.minimum(rank, C.TRACKED - 1)
        weight = self.gain + np.where(rank < C.TRACKED, freq[each, top], 0)
        to = top.copy()
        for k in range(C.TRACKED - 1, 0, -1):
            to -= (to == k) & (weight >= freq[:, k - 1])
        source = self.column - ((self.column > to[:, None]) & (self.column <= top[:, None]))
        freq = freq[each[:, None], source]
        freq[each, to] = weight
        self.freq[some] = freq
        symbol = self.order[some, rank]
        size = rank - to
        where = np.repeat(some * 256 + to - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        self.flat[where + 1] = self.flat[where]
        self.flat[some * 256 + to] = symbol


    def alone(self, i: int) -> C.Ranks:
        """Block i as it stands, to go on with alone."""
        out = C.Ranks(self.speed)
        out.order, out.freq, out.gain = self.order[i].tolist(), self.freq[i].tolist(), self.gain
        return out


def _falling(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by falling size, and for each step how many are larger than it."""
    order = np.argsort(-sizes, kind="stable")
    return order, len(sizes) - np.searchsorted(np.sort(sizes), np.arange(int(sizes.max(initial=0))), "right")


# --- reading ---------------------------------------------------------------------------------------


class _Reader:
    """coder.Decoder of many streams."""

    def __init__(self, streams: list[bytes]):
        size = np.fromiter(map(len, streams), np.int64, len(streams))
        raw = np.frombuffer(b"".join(x + b"\xff" * 8 for x in streams), np.uint8).astype(np.uint32)
        self.window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        self.begin = np.cumsum(size + 8) - size - 8
        self.end = self.begin + size  # from here on there is only filler
        self.place = self.begin * 8 + 16
        self.a = np.zeros(len(streams), np.int32)
        self.code = (self.window[self.begin] >> 16).astype(np.int32)
        self.states = np.zeros((len(streams), CONTEXTS), np.int64)  # as indices, which are looked up fastest
        self.states[:, RAW] = EVEN

    def running(self, who: np.ndarray) -> list[np.ndarray]:
        return [self.a[who], self.code[who], self.place[who], self.end[who], who * CONTEXTS]

    def store(self, who: np.ndarray, now: list[np.ndarray], which) -> None:
        self.a[who], self.code[who], self.place[who] = (x[which] for x in now[:3])

    def bits(self, now: list[np.ndarray], context) -> np.ndarray:
        a, code, place, end, base = now
        states, slot = self.states.reshape(-1), base + context
        s = states.take(slot)
        z = a + PROB.take(s)
        bit = s & 1
        slow = (z > np.minimum(code, 0x7FFF)).nonzero()[0]
        if len(slow):
            s, was, own, at, split = s.take(slow), a.take(slow), code.take(slow), place.take(slow), z.take(slow)
            split = np.minimum(split, 0x6000 + (split + was >> 2))
            other = split > own
            states[slot.take(slow)] = np.where(other, DOWN.take(s), np.where(was >= LIMIT.take(s), UP.take(s), s))
            rest = (0x10000 - split) * other
            new = np.where(other, was + rest, split)
            n = np.where(other, LEAD.take(new & 0xFFFF), 1)
            come = self.window.take(np.minimum(at >> 3, end.take(slow))) << (at & 7).astype(np.uint32) >> (32 - n).astype(np.uint32)
            z[slow] = new << n & 0xFFFF
            code[slow] = (own + rest) << n & 0xFFFF | come.view(np.int32)
            place[slow] = at + n
            bit[slow] = s & 1 ^ other
        now[0] = z
        return bit

    def numbers(self, who: np.ndarray, bits: int) -> np.ndarray:
        now, n = self.running(who), np.zeros(len(who), np.int64)
        for _ in range(bits):
            n = n << 1 | self.bits(now, RAW)
        self.store(who, now, slice(None))
        return n

    def ranks(self, who: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranks of the next block of each stream, one after the other, and where each block begins."""
        begin = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.int16)
        now, left, to, lane = self.running(who), sizes.copy(), begin.copy(), who
        context = np.full(len(who), C.FIRST - 1, np.int64)
        while len(lane) >= FEW:
            key = 2 * context + self.bits(now, context)
            rank, context = RANK.take(key), FOLLOW.take(key)
            done = rank >= 0
            out[to[done]] = rank[done]
            to += done
            left -= done
            if not left.all():
                over = left == 0
                self.store(lane[over], now, over)
                now, left, to, lane, context = [x[~over] for x in now], left[~over], to[~over], lane[~over], context[~over]
        self.store(lane, now, slice(None))
        for i, n, t, c in zip(lane.tolist(), left.tolist(), to.tolist(), context.tolist(), strict=True):
            out[t : t + n] = self.alone(i, n, c)
        return out, begin

    def alone(self, i: int, left: int, context: int) -> list[int]:
        """The rest of a block of stream i, by the plain decoder."""
        d, out = C.Decoder(b""), []
        begin, end, place = int(self.begin[i]), int(self.end[i]), int(self.place[i])
        words = self.window[begin : end + 1]
        d.data, d.pos = (words >> 24).astype(np.uint8).tobytes()[: end - begin], min((place >> 3) - begin, end - begin)
        d.grace = C.GRACE - max(0, (place >> 3) - end)
        d.a, d.code, d.bits, d.held = int(self.a[i]), int(self.code[i]), 0, 0
        d.refill()
        d.held -= place & 7
        d.fence = min(d.code, 0x7FFF)
        states, bit, follow, rank = bytearray(self.states[i].tolist()), d.bit, FOLLOW.tolist(), RANK.tolist()
        while left:
            key = 2 * context + bit(states, context)
            context = follow[key]
            if rank[key] >= 0:
                out.append(rank[key])
                left -= 1
        self.states[i] = np.frombuffer(bytes(states), np.uint8)
        self.a[i], self.code[i] = d.a, d.code
        self.place[i] = (begin + d.pos + C.GRACE - d.grace) * 8 - d.held
        return out


def _symbols(ranks: np.ndarray, begin: np.ndarray, sizes: np.ndarray, speed: np.ndarray) -> np.ndarray:
    """Ranks to bytes, block by block."""
    out = np.zeros(len(ranks), np.uint8)
    for v in np.unique(speed):
        own = np.flatnonzero(speed == v)
        order, many = _falling(sizes[own])
        at = begin[own[order]]
        orders = _Orders(len(own), int(v))
        each, steps = np.arange(len(own)), int((many >= FEW).sum())
        for step, live in enumerate(many[:steps].tolist()):
            where = at[:live] + step
            rank = ranks[where].astype(np.int64)
            out[where] = orders.order[each[:live], rank]
            orders.move(rank)
        for i in range(int(many[steps]) if steps < len(many) else 0):
            one, rest = orders.alone(i), slice(int(at[i]) + steps, int(at[i] + sizes[own[order[i]]]))
            found = bytearray()
            for rank in ranks[rest].tolist():
                found.append(one.order[rank])
                one.move(rank)
            out[rest] = np.frombuffer(found, np.uint8)
    return out


def _read(streams: list[bytes]) -> list[bytes | None]:
    reader, parts, odd = _Reader(streams), [[] for _ in streams], set()
    who = np.arange(len(streams))
    while len(who):
        sizes = reader.numbers(who, 24)
        odd.update(who[sizes > LARGE].tolist())
        more = (sizes > 0) & (sizes <= LARGE)
        who, sizes = who[more], sizes[more]
        speed = reader.numbers(who, 1)
        fast = np.flatnonzero(speed)
        speed[fast] += reader.numbers(who[fast], 1)
        ranks, begin = reader.ranks(who, sizes)
        marks = np.flatnonzero(ranks == 256)
        block = np.searchsorted(begin, marks, "right") - 1
        marker = np.full(len(who), -1)
        marker[block] = marks - begin[block]
        good = (np.bincount(block, minlength=len(who)) == 1) & (marker >= 1)
        odd.update(who[~good].tolist())
        keep = np.repeat(good, sizes)
        keep[marks] = False
        who, sizes, speed, marker = (x[good] for x in (who, sizes, speed, marker))
        column = _symbols(ranks[keep], np.cumsum(sizes - 1) - sizes + 1, sizes - 1, speed)
        at = 0
        for i, n, m in zip(who.tolist(), (sizes - 1).tolist(), marker.tolist(), strict=True):
            text = C._unsort(np.insert(column[at : at + n], m, 0), m)
            at += n
            if text is None:
                odd.add(i)
            else:
                parts[i].append(text)
        who = np.array([i for i in who.tolist() if i not in odd], np.int64)
    odd.update(np.flatnonzero((reader.place >> 3) > reader.end + BEHIND).tolist())
    return [C.decompress(x) if i in odd else b"".join(p) if p else None for i, (x, p) in enumerate(zip(streams, parts, strict=True))]


def decompress_all(streams: list[bytes | None]) -> list[bytes | None]:
    """coder.decompress of each stream; null stays null."""
    out: list[bytes | None] = [None] * len(streams)
    some = [i for i, x in enumerate(streams) if x is not None]
    for group in _groups([len(streams[i]) for i in some], PACKED):
        own = [some[k] for k in group]
        for i, x in zip(own, _read([bytes(streams[i]) for i in own]), strict=True):
            out[i] = x
    return out


# --- writing ---------------------------------------------------------------------------------------


def _sorted_columns(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The last column of each block's sorted rotations, one after the other, 256 for the marker; and the rows of each block."""
    size = np.fromiter(map(len, blocks), np.int64, len(blocks)) + 1
    text = np.frombuffer(b"\0".join(blocks) + b"\0", np.uint8).astype(np.int64) + 1
    begin = np.cumsum(size) - size
    text[begin + size - 1] = 0
    n, span = len(text), 5
    wide = np.append(text, np.zeros(span, np.int64))
    rank = np.repeat(np.arange(len(blocks)), size)  # five symbols of nine bits behind the block's number
    for i in range(span):
        rank = rank << 9 | wide[i : i + n]
    order = np.argsort(rank)
    key, slots = rank[order], np.arange(n)
    rank = np.zeros(n, np.int64)
    while len(slots):
        new = np.ones(len(slots) + 1, bool)
        new[1:-1] = key[1:] != key[:-1]
        heads = np.flatnonzero(new)
        rank[order[slots]] = np.repeat(slots[heads[:-1]], np.diff(heads))
        slots = slots[~(new[1:] & new[:-1])]  # equal so far: by what follows
        at = order[slots]
        key = rank[at] * (n + 1) + rank[np.minimum(at + span, n - 1)]
        by = np.argsort(key)
        order[slots], key = at[by], key[by]
        span *= 2
    column = text[order - 1] - 1
    column[np.isin(order, begin)] = 256
    return column.astype(np.int16), size


def _spelled(ranks: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The decisions of the blocks' ranks, and their number by block."""
    before = np.append(np.int16(3), ranks[:-1])
    begin = np.cumsum(sizes) - sizes
    before[begin] = 3
    n = SPELLS[ranks]
    each = np.repeat(np.arange(len(ranks)), n)
    k = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
    out = SPELLED[ranks[each], k] + np.where(k < 2, 2 * np.minimum(before, C.FIRST - 1)[each], 0).astype(np.uint16)
    return out, np.add.reduceat(n, begin)


def _ranks(column: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Symbols of blocks to ranks; the marker stays 256."""
    plain = np.flatnonzero(column != 256)
    symbols, n = column[plain].astype(np.uint8), sizes - 1
    order, many = _falling(n)
    at = (np.cumsum(n) - n)[order]
    orders, found, steps = _Orders(len(n), 0), np.zeros(len(symbols), np.int16), int((many >= FEW).sum())
    for step, live in enumerate(many[:steps].tolist()):
        where = at[:live] + step
        symbol = symbols[where]
        rank = np.zeros(live, np.int64)
        some = np.flatnonzero(orders.order[:live, 0] != symbol)
        rank[some] = (orders.order[some] == symbol[some, None]).argmax(1)
        found[where] = rank
        orders.move(rank)
    for i in range(int(many[steps]) if steps < len(many) else 0):
        one, rest, own = orders.alone(i), slice(int(at[i]) + steps, int(at[i] + n[order[i]])), []
        for symbol in symbols[rest].tolist():
            own.append(one.order.index(symbol))
            one.move(own[-1])
        found[rest] = own
    out = np.full(len(column), 256, np.int16)
    out[plain] = found
    return out


def _coded(decisions: list[np.ndarray]) -> list[bytes]:
    """coder.Encoder of many streams. What it drops is all ones, so a stream is the complement of the sum of what it adds, each at its bit."""
    sizes = np.fromiter(map(len, decisions), np.int64, len(decisions))
    order, many = _falling(sizes)
    flat, at = np.concatenate(decisions), (np.cumsum(sizes) - sizes)[order]
    states = np.zeros((len(sizes), CONTEXTS), np.int64)
    states[:, RAW] = EVEN
    states, base = states.reshape(-1), np.arange(len(sizes)) * CONTEXTS
    a, place = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int32 if sizes.max(initial=0) < 1 << 27 else np.int64)
    lanes, places, added = [], [], []
    step = 0
    for step, live in enumerate(many.tolist()):
        if live < FEW:
            break
        own = flat.take(at[:live] + step)
        slot, want = base[:live] + (own >> 1), own & 1
        s = states.take(slot)
        was = a[:live]
        z = was + PROB.take(s)
        other = want != s & 1
        slow = (other | (z >= 0x8000)).nonzero()[0]
        if len(slow):
            s, was, other, split = s.take(slow), was.take(slow), other.take(slow), z.take(slow)
            split = np.minimum(split, 0x6000 + (split + was >> 2))
            states[slot.take(slow)] = np.where(other, DOWN.take(s), np.where(was >= LIMIT.take(s), UP.take(s), s))
            rest = 0x10000 - split
            new = np.where(other, was + rest, split)
            n = np.where(other, LEAD.take(new & 0xFFFF), 1)
            z[slow] = new << n & 0xFFFF
            lane = slow[other]
            lanes.append(lane.astype(np.int32))
            places.append(place.take(lane))
            added.append(rest[other])
            place[slow] += n
        a[:live] = z
    else:
        step = len(many)
    if step < len(many):
        prob, limit, up, down, lead = (x.tolist() for x in (PROB, LIMIT, UP, DOWN, LEAD))
        for i in range(int(many[step])):
            own, x, p, more = states[i * CONTEXTS : (i + 1) * CONTEXTS].tolist(), int(a[i]), int(place[i]), []
            for d in flat[at[i] + step : at[i] + sizes[order[i]]].tolist():
                s = own[d >> 1]
                z = x + prob[s]
                if s & 1 == d & 1 and z < 0x8000:
                    x = z
                    continue
                z = min(z, 0x6000 + (z + x >> 2))
                if s & 1 == d & 1:
                    if x >= limit[s]:
                        own[d >> 1] = up[s]
                    x, n = z, 1
                else:
                    own[d >> 1] = down[s]
                    x += 0x10000 - z
                    more.append((p, 0x10000 - z))
                    n = lead[x]
                x = x << n & 0xFFFF
                p += n
            place[i] = p
            if more:
                lanes.append(np.full(len(more), i, np.int32))
                places.append(np.array([x for x, _ in more], place.dtype))
                added.append(np.array([x for _, x in more], np.int32))
    size = (place.astype(np.int64) + 23) // 8
    begin = np.cumsum(size) - size
    total = np.zeros(int(size.sum()) + 2, np.int64)
    for group in _groups([len(x) for x in lanes], PART):
        own = slice(group[0], group[-1] + 1)
        p = np.concatenate(places[own])
        first = begin[np.concatenate(lanes[own])] + (p >> 3)
        value = np.concatenate(added[own]).astype(np.int64) << 8 - (p & 7)
        for k, x in enumerate((value >> 16, value >> 8 & 0xFF, value & 0xFF)):
            total += np.bincount(first + k, x, len(total)).astype(np.int64)
    while (carry := total >> 8).any():
        total &= 0xFF
        total[:-1] += carry[1:]
    raw = (255 - total).astype(np.uint8).tobytes()
    out = [b""] * len(sizes)
    for i, p, n in zip(order.tolist(), begin.tolist(), size.tolist(), strict=True):
        out[i] = raw[p : p + n]
    return out


def _number(value: int) -> np.ndarray:
    return np.array([2 * RAW + (value >> k & 1) for k in range(23, -1, -1)], np.uint16)


def _write(texts: list[bytes], block: int) -> list[bytes]:
    blocks = [(i, x[k : k + block]) for i, x in enumerate(texts) for k in range(0, len(x), block)]
    columns, sizes = [], []
    for part in _groups([len(x) + 1 for _, x in blocks], PART):
        column, size = _sorted_columns([blocks[k][1] for k in part])
        columns.append(column)
        sizes.append(size)
    decisions: list[list[np.ndarray]] = [[] for _ in texts]
    if blocks:
        size = np.concatenate(sizes)
        ranks, at, done = _ranks(np.concatenate(columns), size), 0, 0
        for part in sizes:
            spelled, n = _spelled(ranks[at : at + int(part.sum())], part)
            at += int(part.sum())
            for own in np.split(spelled, np.cumsum(n)[:-1]):
                i, x = blocks[done]
                decisions[i] += [_number(len(x) + 1), np.array([2 * RAW], np.uint16), own]
                done += 1
    return _coded([np.concatenate([*x, _number(0)]) for x in decisions])


def compress_all(texts: list[bytes], block: int = 1 << 16) -> list[bytes]:
    """coder.compress of each text, for fixtures."""
    return [x for group in _groups([len(x) for x in texts], GROUP) for x in _write([texts[i] for i in group], block)]
