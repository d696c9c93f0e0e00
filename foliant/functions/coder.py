"""The adaptive binary coder of layered documents, and its block-sorting byte compressor.

Decoding a stream is serial by nature, so one stream is decoded in one call; `Decoder` keeps all
state in plain integers. The encoders exist for fixtures and tests only: they search, symbol by
symbol, the code values that the decoder's own interval arithmetic accepts.
"""

from __future__ import annotations

import numpy as np

# The format's 256 states in two tables, as they are of two kinds: of the steady ones each row stands
# for a pair of states whose successors follow a rule, so only two numbers a pair are kept; of the
# learning ones every successor is given, and they have no threshold.
#: Fixed values: (probability, adaptation threshold) of the steady states, from the least certain on.
STEADY = (
    (0x8000, 0x0000), (0x6BBD, 0x10A5), (0x5D45, 0x1F28), (0x51B9, 0x2BD3), (0x4813, 0x36E3), (0x3FD5, 0x408C), (0x38B1, 0x48FD), (0x3275, 0x505D),
    (0x2CFD, 0x56D0), (0x2825, 0x5C71), (0x23AB, 0x615B), (0x1F87, 0x65A5), (0x1BBB, 0x6962), (0x1845, 0x6CA2), (0x1523, 0x6F74), (0x1253, 0x71E6),
    (0x0FCF, 0x7404), (0x0D95, 0x75D6), (0x0B9D, 0x7768), (0x09E3, 0x78C2), (0x0861, 0x79EA), (0x0711, 0x7AE7), (0x05F1, 0x7BBE), (0x04F9, 0x7C75),
    (0x0425, 0x7D0F), (0x0371, 0x7D91), (0x02D9, 0x7DFE), (0x0259, 0x7E5A), (0x01ED, 0x7EA6), (0x0193, 0x7EE6), (0x0149, 0x7F1A), (0x010B, 0x7F45),
    (0x00D5, 0x7F6B), (0x00A5, 0x7F8D), (0x007B, 0x7FAA), (0x0057, 0x7FC3), (0x003B, 0x7FD7), (0x0023, 0x7FE7), (0x0013, 0x7FF2), (0x0007, 0x7FFA),
    (0x0001, 0x7FFF),
)
#: Fixed values: (probability, state after the likely symbol, state after the other) of the learning states, from state 83 on.
LEARNING = (
    (0x5695, 9, 85), (0x24EE, 86, 226), (0x8000, 5, 6), (0x0D30, 88, 176), (0x481A, 89, 143), (0x0481, 90, 138), (0x3579, 91, 141), (0x017A, 92, 112),
    (0x24EF, 93, 135), (0x007B, 94, 104), (0x1978, 95, 133), (0x0028, 96, 100), (0x10CA, 97, 129), (0x000D, 82, 98), (0x0B5D, 99, 127), (0x0034, 76, 72),
    (0x078A, 101, 125), (0x00A0, 70, 102), (0x050F, 103, 123), (0x0117, 66, 60), (0x0358, 105, 121), (0x01EA, 106, 110), (0x0234, 107, 119), (0x0144, 66, 108),
    (0x0173, 109, 117), (0x0234, 60, 54), (0x00F5, 111, 115), (0x0353, 56, 48), (0x00A1, 69, 113), (0x05C5, 114, 134), (0x011A, 65, 59), (0x03CF, 116, 132),
    (0x01AA, 61, 55), (0x0285, 118, 130), (0x0286, 57, 51), (0x01AB, 120, 128), (0x03D3, 53, 47), (0x011A, 122, 126), (0x05C5, 49, 41), (0x00BA, 124, 62),
    (0x08AD, 43, 37), (0x007A, 72, 66), (0x0CCC, 39, 31), (0x01EB, 60, 54), (0x1302, 33, 25), (0x02E6, 56, 50), (0x1B81, 29, 131), (0x045E, 52, 46),
    (0x24EF, 23, 17), (0x0690, 48, 40), (0x2865, 23, 15), (0x09DE, 42, 136), (0x3987, 137, 7), (0x0DC8, 38, 32), (0x2C99, 21, 139), (0x10CA, 140, 172),
    (0x3B5F, 15, 9), (0x0B5D, 142, 170), (0x5695, 9, 85), (0x078A, 144, 168), (0x8000, 141, 248), (0x050F, 146, 166), (0x24EE, 147, 247), (0x0358, 148, 164),
    (0x0D30, 149, 197), (0x0234, 150, 162), (0x0481, 151, 95), (0x0173, 152, 160), (0x017A, 153, 173), (0x00F5, 154, 158), (0x007B, 155, 165), (0x00A1, 70, 156),
    (0x0028, 157, 161), (0x011A, 66, 60), (0x000D, 81, 159), (0x01AA, 62, 56), (0x0034, 75, 71), (0x0286, 58, 52), (0x00A0, 69, 163), (0x03D3, 54, 48),
    (0x0117, 65, 59), (0x05C5, 50, 42), (0x01EA, 167, 171), (0x08AD, 44, 38), (0x0144, 65, 169), (0x0CCC, 40, 32), (0x0234, 59, 53), (0x1302, 34, 26),
    (0x0353, 55, 47), (0x1B81, 30, 174), (0x05C5, 175, 193), (0x24EF, 24, 18), (0x03CF, 177, 191), (0x2B74, 178, 222), (0x0285, 179, 189), (0x201D, 180, 218),
    (0x01AB, 181, 187), (0x1715, 182, 216), (0x011A, 183, 185), (0x0FB7, 184, 214), (0x00BA, 69, 61), (0x0A67, 186, 212), (0x01EB, 59, 53), (0x06E7, 188, 210),
    (0x02E6, 55, 49), (0x0496, 190, 208), (0x045E, 51, 45), (0x030D, 192, 206), (0x0690, 47, 39), (0x0206, 194, 204), (0x09DE, 41, 195), (0x0155, 196, 202),
    (0x0DC8, 37, 31), (0x00E1, 198, 200), (0x2B74, 199, 243), (0x0094, 72, 64), (0x201D, 201, 239), (0x0188, 62, 56), (0x1715, 203, 237), (0x0252, 58, 52),
    (0x0FB7, 205, 235), (0x0383, 54, 48), (0x0A67, 207, 233), (0x0547, 50, 44), (0x06E7, 209, 231), (0x07E2, 46, 38), (0x0496, 211, 229), (0x0BC0, 40, 34),
    (0x030D, 213, 227), (0x1178, 36, 28), (0x0206, 215, 225), (0x19DA, 30, 22), (0x0155, 217, 223), (0x24EF, 26, 16), (0x00E1, 219, 221), (0x320E, 20, 220),
    (0x0094, 71, 63), (0x432A, 14, 8), (0x0188, 61, 55), (0x447D, 14, 224), (0x0252, 57, 51), (0x5ECE, 8, 2), (0x0383, 53, 47), (0x8000, 228, 87),
    (0x0547, 49, 43), (0x481A, 230, 246), (0x07E2, 45, 37), (0x3579, 232, 244), (0x0BC0, 39, 33), (0x24EF, 234, 238), (0x1178, 35, 27), (0x1978, 138, 236),
    (0x19DA, 29, 21), (0x2865, 24, 16), (0x24EF, 25, 15), (0x3987, 240, 8), (0x320E, 19, 241), (0x2C99, 22, 242), (0x432A, 13, 7), (0x3B5F, 16, 10),
    (0x447D, 13, 245), (0x5695, 10, 2), (0x5ECE, 7, 1), (0x8000, 244, 83), (0x8000, 249, 250), (0x5695, 10, 2), (0x481A, 89, 143), (0x481A, 230, 246),
)


def _states() -> tuple[list[int], list[int], list[int], list[int]]:
    """Probability, threshold, next state after the likely symbol and after the other, by state.

    The lowest bit of a state is its likely bit. Steady states come in pairs and move two up or
    down; the last pair stays, and the first crosses over.
    """
    p, m, up, down = [0x8000], [0], [84], [145]
    for i, (prob, limit) in enumerate(STEADY):
        for s in (2 * i + 1, 2 * i + 2):
            p.append(prob)
            m.append(limit)
            up.append(min(s + 2, 81 + (s + 1) % 2))
            down.append(s - 2 if s > 2 else 5 - s)
    for prob, a, b in LEARNING:
        p.append(prob)
        m.append(0)
        up.append(a)
        down.append(b)
    fill = 256 - len(p)
    return p + [0] * fill, m + [0] * fill, up + [0] * fill, down + [0] * fill


P, M, UP, DOWN = _states()
#: Ones that lead a byte.
ONES = [next((k for k in range(8) if not b & 0x80 >> k), 8) for b in range(256)]
#: Bytes of filler that may be read past the end before the stream counts as over.
GRACE = 25


class Decoder:
    """Bits of one coded stream. A context is an index into a bytearray of states that the caller keeps."""

    __slots__ = ("data", "pos", "a", "code", "fence", "bits", "held", "grace", "over")

    def __init__(self, data: bytes):
        self.data, self.pos = data, 2
        first = data[0] if len(data) > 0 else 0xFF
        second = data[1] if len(data) > 1 else 0xFF
        self.a, self.code = 0, first << 8 | second
        self.bits = self.held = 0
        self.grace, self.over = GRACE, False
        self.refill()
        self.fence = min(self.code, 0x7FFF)

    def refill(self) -> None:
        while self.held <= 24:
            if self.pos < len(self.data):
                b = self.data[self.pos]
                self.pos += 1
            else:
                b = 0xFF
                self.grace -= 1
                if self.grace < 1:
                    self.over = True
            self.bits = (self.bits << 8 | b) & 0xFFFFFFFF
            self.held += 8

    def shift(self, n: int) -> None:
        self.held -= n
        self.a = self.a << n & 0xFFFF
        self.code = self.code << n & 0xFFFF | self.bits >> self.held & (1 << n) - 1
        if self.held < 16:
            self.refill()
        self.fence = min(self.code, 0x7FFF)

    def split(self, z: int, likely: int) -> int:
        """Take the symbol at an interval end z, known to lie beyond the fence."""
        if z > self.code:
            rest = 0x10000 - z
            self.a += rest
            self.code += rest
            a = self.a
            self.shift(ONES[a >> 8 & 0xFF] if a < 0xFF00 else ONES[a & 0xFF] + 8)
            return likely ^ 1
        self.a = z
        self.shift(1)
        return likely

    def bit(self, states: bytearray, at: int) -> int:
        s = states[at]
        z = self.a + P[s]
        if z <= self.fence:
            self.a = z
            return s & 1
        z = min(z, 0x6000 + (z + self.a >> 2))
        if z <= self.code:
            if self.a >= M[s]:
                states[at] = UP[s]
        else:
            states[at] = DOWN[s]
        return self.split(z, s & 1)

    def raw(self) -> int:
        """A bit without a context."""
        return self.split(0x8000 + (self.a >> 1), 0)

    def raw_wavelet(self) -> int:
        return self.split(0x8000 + (3 * self.a >> 3), 0)

    def number(self, bits: int) -> int:
        n = 1
        for _ in range(bits):
            n = n << 1 | self.raw()
        return n - (1 << bits)


class Encoder:
    """The inverse of Decoder, for fixtures and tests.

    The decoder keeps a <= code < 0x10000, adds to both when the unlikely symbol comes, and drops
    one leading 1 at each shift. All this is linear in the code bits, so the sum of what was added
    and dropped, kept as one exact integer, gives the stream for any last code, here 0xffff.
    """

    def __init__(self):
        self.a = self.total = self.places = 0

    def shift(self, n: int) -> None:
        self.a = self.a << n & 0xFFFF
        self.total = (self.total << n) + 0x10000 * ((1 << n) - 1)
        self.places += n

    def split(self, z: int, unlikely: bool) -> None:
        if unlikely:
            self.a += 0x10000 - z
            self.total -= 0x10000 - z
            a = self.a
            self.shift(ONES[a >> 8 & 0xFF] if a < 0xFF00 else ONES[a & 0xFF] + 8)
        else:
            self.a = z
            self.shift(1)

    def bit(self, states: bytearray, at: int, value: int) -> int:
        s = states[at]
        z = self.a + P[s]
        if value == s & 1 and z < 0x8000:
            self.a = z
            return value
        z = min(z, 0x6000 + (z + self.a >> 2))
        if value != s & 1:
            states[at] = DOWN[s]
        elif self.a >= M[s]:
            states[at] = UP[s]
        self.split(z, value != s & 1)
        return value

    def raw(self, value: int) -> int:
        self.split(0x8000 + (self.a >> 1), value != 0)
        return value

    def number(self, bits: int, value: int) -> int:
        for k in range(bits - 1, -1, -1):
            self.raw(value >> k & 1)
        return value

    def finish(self) -> bytes:
        n = self.places + 16
        fill = -n % 8
        return ((self.total + 0xFFFF) << fill | (1 << fill) - 1).to_bytes((n + fill) // 8, "big")


#: Largest block, ranks whose frequency is tracked, contexts of the first two decisions.
BLOCK, TRACKED, FIRST = 4096 * 1024, 4, 3


class Ranks:
    """Move-to-front order that takes frequency into account."""

    def __init__(self, speed: int):
        self.order, self.freq, self.gain, self.speed = list(range(256)), [0] * TRACKED, 4, speed

    def move(self, rank: int) -> None:
        self.gain += self.gain >> self.speed
        if self.gain > 0x10000000:
            self.gain >>= 24
            self.freq = [f >> 24 for f in self.freq]
        weight = self.gain + (self.freq[rank] if rank < TRACKED else 0)
        to = min(rank, TRACKED - 1)
        while to > 0 and weight >= self.freq[to - 1]:
            to -= 1
        self.order.insert(to, self.order.pop(rank))
        if to < rank:
            self.freq[to + 1 : min(rank, TRACKED - 1) + 1] = self.freq[to : min(rank, TRACKED - 1)]
        self.freq[to] = weight


def _rank_path(rank: int) -> list[tuple[int, int]]:
    """The decisions (context, bit) that lead to a rank of 2 or more; 256 stands for the end marker."""
    at, path = 2 * FIRST, []
    for k in range(1, 8):
        if rank < 2 << k:
            path.append((at, 1))
            n = 1
            for b in range(k - 1, -1, -1):
                bit = rank - (1 << k) >> b & 1
                path.append((at + n, bit))
                n = n << 1 | bit
            return path
        path.append((at, 0))
        at += 1 << k
    return path


def decompress(data: bytes) -> bytes | None:
    """The bytes of a block-sorted stream; None if any block is corrupt, and for the empty stream."""
    coder, states, out = Decoder(data), bytearray(384), []
    bit = coder.bit
    while size := coder.number(24):
        if size > BLOCK:
            return None
        speed = coder.raw() and 1 + coder.raw()
        ranks, column, marker, rank = Ranks(speed), np.zeros(size, np.uint8), -1, 3
        for i in range(size):
            if coder.over and coder.grace < -64 * 1024:  # nothing but filler for long: no block of this size can end well
                return None
            c = min(rank, FIRST - 1)
            if bit(states, c):
                rank = 0
            elif bit(states, FIRST + c):
                rank = 1
            else:
                at, rank = 2 * FIRST, 256
                for k in range(1, 8):
                    if bit(states, at):
                        n = 1
                        for _ in range(k):
                            n = n << 1 | bit(states, at + n)
                        rank = n
                        break
                    at += 1 << k
                if rank == 256:
                    marker = i
                    continue
            column[i] = ranks.order[rank]
            ranks.move(rank)
        text = _unsort(column, marker)
        if text is None:
            return None
        out.append(text)
    return b"".join(out) if out else None


def blockless(data: bytes) -> bool:
    """Whether a stream says that it ends before its first block, as that of an empty text does."""
    return len(data) > 0 and Decoder(data).number(24) == 0


def _unsort(column: np.ndarray, marker: int) -> bytes | None:
    """Invert the transform: the column's stable order by byte says where each row's neighbour is."""
    size = len(column)
    if not 1 <= marker < size:
        return None
    keys = column.astype(np.int16)
    keys[marker] = -1
    after = np.empty(size, np.int64)
    after[np.argsort(keys, kind="stable")] = np.arange(size)
    step, symbols = after.tolist(), column.tobytes()
    text, row = bytearray(size - 1), 0
    for i in range(size - 2, -1, -1):
        text[i] = symbols[row]
        row = step[row]
    return bytes(text) if row == marker else None


def compress(data: bytes, block: int = 1 << 16) -> bytes:
    """A block-sorted stream, for fixtures."""
    coder, states = Encoder(), bytearray(384)
    for start in range(0, len(data), block):
        part = data[start : start + block]
        order = [len(part), *sorted(range(len(part)), key=lambda i: part[i:])]
        coder.number(24, len(part) + 1)
        coder.raw(0)
        ranks, rank = Ranks(0), 3
        for i in order:
            c = min(rank, FIRST - 1)
            rank = ranks.order.index(part[i - 1]) if i else 256
            coder.bit(states, c, rank == 0)
            if rank == 0:
                pass
            elif coder.bit(states, FIRST + c, rank == 1):
                pass
            else:
                for at, b in _rank_path(rank):
                    coder.bit(states, at, b)
            if i:
                ranks.move(rank)
    coder.number(24, 0)
    return coder.finish()
