"""Wavelet image layers: progressive coefficient decoding and the inverse transform.

Coefficients of a plane are one int array (blocks, 1024) in bucket order; the transform runs on
whole planes in numpy. Rows are bottom-up, as in the format.
"""

from __future__ import annotations

import numpy as np

from .coder import Decoder

#: First bucket and number of buckets of each band; quantisation steps.
BANDS = ((0, 1), (1, 1), (2, 1), (3, 1), (4, 4), (8, 4), (12, 4), (16, 16), (32, 16), (48, 16))
STEPS = (0x10000, 0x20000, 0x20000, 0x40000, 0x40000, 0x40000, 0x80000, 0x80000, 0x80000, 0x100000, 0x100000, 0x100000, 0x200000, 0x100000, 0x100000, 0x200000)
#: Hardening of our own: samples that one layer may have.
PIXELS = 1 << 26


class Broken(ValueError):
    """The chunk breaks a rule of the format."""


def _places() -> np.ndarray:
    """Where coefficient n of a block lies in its 32 x 32 square: its bits, from the lowest on, are column and row bits in turn, from the highest on."""
    n = np.arange(1024)
    row = sum((n >> 2 * k + 1 & 1) << 4 - k for k in range(5))
    column = sum((n >> 2 * k & 1) << 4 - k for k in range(5))
    return row * 32 + column


PLACES = _places()


class Plane:
    """Coefficients of one plane and the state of their decoding."""

    def __init__(self, width: int, height: int):
        self.width, self.height = width, height
        self.across, self.down = (width + 31) // 32, (height + 31) // 32
        self.blocks = [[None] * 64 for _ in range(self.across * self.down)]
        self.start, self.bucket, self.root, self.mantissa = bytearray(16), bytearray(80), bytearray(1), bytearray(1)
        low = [*STEPS[:4], *[s for s in STEPS[4:7] for _ in range(4)]]
        self.low, self.high = low, [0, *STEPS[7:]]
        while self.low[0] >= 0x8000:
            self.halve()
        self.band, self.done = 0, False

    def halve(self) -> bool:
        self.low, self.high = [x >> 1 for x in self.low], [x >> 1 for x in self.high]
        return any(self.low) or any(self.high)

    def slice(self, coder: Decoder) -> bool:
        """Decode the next slice; says whether more may follow."""
        if self.done:
            return False
        steps = self.low if self.band == 0 else [self.high[self.band]] * 16
        if any(0 < t < 0x8000 for t in steps):
            for block in self.blocks:
                self.decode(coder, block, steps)
        self.band += 1
        if self.band == len(BANDS):
            self.band = 0
            self.done = not self.halve()
        return not self.done

    def decode(self, coder: Decoder, block: list, steps: list[int]) -> None:
        first, count = BANDS[self.band]
        bit = coder.bit
        live = [0 < t < 0x8000 for t in steps]
        # per bucket: which coefficients are known, which may still become so
        known = [[] if block[first + k] is None else [i for i in range(16) if live[i] and block[first + k][i]] for k in range(count)]
        fresh = [[i for i in range(16) if live[i] and (block[first + k] is None or not block[first + k][i])] for k in range(count)]
        if self.band:
            live = [True] * 16
        any_known, any_fresh = any(known), any(block[first + k] is None or fresh[k] for k in range(count))
        if count < 16 or any_known:
            go = True
        else:
            go = any_fresh and bool(bit(self.root, 0))
        if go:
            chosen = []
            for k in range(count):
                if block[first + k] is not None and not fresh[k]:
                    continue
                context = 0
                if self.band:
                    at = first + k << 2
                    parent = block[at >> 4]
                    if parent is not None:
                        context = min(3, sum(parent[j] != 0 for j in range(at & 15, (at & 15) + 4)))
                if any_known:
                    context |= 4
                if bit(self.bucket, self.band * 8 + context):
                    chosen.append(k)
            for k in chosen:
                if block[first + k] is None:
                    block[first + k] = [0] * 16
                values, waiting = block[first + k], len(fresh[k])
                for i in fresh[k]:
                    if bit(self.start, min(waiting, 7) | (8 if known[k] else 0)):
                        half = steps[i] >> 1
                        value = steps[i] + half - (half >> 2)
                        values[i] = _short(-value if coder.raw_wavelet() else value)
                        waiting = 0
                    elif waiting:
                        waiting -= 1
        for k in range(count):
            values = block[first + k]
            for i in known[k]:
                size, t = abs(values[i]), steps[i]
                if size <= 3 * t:
                    size += t >> 2
                    up = bit(self.mantissa, 0)
                else:
                    up = coder.raw_wavelet()
                size += (t >> 1) if up else (t >> 1) - t
                values[i] = _short(-size if values[i] < 0 else size)

    def coefficients(self) -> np.ndarray:
        flat = np.zeros((len(self.blocks), 1024), np.int16)
        for b, block in enumerate(self.blocks):
            for k, values in enumerate(block):
                if values is not None:
                    flat[b, 16 * k : 16 * k + 16] = values
        out = np.zeros_like(flat)
        out[:, PLACES] = flat
        return out.reshape(self.down, self.across, 32, 32).swapaxes(1, 2).reshape(self.down * 32, self.across * 32)

    def samples(self, half: bool = False) -> np.ndarray:
        """Signed 8-bit samples; half: the finest scale is left out and pixels repeat."""
        if not any(v is not None for block in self.blocks for v in block):
            return np.zeros((self.height, self.width), np.int8)  # an even plane needs no transform
        data = self.coefficients()
        inverse(data[: self.height, : self.width], 2 if half else 1)
        if half:
            data = np.repeat(np.repeat(data[::2, ::2], 2, 0), 2, 1)
        return np.clip(data[: self.height, : self.width].astype(np.int32) + 32 >> 6, -128, 127).astype(np.int8)


def _short(x: int) -> int:
    return (x + 0x8000 & 0xFFFF) - 0x8000


def lift(v: np.ndarray) -> None:
    """One inverse filter along axis 0, in place: even rows lose a prediction from odd neighbours, then odd rows gain one from even neighbours."""
    n = len(v)
    wide = np.zeros((n + 6, *v.shape[1:]), np.int32)
    wide[3 : 3 + n] = v
    even = np.arange(0, n, 2) + 3
    near, far = wide[even - 1] + wide[even + 1], wide[even - 3] + wide[even + 3]
    wide[even] = (wide[even] - (9 * near - far + 16 >> 5)).astype(np.int16)
    odd = np.arange(1, n, 2)
    if len(odd):
        at = odd + 3
        after = np.where(odd + 1 < n, at + 1, at - 1)
        edge = wide[at - 1] + wide[after] + 1 >> 1
        near, far = wide[at - 1] + wide[at + 1], wide[at - 3] + wide[at + 3]
        inner = (odd >= 3) & (odd + 3 < n)
        smooth = 9 * near - far + 8 >> 4
        gain = np.where(inner.reshape(-1, *[1] * (v.ndim - 1)), smooth, edge)
        wide[at] = (wide[at] + gain).astype(np.int16)
    v[:] = wide[3 : 3 + n]


def inverse(data: np.ndarray, least: int = 1) -> None:
    """The inverse transform in place, from scale 16 down to `least`: columns, then rows, at each."""
    scale = 16
    while scale >= least:
        part = data[::scale, ::scale]
        lift(part)
        lift(part.T)
        scale >>= 1


class Pixmap:
    """A layer: chunks in order, then planes or pixels."""

    def __init__(self):
        self.serial = self.slices = self.width = self.height = 0
        self.delay, self.half = 10, False
        self.planes: list[Plane] = []

    def add(self, chunk: bytes) -> None:
        if len(chunk) < 2:
            raise Broken("short chunk")
        if chunk[0] != self.serial:
            raise Broken("out of order")
        at, until = 2, self.slices + chunk[1]
        if self.serial == 0:
            if len(chunk) < 8:
                raise Broken("short header")
            major, minor = chunk[2], chunk[3]
            if major & 0x7F != 1:
                raise Broken("version")
            self.width, self.height = int.from_bytes(chunk[4:6], "big"), int.from_bytes(chunk[6:8], "big")
            at = 8
            if minor >= 2:
                if len(chunk) < 9:
                    raise Broken("short header")
                self.delay, self.half, at = chunk[8] & 0x7F, not chunk[8] & 0x80, 9
            if not 0 < self.width * self.height <= PIXELS:
                raise Broken("size")
            self.planes = [Plane(self.width, self.height) for _ in range(1 if major & 0x80 else 3)]
        coder, more = Decoder(chunk[at:]), True
        while more and self.slices < until:
            more = self.planes[0].slice(coder)
            if len(self.planes) == 3 and self.delay <= self.slices:
                for p in self.planes[1:]:
                    more |= p.slice(coder)
            self.slices += 1
        self.serial += 1

    def plane(self, which: int) -> np.ndarray:
        """Plane 0, 1 or 2 as grey, value + 128, bottom row first."""
        return (self.planes[which].samples(which > 0 and self.half).astype(np.int16) + 128).astype(np.uint8)

    def rgb(self) -> np.ndarray:
        """Bottom-up pixels (height, width, 3)."""
        y = self.planes[0].samples()
        if len(self.planes) == 1:
            return np.repeat((127 - y.astype(np.int16)).clip(0, 255).astype(np.uint8)[..., None], 3, 2)
        return ycbcr_to_rgb(y, *(p.samples(self.half) for p in self.planes[1:]))

    def gray(self) -> np.ndarray:
        """Top-down grey plane, value + 128."""
        return self.plane(0)[::-1]


def ycbcr_to_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    y, cb, cr = (x.astype(np.int32) for x in (y, cb, cr))
    light, red = y + 128 - (cb >> 2), cr + (cr >> 1)
    return np.stack([y + 128 + red, light - (red >> 1), light + 2 * cb], -1).clip(0, 255).astype(np.uint8)


def decode(chunks: list[bytes], most: int = 0) -> Pixmap:
    """A layer from its chunks, only the first `most` of them if that is positive. Raises Broken."""
    layer = Pixmap()
    for c in chunks[: most or None]:
        layer.add(c)
    if not layer.planes:
        raise Broken("no chunk")
    return layer
