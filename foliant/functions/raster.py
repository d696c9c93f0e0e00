"""Pixel kernels: runs, coverage, scaling, stencils, gamma and page rendering, in numpy.

Inside, rows are bottom-up; `finish` turns them over.
"""

from __future__ import annotations

import numpy as np

from . import jb2

#: Longest one-byte and longest two-byte run of a packed bitmap.
SHORT, LONG = 0xC0, 0x3FFF


def runs(bitmap: np.ndarray) -> np.ndarray:
    """Rows (y, x0, x1) of ink, half open, row by row from the bottom."""
    wide = np.zeros((bitmap.shape[0], bitmap.shape[1] + 2), np.int8)
    wide[:, 1:-1] = bitmap > 0
    step = np.diff(wide, axis=1)
    y, x0 = np.nonzero(step == 1)
    _, x1 = np.nonzero(step == -1)
    return np.stack([y, x0, x1], 1)


def pack(bitmap: np.ndarray) -> bytes:
    """Runs of white and ink in turn, each row from white, top row first."""
    out = bytearray()
    for row in bitmap[::-1]:
        ends = np.flatnonzero(np.diff(np.concatenate([[0], row, [2]]).astype(np.int8)))
        for n in np.diff(np.concatenate([[0], ends])).tolist():
            while n > LONG:
                out += bytes([0xFF, 0xFF, 0])
                n -= LONG
            out += bytes([n]) if n < SHORT else bytes([SHORT | n >> 8, n & 0xFF])
    return bytes(out)


def unpack(data: bytes, width: int, height: int) -> np.ndarray:
    bitmap = np.zeros((height, width), np.uint8)
    i = 0
    for y in range(height - 1, -1, -1):
        x, ink = 0, 0
        while x < width and i < len(data):
            n = data[i]
            i += 1
            if n >= SHORT:
                n = (n & 0x3F) << 8 | (data[i] if i < len(data) else 0)
                i += 1
            if ink:
                bitmap[y, x : x + n] = 1
            x, ink = x + n, ink ^ 1
    return bitmap


def placed_runs(image: jb2.Image):
    """(blit number, rows (y, x0, x1) on the page, unclipped) in order."""
    cache: dict[int, np.ndarray] = {}
    for i, (left, bottom, number) in enumerate(image.blits):
        if number not in cache:
            shape = image.shape(number)
            cache[number] = np.zeros((0, 3), np.int64) if shape is None else runs(shape)
        yield i, cache[number] + np.array([bottom, left, left])


def clipped(r: np.ndarray, width: int, height: int) -> np.ndarray:
    r = r[(r[:, 0] >= 0) & (r[:, 0] < height)]
    r = np.stack([r[:, 0], r[:, 1].clip(0, width), r[:, 2].clip(0, width)], 1)
    return r[r[:, 1] < r[:, 2]]


def counts(r: np.ndarray, width: int, height: int) -> np.ndarray:
    """How many of the runs lie on each pixel."""
    delta = np.zeros((height, width + 1), np.int32)
    np.add.at(delta, (r[:, 0], r[:, 1]), 1)
    np.add.at(delta, (r[:, 0], r[:, 2]), -1)
    return np.cumsum(delta, 1)[:, :width]


def cells(pixels: np.ndarray, sub: int) -> np.ndarray:
    """Sums over sub x sub cells counted from the bottom left; the last ones may be partial."""
    rows = np.add.reduceat(pixels, np.arange(0, pixels.shape[0], sub), 0)
    return np.add.reduceat(rows, np.arange(0, pixels.shape[1], sub), 1)


def coverage_gray(count: np.ndarray, sub: int) -> np.ndarray:
    """Grey of ink counts, saturating at a byte, against a full cell."""
    full = min(sub * sub, 255)
    return (255 - np.minimum(np.minimum(count, 255), full) * 255 // full).astype(np.uint8)


def bitonal(image: jb2.Image, sub: int = 1) -> np.ndarray:
    """Top-down grey of a mask, ink 0 on 255; overlapping placements count twice in cells."""
    w, h = image.width, image.height
    every = [clipped(r, w, h) for _, r in placed_runs(image)]
    count = counts(np.concatenate([*every, np.zeros((0, 3), np.int64)]), w, h)
    if sub <= 1:
        return np.where(count > 0, 0, 255).astype(np.uint8)[::-1]
    return coverage_gray(cells(count, sub), sub)[::-1]


def reduction(w: int, h: int, rw: int, rh: int) -> int:
    """The least factor up to 15 that takes w x h to rw x rh, rounded up; 0 if there is none."""
    return next((r for r in range(1, 16) if -(-w // r) == rw and -(-h // r) == rh), 0)


def coordinates(limit: int, count: int, source: int, target: int) -> np.ndarray:
    """Source places, in sixteenths, of `count` target samples at the ratio target / source.

    The running remainder of the recurrence has a closed form: after x steps, target // 2 + 16 source x.
    """
    step = 16 * source
    first = (step + target) // (2 * target) - 8
    return np.minimum(first + (target // 2 + step * np.arange(count, dtype=np.int64)) // target, (limit - 1) * 16)


def _shrink(pixels: np.ndarray, kx: int, ky: int) -> np.ndarray:
    """Averages of 2**kx x 2**ky cells, rounded; partial cells by what they have."""
    total = np.add.reduceat(np.add.reduceat(pixels.astype(np.int64), np.arange(0, pixels.shape[0], 1 << ky), 0), np.arange(0, pixels.shape[1], 1 << kx), 1)
    n = np.outer(np.diff(np.append(np.arange(0, pixels.shape[0], 1 << ky), pixels.shape[0])), np.diff(np.append(np.arange(0, pixels.shape[1], 1 << kx), pixels.shape[1])))[..., None]
    return ((total + n // 2) // n).astype(np.uint8)


def scale(pixels: np.ndarray, width: int, height: int, numerator: int, denominator: int) -> np.ndarray:
    """Bilinear scaling by a rational factor, in sixteenths, rows first; large reductions halve by averages beforehand."""
    h, w = pixels.shape[:2]
    k, n = 0, numerator
    while 2 * n < denominator:
        k, n = k + 1, 2 * n
    if k:
        pixels = _shrink(pixels, k, k)
        h, w = pixels.shape[:2]
    v = coordinates(h, height, denominator, n)
    u = coordinates(w, width, denominator, n)
    x = pixels.astype(np.int32)
    low, high = x[(v >> 4).clip(0, h - 1)], x[((v >> 4) + 1).clip(0, h - 1)]
    x = low + ((high - low) * (v & 15)[:, None, None] + 8 >> 4)
    low, high = x[:, (u >> 4).clip(0, w - 1)], x[:, ((u >> 4) + 1).clip(0, w - 1)]
    return (low + ((high - low) * (u & 15)[None, :, None] + 8 >> 4)).astype(np.uint8)


def gamma_table(gamma: float) -> np.ndarray:
    power = min(max(2.2 / gamma, 0.1), 10.0)
    i = np.arange(256)
    if 0.999 < power < 1.001:
        return i.astype(np.uint8)
    out = np.floor(255 * (i / 255) ** (1 / power) + 0.5).clip(0, 255).astype(np.uint8)
    out[0], out[255] = 0, 255
    return out


def colour_of(i: int, palette: np.ndarray | None, indices: np.ndarray | None) -> np.ndarray | None:
    """The palette colour of placement i, if it has one."""
    if palette is None or indices is None or i >= len(indices) or not 0 <= indices[i] < len(palette):
        return None
    return palette[indices[i]]


def stencil(page: np.ndarray, mask: jb2.Image, width: int, height: int, sub: int, palette: np.ndarray | None, indices: np.ndarray | None, front: np.ndarray | None) -> None:
    """Paint a mask's placements, in order, onto bottom-up pixels of the page reduced by sub."""
    black, ratio = np.zeros(3, np.uint8), 1
    if front is not None:
        ratio = reduction(width, height, front.shape[1], front.shape[0]) or 1
    for i, r in placed_runs(mask):
        r = clipped(r, width, height)
        if not len(r):
            continue
        colour = colour_of(i, palette, indices)
        flat = colour if colour is not None else black
        sample = front is not None and colour is None
        if sub == 1:
            for y, x0, x1 in r.tolist():
                if sample:
                    page[y, x0:x1] = front[min(y // ratio, front.shape[0] - 1), np.minimum(np.arange(x0, x1) // ratio, front.shape[1] - 1)]
                else:
                    page[y, x0:x1] = flat
            continue
        x0, y0 = int(r[:, 1].min()) // sub * sub, int(r[:, 0].min()) // sub * sub
        own = r - np.array([y0, x0, x0])
        w, h = min(-(-int(own[:, 2].max()) // sub) * sub, width - x0), min((int(own[:, 0].max()) // sub + 1) * sub, height - y0)
        count = cells(counts(own, w, h), sub)
        gy, gx = np.arange(count.shape[0]) + y0 // sub, np.arange(count.shape[1]) + x0 // sub
        area = np.outer(np.minimum(sub, height - gy * sub), np.minimum(sub, width - gx * sub))
        alpha = np.where(count >= area, 255, count * 255 // area)[..., None].astype(np.int64)
        paint = front[np.minimum((gy * sub + sub // 2) // ratio, front.shape[0] - 1)][:, np.minimum((gx * sub + sub // 2) // ratio, front.shape[1] - 1)] if sample else flat
        below = page[gy[0] : gy[-1] + 1, gx[0] : gx[-1] + 1]
        below[:] = (below * (255 - alpha) + paint.astype(np.int64) * alpha + 127) // 255


def finish(page: np.ndarray, gamma: float = 2.2, swap: bool = False) -> np.ndarray:
    """Top-down pixels through the gamma table, red and blue swapped on request."""
    out = gamma_table(gamma)[page[::-1]]
    return out[..., ::-1] if swap else out


def turn(page: np.ndarray, rotation: int) -> np.ndarray:
    """Quarter turns clockwise: three for 90, two for 180, one for 270."""
    return np.rot90(page, -{90: 3, 180: 2, 270: 1}.get(rotation, 0))


def pnm(page: np.ndarray) -> bytes:
    kind = b"P5" if page.ndim == 2 else b"P6"
    return kind + b"\n%d %d\n255\n" % (page.shape[1], page.shape[0]) + np.ascontiguousarray(page).tobytes()


def read_pnm(data: bytes) -> np.ndarray:
    """Pixels of a binary grey or colour map of depth 255; comments in the header are skipped."""
    fields, i = [], 0
    while len(fields) < 4:
        while data[i : i + 1].isspace():
            i += 1
        if data[i : i + 1] == b"#":
            i = data.index(b"\n", i) + 1
            continue
        j = i
        while j < len(data) and not data[j : j + 1].isspace():
            j += 1
        if i == j:
            raise ValueError("short header")
        fields.append(data[i:j])
        i = j
    kind, w, h, top = fields[0], *map(int, fields[1:])
    if kind not in (b"P5", b"P6") or top != 255:
        raise ValueError("not a binary map of depth 255")
    shape = (h, w) if kind == b"P5" else (h, w, 3)
    return np.frombuffer(data, np.uint8, int(np.prod(shape)), i + 1).reshape(shape)
