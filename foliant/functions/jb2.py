"""Bitonal shapes and placements of a page, from its coded record stream.

Bitmaps are numpy arrays, row 0 at the bottom, as in the format. Every primitive below works in
both directions: with a Decoder it returns what the stream says; with an Encoder it writes the
value given. Pages only decode; the other direction serves fixtures.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .coder import Decoder, Encoder, P

#: Record types in the order of their codes.
START, MARK, MARK_LIBRARY, MARK_IMAGE, REFINE, REFINE_LIBRARY, REFINE_IMAGE, COPY, NON_MARK, DICT_OR_RESET, COMMENT, END = range(12)
NAMES = ("start", "new mark", "new mark, library only", "new mark, image only", "refined", "refined, library only", "refined, image only", "copy", "non-mark", "dictionary or reset", "comment", "end")
LARGEST, SMALLEST = 262142, -262143
#: Hardening of our own: pixels that one shape, and records that one stream may have.
SHAPE_PIXELS, RECORDS = 1 << 26, 1 << 22


class Broken(ValueError):
    """The stream breaks a rule of the format."""


@dataclass
class Image:
    width: int = 0
    height: int = 0
    inherited: list[np.ndarray] = field(default_factory=list)
    shapes: list[np.ndarray] = field(default_factory=list)  # own ones, numbered after the inherited
    parents: list[int] = field(default_factory=list)
    blits: list[tuple[int, int, int]] = field(default_factory=list)  # left, bottom, shape number
    histogram: list[int] = field(default_factory=lambda: [0] * 12)

    def shape(self, number: int) -> np.ndarray | None:
        n = len(self.inherited)
        if 0 <= number < n:
            return self.inherited[number]
        return self.shapes[number - n] if n <= number < n + len(self.shapes) else None

    def all_shapes(self) -> list[np.ndarray]:
        return self.inherited + self.shapes


def box(bitmap: np.ndarray) -> tuple[int, int, int, int]:
    """xmin, ymin, xmax, ymax of the ink; width, height, -1, -1 without ink."""
    rows, cols = np.flatnonzero(bitmap.any(1)), np.flatnonzero(bitmap.any(0))
    if not len(rows):
        return bitmap.shape[1], bitmap.shape[0], -1, -1
    return int(cols[0]), int(rows[0]), int(cols[-1]), int(rows[-1])


def median3(a: int, b: int, c: int) -> int:
    return sorted((a, b, c))[1]


class Codec:
    def __init__(self, coder: Decoder | Encoder, dictionary: Image | None = None):
        self.coder, self.dictionary = coder, dictionary
        self.image = Image()
        self.flag, self.newline = bytearray(1), bytearray(1)
        self.direct, self.cross = bytearray(1024), bytearray(2048)
        self.library: list[int] = []
        self.boxes: list[tuple[int, int, int, int]] = []
        self.started = False
        self.row_left = self.right_edge = self.row_bottom = self.bottom = self.turn = 0
        self.recent = [0] * 3
        self.reset()

    def reset(self) -> None:
        self.cells, self.left, self.right = bytearray(1), [0], [0]
        self.roots: dict[str, int] = {}

    def bit(self, states: bytearray, at: int, value: int | None) -> int:
        return self.coder.bit(states, at) if value is None else self.coder.bit(states, at, value)

    def number(self, low: int, high: int, root: str, value: int | None = None) -> int:
        """A number by sign, magnitude and bits; each decision has its own cell of a tree that grows as it is walked."""
        node = self.roots.get(root, 0)
        link: tuple[list[int], int] | None = None
        negative, edge, span, phase = False, 0, -1, 0
        magnitude = value
        while span != 1:
            if not node:
                node = len(self.cells)
                self.cells.append(0)
                self.left.append(0)
                self.right.append(0)
                if link:
                    link[0][link[1]] = node
                else:
                    self.roots[root] = node
            if low >= edge:
                yes = True
            elif high >= edge:
                yes = bool(self.bit(self.cells, node, None if value is None else int(magnitude >= edge)))
            else:
                yes = False
            link = (self.right if yes else self.left, node)
            node = link[0][link[1]]
            if phase == 0:
                negative, edge, phase = not yes, 1, 1
                if negative:
                    low, high = -high - 1, -low - 1
                    magnitude = None if value is None else -value - 1
            elif phase == 1:
                if yes:
                    edge = 2 * edge + 1
                else:
                    phase, span = 2, edge + 1 >> 1
                    edge = 0 if span == 1 else edge - (span >> 1)
            else:
                span >>= 1
                if span != 1:
                    edge += span >> 1 if yes else -(span >> 1)
                elif not yes:
                    edge -= 1
        return -edge - 1 if negative else edge

    def plain(self, width: int, height: int, want: np.ndarray | None = None) -> np.ndarray:
        """A bitmap on its own, top row first, by the ten pixels above and before each."""
        if want is None:
            return self.plain_decoded(width, height)
        bitmap = np.zeros((height, width), np.uint8)
        above2 = above = [0] * (width + 6)
        for y in range(height - 1, -1, -1):
            row = [0] * (width + 6)  # pixel x is at x + 2
            wanted = want[y].tolist()
            context = above2[2] << 8 | above2[3] << 7 | above[2] << 4 | above[3] << 3 | above[4] << 2
            for x in range(width):
                n = row[x + 2] = self.coder.bit(self.direct, context, wanted[x])
                if x + 1 < width:
                    context = context << 1 & 0x37A | above[x + 5] << 2 | above2[x + 4] << 7 | n
            bitmap[y] = row[2 : 2 + width]
            above2, above = above, row
        return bitmap

    def plain_decoded(self, width: int, height: int) -> np.ndarray:
        """The same, read. A symbol as likely as expected only moves the coder's interval, by a step that
        depends on the context's state, so a run of white pixels under white rows is taken at once."""
        bitmap = np.zeros((height, width), np.uint8)
        states, coder, bit = self.direct, self.coder, self.coder.bit
        above2 = above = bytearray(width + 6)
        for y in range(height - 1, -1, -1):
            row = bytearray(width + 6)  # pixel x is at x + 2
            context = above2[2] << 8 | above2[3] << 7 | above[2] << 4 | above[3] << 3 | above[4] << 2
            a, fence, x = coder.a, coder.fence, 0
            clear = -1  # pixels below it have no ink above that they depend on; unknown yet
            while x < width:
                s = states[context]
                step = P[s]
                if not context and not s & 1:
                    if clear < x:  # ink above enters the context of the pixel two or one before it
                        near, far = above.find(1, x), above2.find(1, x)
                        clear = min(near - 4 if near >= 0 else width, far - 3 if far >= 0 else width, width)
                    if clear > x + 1 and step:
                        n = min(clear - x, (fence - a) // step)
                        if n > 0:
                            a += n * step
                            x += n
                            if x >= width:
                                break
                            context = above[x + 4] << 2 | above2[x + 3] << 7
                            context |= above2[x + 2] << 8 | above2[x + 1] << 9 | above[x + 3] << 3 | above[x + 2] << 4 | above[x + 1] << 5 | above[x] << 6
                            continue
                z = a + step
                if z <= fence:
                    a = z
                    n = s & 1
                else:
                    coder.a = a
                    n = bit(states, context)
                    a, fence = coder.a, coder.fence
                if n:
                    row[x + 2] = 1
                if x + 1 < width:
                    context = context << 1 & 0x37A | above[x + 5] << 2 | above2[x + 4] << 7 | n
                x += 1
            coder.a = a
            bitmap[y] = np.frombuffer(row, np.uint8, width, 2)
            above2, above = above, row
        return bitmap

    def refined(self, width: int, height: int, match: int, want: np.ndarray | None = None) -> np.ndarray:
        """A bitmap by four of its own pixels and seven of a library shape, centred on each other."""
        other = self.image.shape(self.library[match])
        x0, y0, x1, y1 = self.boxes[match]
        dx = (width >> 1) + 1 - width - ((1 + x1 - x0 >> 1) - x1)
        dy = (height >> 1) + 1 - height - ((1 + y1 - y0 >> 1) - y1)
        # the library shape seen from the new one's place, with a margin of 1
        seen = np.zeros((height + 2, width + 2), np.uint8)
        a, b = max(0, dy - 1), min(other.shape[0], height + 1 + dy)
        c, d = max(0, dx - 1), min(other.shape[1], width + 1 + dx)
        if a < b and c < d:
            seen[a - dy + 1 : b - dy + 1, c - dx + 1 : d - dx + 1] = other[a:b, c:d]
        fixed = seen.astype(np.int32)
        known = fixed[2:, 1:-1] << 6 | fixed[1:-1, :-2] << 5 | fixed[1:-1, 1:-1] << 4 | fixed[1:-1, 2:] << 3 | fixed[:-2, :-2] << 2 | fixed[:-2, 1:-1] << 1 | fixed[:-2, 2:]
        bitmap = np.zeros((height, width), np.uint8)
        above = [0] * (width + 2)
        for y in range(height - 1, -1, -1):
            row, part = [0] * (width + 2), known[y].tolist()
            for x in range(width):
                context = above[x] << 10 | above[x + 1] << 9 | above[x + 2] << 8 | row[x] << 7 | part[x]
                row[x + 1] = self.bit(self.cross, context, None if want is None else int(want[y, x]))
            bitmap[y] = row[1:-1]
            above = row
        return bitmap

    def learn(self, number: int, bitmap: np.ndarray) -> None:
        self.library.append(number)
        self.boxes.append(box(bitmap))

    def start(self, is_image: bool, size: tuple[int, int] | None = None) -> None:
        w = self.number(0, LARGEST, "image size", size and size[0])
        h = self.number(0, LARGEST, "image size", size and size[1])
        if is_image != bool(w and h) or not is_image and (w or h):
            raise Broken("image size")
        self.image.width, self.image.height = w, h
        self.row_left, self.right_edge, self.row_bottom = 0, 0, h
        self.bottom = 0
        self.recent, self.turn = [h] * 3, 0
        self.started = True
        self.bit(self.flag, 0, None if size is None else 0)
        self.library, self.boxes = [], []
        for i, s in enumerate(self.image.inherited):
            self.learn(i, s)

    def place(self, width: int, height: int, want: tuple[int, int] | None = None) -> tuple[int, int]:
        """Left and bottom of the next mark, relative to the row's start or to the mark before."""
        if self.bit(self.newline, 0, None if want is None else int(not self.image.blits)):
            x = self.number(SMALLEST, LARGEST, "row x", None if want is None else want[0] + 1 - self.row_left)
            y = self.number(SMALLEST, LARGEST, "row y", None if want is None else want[1] + height - self.row_bottom)
            left, bottom = self.row_left + x, self.row_bottom + y - height + 1
            self.row_left, self.bottom, self.row_bottom = left, bottom, bottom
            self.recent, self.turn = [bottom] * 3, 0
        else:
            x = self.number(SMALLEST, LARGEST, "next x", None if want is None else want[0] + 1 - self.right_edge)
            y = self.number(SMALLEST, LARGEST, "next y", None if want is None else want[1] + 1 - self.bottom)
            left, bottom = self.right_edge + x, self.bottom + y
            self.turn = (self.turn + 1) % 3
            self.recent[self.turn] = bottom
            self.bottom = median3(*self.recent)
        self.right_edge = left + width - 1
        return left - 1, bottom - 1

    def size(self) -> tuple[int, int]:
        w, h = self.number(0, LARGEST, "width"), self.number(0, LARGEST, "height")
        return self.checked(w, h)

    @staticmethod
    def checked(w: int, h: int) -> tuple[int, int]:
        if not (0 <= w <= 0xFFFF and 0 <= h <= 0xFFFF and w * h <= SHAPE_PIXELS):
            raise Broken("shape size")
        return w, h

    def match(self) -> int:
        n = self.number(0, len(self.library) - 1, "match")
        if not 0 <= n < len(self.library):
            raise Broken("match")
        return n

    def add(self, bitmap: np.ndarray, parent: int, library: bool, at: tuple[int, int] | None) -> None:
        im = self.image
        number = len(im.inherited) + len(im.shapes)
        im.shapes.append(bitmap)
        im.parents.append(parent)
        if library:
            self.learn(number, bitmap)
        if at:
            im.blits.append((*at, number))

    def record(self, is_image: bool) -> int:
        kind, im = self.number(START, END, "record"), self.image
        if not START <= kind <= END:
            raise Broken("record type")
        im.histogram[kind] += 1
        if kind == START:
            self.start(is_image)
        elif kind in (MARK, MARK_LIBRARY, MARK_IMAGE):
            w, h = self.size()
            bitmap = self.plain(w, h)
            self.add(bitmap, -1, kind != MARK_IMAGE, self.place(w, h) if kind != MARK_LIBRARY else None)
        elif kind in (REFINE, REFINE_LIBRARY, REFINE_IMAGE):
            n = self.match()
            x0, y0, x1, y1 = self.boxes[n]
            w, h = 1 + x1 - x0 + self.number(SMALLEST, LARGEST, "width change"), 1 + y1 - y0 + self.number(SMALLEST, LARGEST, "height change")
            bitmap = self.refined(*self.checked(w, h), n)
            self.add(bitmap, self.library[n], kind != REFINE_IMAGE, self.place(w, h) if kind != REFINE_LIBRARY else None)
        elif kind == COPY:
            n = self.match()
            x0, y0, x1, y1 = self.boxes[n]
            left, bottom = self.place(1 + x1 - x0, 1 + y1 - y0)
            im.blits.append((left - x0, bottom - y0, self.library[n]))
        elif kind == NON_MARK:
            w, h = self.size()
            bitmap = self.plain(w, h)
            left, top = self.number(1, im.width, "x"), self.number(1, im.height, "y")
            self.add(bitmap, -2, False, (left - 1, top - h))
        elif kind == COMMENT:
            for _ in range(self.number(0, LARGEST, "comment length")):
                self.number(0, 255, "comment byte")
                if self.coder.over:
                    break
        elif kind == DICT_OR_RESET:
            if self.started:
                self.reset()
            else:
                n = self.number(0, LARGEST, "inherited")
                if n and not im.inherited:
                    if self.dictionary is None:
                        raise Broken("no dictionary")
                    im.inherited = self.dictionary.all_shapes()
                if n != len(im.inherited) and (n or im.inherited):
                    raise Broken("inherited count")
        return kind


def decode(data: bytes, dictionary: Image | None = None, is_image: bool = True) -> Image:
    """The image or dictionary; a stream that runs dry keeps what it had. Raises Broken."""
    codec = Codec(Decoder(data), dictionary)
    for _ in range(RECORDS):
        if codec.record(is_image) == END or codec.coder.over:
            break
    else:
        raise Broken("records")
    if not codec.started:
        raise Broken("no start")
    return codec.image


def encode(width: int, height: int, marks: list[tuple[np.ndarray, int, int]], dictionary: Image | None = None) -> bytes:
    """Fixture: a stream of marks (bitmap, left, bottom), or of a dictionary's shapes if width is 0; repeated bitmaps become copies."""
    codec = Codec(Encoder(), dictionary)
    im, seen = codec.image, {}
    if dictionary:
        im.inherited = dictionary.all_shapes()
        codec.number(START, END, "record", DICT_OR_RESET)
        codec.number(0, LARGEST, "inherited", len(im.inherited))
    codec.number(START, END, "record", START)
    codec.start(width > 0, (width, height))
    for i, s in enumerate(im.inherited):
        seen[s.shape, s.tobytes()] = i
    for bitmap, left, bottom in marks:
        key = (bitmap.shape, bitmap.tobytes())
        h, w = bitmap.shape
        if key in seen and width:
            codec.number(START, END, "record", COPY)
            n = seen[key]
            codec.number(0, len(codec.library) - 1, "match", n)
            x0, y0, x1, y1 = codec.boxes[n]
            codec.place(1 + x1 - x0, 1 + y1 - y0, (left + x0, bottom + y0))
            im.blits.append((left, bottom, codec.library[n]))
            continue
        seen[key] = len(codec.library)
        codec.number(START, END, "record", MARK if width else MARK_LIBRARY)
        codec.number(0, LARGEST, "width", w)
        codec.number(0, LARGEST, "height", h)
        codec.plain(w, h, bitmap)
        codec.add(bitmap, -1, True, codec.place(w, h, (left, bottom)) if width else None)
    codec.number(START, END, "record", END)
    return codec.coder.finish()
