"""Queries on pictures with content: wavelet layers with coefficients in every kind of band, scaled
backgrounds, painted foregrounds, and marks of all record types, against plain SQL.

Layers vary along one axis only, so that the whole inverse transform, at five scales, is a chain of
windows in SQL; the other axis must stay even, which the queries state as a column.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from foliant.functions import iw44, jb2, raster
from foliant.functions.coder import Encoder
from foliant.operators import tables
from foliant.plans import fixtures as X
from foliant.plans.catalog import ground, query, table

#: Passes over all bands that a layer's fixture makes, dealt out to two chunks.
PASSES = 12
#: By residue of a place in its block: amplitude of the target, and quantisation step of the first pass (a fixed value of the format), across and down.
KINDS = ((32, 0, 200, 0x4000, 0x4000), (32, 16, 60, 0x8000, 0x8000), (16, 8, 40, 0x10000, 0x10000), (8, 4, 30, 0x20000, 0x20000), (4, 2, 20, 0x40000, 0x40000), (2, 1, 16, 0x40000, 0x40000))


def target(key: int, place: int, plane: int) -> int:
    amplitude = next(a for m, r, a, *_ in KINDS if place % m == r)
    return ((key * 37 + place * 13 + plane * 101) % 97 - 48) * amplitude


class PlaneWriter:
    """The forward coder of a plane: tells a decoder bit by bit which coefficients of (blocks, 1024) targets become known, and to what precision."""

    def __init__(self, targets: np.ndarray):
        self.targets, self.blocks = targets.reshape(-1, 64, 16).tolist(), [[None] * 64 for _ in targets]
        self.start, self.bucket, self.root, self.mantissa = bytearray(16), bytearray(80), bytearray(1), bytearray(1)
        steps = [s >> 2 for s in iw44.STEPS]
        self.low, self.high = [*steps[:4], *(s for s in steps[4:7] for _ in range(4))], [0, *steps[7:]]
        self.band = 0

    def slice(self, e: Encoder) -> None:
        steps = [self.high[self.band]] * 16 if self.band else self.low
        if any(0 < t < 0x8000 for t in steps):
            for known, wanted in zip(self.blocks, self.targets, strict=True):
                self.block(e, known, wanted, steps)
        self.band = (self.band + 1) % len(iw44.BANDS)
        if not self.band:
            self.low, self.high = [t >> 1 for t in self.low], [t >> 1 for t in self.high]

    def block(self, e: Encoder, known: list, wanted: list, steps: list[int]) -> None:
        first, count = iw44.BANDS[self.band]
        usable = [bool(self.band) or 0 < t < 0x8000 for t in steps]
        old = {b: [i for i in range(16) if known[b] and known[b][i]] for b in range(first, first + count)}
        new = {b: [i for i in range(16) if usable[i] and not (known[b] and known[b][i]) and abs(wanted[b][i]) >= steps[i]] for b in range(first, first + count)}
        old = {b: [i for i in v if 0 < steps[i] < 0x8000] for b, v in old.items()}
        open_ = {b: [i for i in range(16) if 0 < steps[i] < 0x8000 and not (known[b] and known[b][i])] for b in range(first, first + count)}
        some = any(old.values())
        if count < 16 or some or any(known[b] is None or open_[b] for b in open_) and e.bit(self.root, 0, int(any(new.values()))):
            chosen = []
            for b in range(first, first + count):
                if known[b] is not None and not open_[b]:
                    continue
                parent = known[b >> 2] if self.band else None
                near = min(3, sum(x != 0 for x in parent[4 * b & 15 : (4 * b & 15) + 4])) if parent else 0
                if e.bit(self.bucket, 8 * self.band + near + 4 * some, int(bool(new[b]))):
                    chosen.append(b)
            for b in chosen:
                known[b] = known[b] or [0] * 16
                left = len(open_[b])
                for i in open_[b]:
                    if e.bit(self.start, min(left, 7) + 8 * bool(old[b]), int(i in new[b])):
                        e.split(0x8000 + (3 * e.a >> 3), wanted[b][i] < 0)
                        known[b][i] = steps[i] + (steps[i] >> 1) - (steps[i] >> 3)
                        left = 0
                    else:
                        left = max(left - 1, 0)
        for b, places in old.items():
            for i in places:
                size, t, aim = known[b][i], steps[i], abs(wanted[b][i])
                if size <= 3 * t:
                    size += t >> 2
                    up = e.bit(self.mantissa, 0, int(aim >= size))
                else:
                    up = int(aim >= size)
                    e.split(0x8000 + (3 * e.a >> 3), bool(up))
                known[b][i] = size + (t >> 1) - (0 if up else t)


def layer(key: int, width: int, height: int, down: bool = False, planes: int = 3, half: bool = False) -> list[bytes]:
    """Two chunks of a layer whose samples vary across, or down, by target()."""
    across, rows = -(-width // 32), -(-height // 32)
    writers = []
    for p in range(planes):
        square = np.zeros((rows * 32, across * 32), np.int64)
        for place in range(height if down else width):
            # a coefficient's neighbours in the other direction, as far as its scale has them, are the same
            every = next(m for m, r, *_ in KINDS if place % m == r)
            (square.T if not down else square)[place, ::every] = target(key, place, p)
        blocks = square.reshape(rows, 32, across, 32).swapaxes(1, 2).reshape(-1, 1024)
        writers.append(PlaneWriter(blocks[:, iw44.PLACES]))
    out = []
    for serial in range(2):
        e, slices = Encoder(), PASSES * len(iw44.BANDS) // 2
        for _ in range(slices):
            for w in writers:
                w.slice(e)
        head = bytes([1 | (0x80 if planes == 1 else 0), 2]) + width.to_bytes(2, "big") + height.to_bytes(2, "big") + bytes([0 if half else 0x80])
        out.append(bytes([serial, slices]) + (b"" if serial else head) + e.finish())
    return out


def samples_sql(extent: str, down: bool = False, planes: int = 3, half: str = "false", source: str = "part", key: str = "p_size", passes: int = PASSES) -> str:
    """CTEs that end in `sample` (k, p, x, n, v: signed 8-bit): target, quantiser, and the inverse transform along one axis."""
    amplitude = "CASE " + " ".join(f"WHEN x % {m} = {r} THEN {a}" for m, r, a, *_ in KINDS) + " END"
    step = "CASE " + " ".join(f"WHEN x % {m} = {r} THEN {d if down else s}" for m, r, _, s, d in KINDS) + " END"
    known = "r + (CASE WHEN r <= 3 * t THEN t // 4 ELSE 0 END)"
    parts = [
        f"page AS (SELECT DISTINCT {key} AS k, ({extent})::BIGINT AS n, ({half}) AS half FROM {source})",
        f"aim AS (SELECT k, p, x, n, half, ((k * 37 + x * 13 + p * 101) % 97 - 48) * {amplitude} AS v, {step} AS s FROM page, range(0, {planes}) a(p), range(0, 200) b(x) WHERE x < n)",
        f"coded AS (SELECT *, list_reduce(list_prepend(0::BIGINT, list_filter(list_transform(range(0, {passes}), lambda i: (s // (1 << i))::BIGINT), lambda t: t > 0 AND t < 32768)), lambda r, t: CASE WHEN r = 0 THEN CASE WHEN abs(v) >= t THEN t + t // 2 - t // 8 ELSE 0 END ELSE {known} + CASE WHEN abs(v) >= {known} THEN t // 2 ELSE t // 2 - t END END) AS size FROM aim)",
        "w32 AS (SELECT k, p, x, n, half, CASE WHEN v < 0 THEN -size ELSE size END AS v FROM coded)",
    ]
    over = "OVER (PARTITION BY k, p ORDER BY x)"
    before = "w32"
    for s in (16, 8, 4, 2, 1):
        at = lambda d, f=before: f"coalesce({'lag' if d < 0 else 'lead'}(v, {abs(d)}) {over}, 0)"
        skip = "half AND p > 0 OR " if s == 1 else ""
        parts.append(f"e{s} AS (SELECT k, p, x, n, half, CASE WHEN {skip}x % {2 * s} <> 0 THEN v ELSE v - ((9 * ({at(-s)} + {at(s)}) - ({at(-3 * s)} + {at(3 * s)}) + 16) >> 5) END AS v FROM {before})")
        inner = f"x // {s} >= 3 AND x // {s} + 3 < (n + {s - 1}) // {s}"
        parts.append(f"w{s} AS (SELECT k, p, x, n, half, CASE WHEN {skip}x % {2 * s} <> {s} THEN v WHEN {inner} THEN v + ((9 * ({at(-s)} + {at(s)}) - ({at(-3 * s)} + {at(3 * s)}) + 8) >> 4) ELSE v + (({at(-s)} + CASE WHEN x + {s} < n THEN {at(s)} ELSE {at(-s)} END + 1) >> 1) END AS v FROM e{s})")
        before = f"w{s}"
    parts.append("even AS (SELECT k, p, x, n, CASE WHEN half AND p > 0 AND x % 2 = 1 THEN lag(v, 1) OVER (PARTITION BY k, p ORDER BY x) ELSE v END AS v FROM w1)")
    parts.append("sample AS (SELECT k, p, x, n, greatest(-128, least(127, (v + 32) >> 6)) AS v FROM even)")
    return ",\n".join(parts)


#: From `sample`: the colours k, x, n, r, g, b.
RGB = """yuv AS (SELECT k, x, n, max(v) FILTER (p = 0) AS y, max(v) FILTER (p = 1) AS cb, max(v) FILTER (p = 2) AS cr FROM sample GROUP BY k, x, n),
rgb AS (SELECT k, x, n, greatest(0, least(255, y + 128 + cr + (cr >> 1)))::BIGINT AS r, greatest(0, least(255, y + 128 - (cb >> 2) - ((cr + (cr >> 1)) >> 1)))::BIGINT AS g, greatest(0, least(255, y + 128 - (cb >> 2) + cb * 2))::BIGINT AS b FROM yuv)"""


def sizes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_size").distinct()


def pixels(width, height, format, data) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape((height, width) if format == "GRAY8" else (height, width, 3))


WIDE, TALL = "40 + p_size % 17", "37 + p_size % 13"


@query(f"WITH {samples_sql(WIDE, half='p_size % 2 = 1')} SELECT k AS p_size, p::BIGINT AS plane, x::BIGINT AS x, (v + 128)::BIGINT AS value, true AS even FROM sample")
def layer_planes(spark, sf_dir):
    """Luminance and chrominance, in full and half resolution, of a layer that varies across."""

    def make(p_size):
        return str(p_size), X.single(X.info(100, 100), *[X.chunk("BG44", c) for c in layer(p_size, 40 + p_size % 17, 9, half=p_size % 2 == 1)])

    units = tables.page_units(X.pack(sizes(spark, sf_dir), make))

    def emit(path, width, height, format, data):
        a = pixels(width, height, format, data)
        even = bool((a == a[0]).all())
        for x, v in enumerate(a[0].tolist()):
            yield int(path), x, v, even

    each = [tables.rows(tables.layer_images(units, plane=name), "p_size int, x long, value long, even boolean", emit).withColumn("plane", F.lit(p).cast("long")) for p, name in enumerate(("y", "cb", "cr"))]
    return each[0].union(each[1]).union(each[2])


@query(f"WITH {samples_sql(TALL, down=True)}, {RGB} SELECT k AS p_size, (n - 1 - x)::BIGINT AS y, r, g, b, true AS even FROM rgb")
def layer_colours(spark, sf_dir):
    """Colours, top row first, of a layer that varies down."""

    def make(p_size):
        return str(p_size), X.single(X.info(100, 100), *[X.chunk("BG44", c) for c in layer(p_size, 35, 37 + p_size % 13, down=True)])

    def emit(path, width, height, format, data):
        a = pixels(width, height, format, data)
        even = bool((a == a[:, :1]).all())
        for y, c in enumerate(a[:, 0].tolist()):
            yield int(path), y, *c, even

    return tables.rows(tables.layer_images(tables.page_units(X.pack(sizes(spark, sf_dir), make))), "p_size int, y long, r long, g long, b long, even boolean", emit)


@query(f"WITH {samples_sql(WIDE, planes=1)} SELECT k AS p_size, x::BIGINT AS x, (v + 128)::BIGINT AS plane, greatest(0, least(255, 127 - v))::BIGINT AS shown FROM sample")
def layer_gray(spark, sf_dir):
    """A layer of one plane: its values, and what is shown, which is dark where values are great."""

    def make(p_size):
        return str(p_size), X.single(X.info(100, 100), *[X.chunk("BG44", c) for c in layer(p_size, 40 + p_size % 17, 5, planes=1)])

    units = tables.page_units(X.pack(sizes(spark, sf_dir), make))

    def emit(name):
        def run(path, width, height, format, data):
            for x, v in enumerate(pixels(width, height, format, data)[0].reshape(width, -1)[:, 0].tolist()):
                yield int(path), x, v

        return tables.rows(tables.layer_images(units, plane=name), "p_size int, x long, value long", run)

    return emit("gray").withColumnRenamed("value", "plane").join(emit("rgb").withColumnRenamed("value", "shown"), ["p_size", "x"])


@query(f"WITH {samples_sql(WIDE, planes=1, passes=PASSES // 2)} SELECT k AS p_size, x::BIGINT AS x, (v + 128)::BIGINT AS value, 1::BIGINT AS chunks FROM sample")
def layer_first_chunk(spark, sf_dir):
    """A layer as its first chunk alone gives it, with half of the passes."""

    def make(p_size):
        return str(p_size), X.single(X.info(100, 100), *[X.chunk("BG44", c) for c in layer(p_size, 40 + p_size % 17, 5, planes=1)])

    units = tables.page_units(X.pack(sizes(spark, sf_dir), make))

    def emit(path, width, height, format, data):
        for x, v in enumerate(pixels(width, height, format, data)[0].tolist()):
            yield path, x, v

    values = tables.rows(tables.layer_images(units, plane="gray", most_chunks=1), "path string, x long, value long", emit)
    read = tables.layers(units, most_chunks=1).select("path", F.col("chunks").cast("long").alias("chunks"))
    return values.join(read, "path").select(F.col("path").cast("int").alias("p_size"), "x", "value", "chunks")


def _scaled(numerator: int, denominator: int, source: str, width: str, extent: str) -> str:
    """CTE `scaled` (k, x, r, g, b): `source` (k, x, r, g, b) of extent pixels scaled across, in sixteenths."""
    place = f"least(({16 * denominator} + {numerator}) // {2 * numerator} - 8 + ({numerator // 2} + {16 * denominator} * x) // {numerator}, (e - 1) * 16)"
    mix = ", ".join(f"(a.{c} + (((b.{c} - a.{c}) * (u & 15) + 8) >> 4))::BIGINT AS {c}" for c in "rgb")
    return f"""place AS (SELECT k, x, e, {place} AS u FROM (SELECT DISTINCT k, ({width}) AS w, ({extent}) AS e FROM {source}) t, range(0, 200) i(x) WHERE x < w),
scaled AS (SELECT place.k, place.x, {mix} FROM place JOIN {source} a ON a.k = place.k AND a.x = greatest(0, least(u >> 4, e - 1)) JOIN {source} b ON b.k = place.k AND b.x = greatest(0, least((u >> 4) + 1, e - 1)))"""


def rendered_rows(images, schema: str, swap_axes: bool = False):
    def emit(path, width, height, format, data):
        a = pixels(width, height, format, data)
        even = bool((a == (a[:, :1] if swap_axes else a[:1])).all())
        for x, c in enumerate((a[:, 0] if swap_axes else a[0]).tolist()):
            yield int(path), x, *c, even

    return tables.rows(images, schema, emit)


@query(f"WITH {samples_sql(WIDE)}, {RGB}, {_scaled(3, 2, 'rgb', '(n * 3 + 1) // 2', 'n')} SELECT k AS p_size, x::BIGINT AS x, r, g, b, true AS even FROM scaled")
def photo_scaled_up(spark, sf_dir):
    """A background at a third of the page's size, at half the page's size."""

    def make(p_size):
        w = 40 + p_size % 17
        return str(p_size), X.single(X.info(3 * w, 12), *[X.chunk("BG44", c) for c in layer(p_size, w, 4)])

    return rendered_rows(tables.renders(tables.page_units(X.pack(sizes(spark, sf_dir), make)), 2), "p_size int, x long, r long, g long, b long, even boolean")


SHRUNK = "small AS (SELECT k, x // 4 AS x, min(n) AS n, " + ", ".join(f"((4 * sum({c}) + 2 * count(*)) // (4 * count(*)))::BIGINT AS {c}" for c in "rgb") + " FROM rgb GROUP BY k, x // 4)"


@query(f"WITH {samples_sql(WIDE)}, {RGB}, {SHRUNK}, {_scaled(4, 5, 'small', '(n + 4) // 5', '(n + 3) // 4')} SELECT k AS p_size, x::BIGINT AS x, r, g, b, true AS even FROM scaled")
def photo_scaled_down(spark, sf_dir):
    """A background of the page's own size, at a fifth: averages of four by four first, partial ones at the edge, then the scaler."""

    def make(p_size):
        w = 40 + p_size % 17
        return str(p_size), X.single(X.info(w, 8), *[X.chunk("BG44", c) for c in layer(p_size, w, 8)])

    return rendered_rows(tables.renders(tables.page_units(X.pack(sizes(spark, sf_dir), make)), 5), "p_size int, x long, r long, g long, b long, even boolean")


@query(f"WITH {samples_sql(TALL, down=True)}, {RGB} SELECT k AS p_size, (n - 1 - x)::BIGINT AS y, b AS r, g, r AS b, true AS even FROM rgb")
def photo_swapped(spark, sf_dir):
    """A page that differs from top to bottom, with red and blue swapped."""

    def make(p_size):
        h = 37 + p_size % 13
        return str(p_size), X.single(X.info(6, h), *[X.chunk("BG44", c) for c in layer(p_size, 6, h, down=True)])

    return rendered_rows(tables.renders(tables.page_units(X.pack(sizes(spark, sf_dir), make)), 1, bgr=True), "p_size int, y long, r long, g long, b long, even boolean", True)


def painted_files(spark, sf_dir):
    """Pages of 40 by 30 on an even grey, with a dot for each part, in a foreground of a third of the size that varies across."""
    parts = table(spark, sf_dir, "part").groupBy("p_size").agg(F.array_sort(F.collect_list("p_partkey")).alias("parts"))

    def make(p_size, parts):
        mask = jb2.encode(40, 30, [(np.ones((1, 1), np.uint8), p % 40, p // 40 % 30) for p in parts])
        return str(p_size), X.single(X.info(40, 30), X.chunk("Sjbz", mask), X.chunk("BG44", ground(20, 15)), *[X.chunk("FG44", c) for c in layer(p_size, 14, 10)])

    return X.pack(parts, make)


def _painted(spark, sf_dir, sub: int):
    w, h = -(-40 // sub), -(-30 // sub)

    def emit(path, width, height, format, data):
        a = pixels(width, height, format, data)[::-1]
        for y, x in zip(*np.nonzero((a != 128).any(2)), strict=True):
            yield int(path), int(x), int(y), *a[y, x].tolist()

    images = tables.renders(tables.page_units(painted_files(spark, sf_dir)), sub).where(f"width = {w} and height = {h}")
    return tables.rows(images, "p_size int, x long, y long, r long, g long, b long", emit)


@query(f"""WITH {samples_sql('14')}, {RGB}, dot AS (SELECT DISTINCT p_size, p_partkey % 40 AS x, p_partkey // 40 % 30 AS y FROM part)
SELECT p_size, dot.x, dot.y, r, g, b FROM dot JOIN rgb ON rgb.k = p_size AND rgb.x = least(dot.x // 3, 13) WHERE r <> 128 OR g <> 128 OR b <> 128""")
def foreground_painted(spark, sf_dir):
    """Each dot shows the foreground's colour there."""
    return _painted(spark, sf_dir, 1)


def _folded(c: str) -> str:
    return f"list_reduce(list_prepend(128::BIGINT, list_transform(range(0, times), lambda i: {c})), lambda d, c: (d * (255 - alpha) + c * alpha + 127) // 255)::BIGINT AS {c}"


@query(f"""WITH {samples_sql('14')}, {RGB}, dot AS (SELECT p_size, p_partkey % 40 // 4 AS x, p_partkey // 40 % 30 // 4 AS y, count(*) AS times, 255 // (4 * least(4, 30 - (p_partkey // 40 % 30 // 4) * 4)) AS alpha FROM part GROUP BY 1, 2, 3, 5),
f AS (SELECT p_size, dot.x, dot.y, {', '.join(map(_folded, 'rgb'))} FROM dot JOIN rgb ON rgb.k = p_size AND rgb.x = least((dot.x * 4 + 2) // 3, 13))
SELECT * FROM f WHERE r <> 128 OR g <> 128 OR b <> 128""")
def foreground_blended(spark, sf_dir):
    """At a quarter of the size dots are blended over the ground, one after the other, by their share of a cell; the topmost cells are partial."""
    return _painted(spark, sf_dir, 4)


# --- marks of all record types --------------------------------------------------------------------

#: Shapes by number: width, height, and where there is ink, by column x and row y (from the bottom) for key k, in SQL and here.
SHAPES = {
    0: (7, 6, "(k * 31 + x * 7 + y * 13) % 3 = 0 OR x = 0 AND y = 0 OR x = 6 AND y = 5", lambda k, x, y: (k * 31 + x * 7 + y * 13) % 3 == 0 or (x, y) in ((0, 0), (6, 5))),
    1: (8, 5, "(k * 17 + x * 5 + y * 3) % 4 = 0", lambda k, x, y: (k * 17 + x * 5 + y * 3) % 4 == 0),
    2: (9, 6, "(k * 31 + x * 7 + y * 11) % 3 = 0 OR x = 8 AND y = 5", lambda k, x, y: (k * 31 + x * 7 + y * 11) % 3 == 0 or (x, y) == (8, 5)),
    3: (6, 7, "x BETWEEN 2 AND 4 AND y BETWEEN 1 AND 4 AND ((k + x + y) % 2 = 0 OR x = 2 AND y = 1 OR x = 4 AND y = 4)", lambda k, x, y: 2 <= x <= 4 and 1 <= y <= 4 and ((k + x + y) % 2 == 0 or (x, y) in ((2, 1), (4, 4)))),
    4: (5, 5, "(k + x * 3 + y) % 5 < 2", lambda k, x, y: (k + x * 3 + y) % 5 < 2),
    5: (7, 5, "(k * 3 + x + y * 2) % 3 > 0", lambda k, x, y: (k * 3 + x + y * 2) % 3 > 0),
    6: (6, 6, "(k * 7 + x * y) % 2 = 0", lambda k, x, y: (k * 7 + x * y) % 2 == 0),
    7: (10, 4, "(k + x * x + y) % 3 = 1", lambda k, x, y: (k + x * x + y) % 3 == 1),
}
#: The order in which a stream holds the shapes.
STREAM = (0, 1, 2, 4, 3, 5, 6, 7)
#: Placements in order: (shape, left, bottom); the last shape is a picture of its own, not a mark.
PLACED = ((0, 3, 40), (2, 14, 41), (4, 30, 39), (3, 50, 42), (3, 61, 44), (6, 4, 20), (0, 20, 22), (7, 40, 10))
#: Records of each type, in the order of jb2.NAMES.
RECORD_COUNTS = (1, 1, 2, 1, 1, 1, 1, 3, 1, 1, 1, 1)


def bits(number: int, k: int) -> np.ndarray:
    w, h, _, ink = SHAPES[number]
    return np.array([[int(ink(k, x, y)) for x in range(w)] for y in range(h)], np.uint8)


def record_stream(k: int) -> bytes:
    """A page of 80 by 60 with each record type of the format."""
    c = jb2.Codec(Encoder())
    im, shapes = c.image, {n: bits(n, k) for n in SHAPES}
    places = iter(PLACED)

    def kind(n):
        c.number(jb2.START, jb2.END, "record", n)

    def place(b):
        _, left, bottom = next(places)
        return c.place(b.shape[1], b.shape[0], (left, bottom))

    def plain(what, number):
        b = shapes[number]
        kind(what)
        c.number(0, jb2.LARGEST, "width", b.shape[1])
        c.number(0, jb2.LARGEST, "height", b.shape[0])
        c.plain(b.shape[1], b.shape[0], b)
        c.add(b, -1, what != jb2.MARK_IMAGE, place(b) if what != jb2.MARK_LIBRARY else None)

    def refine(what, number, match):
        b = shapes[number]
        kind(what)
        c.number(0, len(c.library) - 1, "match", match)
        x0, y0, x1, y1 = c.boxes[match]
        c.number(jb2.SMALLEST, jb2.LARGEST, "width change", b.shape[1] - (1 + x1 - x0))
        c.number(jb2.SMALLEST, jb2.LARGEST, "height change", b.shape[0] - (1 + y1 - y0))
        c.refined(b.shape[1], b.shape[0], match, b)
        c.add(b, c.library[match], what != jb2.REFINE_IMAGE, place(b) if what != jb2.REFINE_LIBRARY else None)

    def copy(match):
        kind(jb2.COPY)
        c.number(0, len(c.library) - 1, "match", match)
        x0, y0, x1, y1 = c.boxes[match]
        _, left, bottom = next(places)
        c.place(1 + x1 - x0, 1 + y1 - y0, (left + x0, bottom + y0))
        im.blits.append((left, bottom, c.library[match]))

    kind(jb2.START)
    c.start(True, (80, 60))
    plain(jb2.MARK, 0)
    plain(jb2.MARK_LIBRARY, 1)
    refine(jb2.REFINE, 2, 0)
    kind(jb2.COMMENT)
    c.number(0, jb2.LARGEST, "comment length", 3)
    for byte in b"abc":
        c.number(0, 255, "comment byte", byte)
    plain(jb2.MARK_IMAGE, 4)
    plain(jb2.MARK_LIBRARY, 3)
    copy(3)
    copy(3)
    kind(jb2.DICT_OR_RESET)
    c.reset()
    refine(jb2.REFINE_LIBRARY, 5, 1)
    refine(jb2.REFINE_IMAGE, 6, 4)
    copy(0)
    b = shapes[7]
    kind(jb2.NON_MARK)
    c.number(0, jb2.LARGEST, "width", b.shape[1])
    c.number(0, jb2.LARGEST, "height", b.shape[0])
    c.plain(b.shape[1], b.shape[0], b)
    _, left, bottom = next(places)
    c.number(1, 80, "x", left + 1)
    c.number(1, 60, "y", bottom + b.shape[0])
    c.add(b, -2, False, (left, bottom))
    kind(jb2.END)
    return c.coder.finish()


def record_files(spark, sf_dir):
    return X.pack(sizes(spark, sf_dir), lambda p_size: (str(p_size), X.single(X.info(80, 60), X.chunk("Sjbz", record_stream(p_size)))))


def _shape_sql() -> str:
    every = " UNION ALL ".join(f"SELECT k, {n} AS shape, x, y FROM page, range(0, {w}) a(x), range(0, {h}) b(y) WHERE {rule}" for n, (w, h, rule, _) in SHAPES.items())
    return f"page AS (SELECT DISTINCT p_size AS k FROM part), ink AS ({every})"


@query(f"WITH {_shape_sql()}, placed(blit, shape, l, b) AS (VALUES {', '.join(str((i, *p)) for i, p in enumerate(PLACED))}) SELECT k AS p_size, blit::BIGINT AS blit_no, (x + l)::BIGINT AS x, (y + b)::BIGINT AS y FROM ink JOIN placed USING (shape)")
def refined_marks(spark, sf_dir):
    """Ink of marks of every record type, placement by placement: plain, refined, copied, kept for later, and a picture that is no mark."""
    runs = tables.ink_runs(tables.page_units(record_files(spark, sf_dir)))
    each = runs.select("path", "blit_no", "y", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"))
    return each.select(F.col("path").cast("int").alias("p_size"), *[F.col(c).cast("long") for c in ("blit_no", "x", "y")])


@query(f"SELECT p_size, t.record_type, t.n::BIGINT AS n FROM (SELECT DISTINCT p_size FROM part) p, (VALUES {', '.join(str(x) for x in zip(jb2.NAMES, RECORD_COUNTS, strict=True))}) t(record_type, n)")
def record_histogram(spark, sf_dir):
    """How many records of each type a stream has."""
    own = tables.jb2_records(tables.page_units(record_files(spark, sf_dir)))
    return own.select(F.col("path").cast("int").alias("p_size"), "record_type", F.col("n").cast("long"))


@query(f"WITH {_shape_sql()} SELECT k AS p_size, shape::BIGINT AS shape_no, min(x)::BIGINT AS x0, min(y)::BIGINT AS y0, max(x)::BIGINT AS x1, max(y)::BIGINT AS y1, count(*)::BIGINT AS ink FROM ink GROUP BY ALL")
def shape_boxes(spark, sf_dir):
    """The tight box and the ink of each distinct shape, by its place in the stream's order."""

    def emit(path, shape_no, w, h, rle):
        a = raster.unpack(rle, w, h)
        if a.any():
            yield int(path), STREAM[shape_no], *jb2.box(a), int(a.sum())

    own = tables.jb2_shapes(tables.page_units(record_files(spark, sf_dir)))
    return tables.rows(own, "p_size int, shape_no long, x0 long, y0 long, x1 long, y1 long, ink long", emit)


@query("""
WITH m AS (SELECT DISTINCT p_size, p_partkey % 40 AS x, 29 - p_partkey // 40 % 30 AS y FROM part)
SELECT p_size, (CASE p_size % 4 WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN 39 - x ELSE 29 - y END)::BIGINT AS x, (CASE p_size % 4 WHEN 0 THEN y WHEN 1 THEN 39 - x WHEN 2 THEN 29 - y ELSE x END)::BIGINT AS y FROM m""")
def all_rotations(spark, sf_dir):
    """Ink of pages in each of the four turns, from the top left of the turned page."""
    parts = table(spark, sf_dir, "part").groupBy("p_size").agg(F.array_sort(F.collect_list("p_partkey")).alias("parts"))

    def make(p_size, parts):
        mask = jb2.encode(40, 30, [(np.ones((1, 1), np.uint8), p % 40, p // 40 % 30) for p in parts])
        return str(p_size), X.single(X.info(40, 30, flags=(1, 6, 2, 5)[p_size % 4]), X.chunk("Sjbz", mask))

    def ink(path, width, height, format, data):
        for y, x in zip(*np.nonzero(pixels(width, height, format, data) == 0), strict=True):
            yield int(path), int(x), int(y)

    return tables.rows(tables.renders(tables.page_units(X.pack(parts, make))), "p_size int, x long, y long", ink)


def rule_stream(kind: int) -> tuple[bytes, bytes | None]:
    """A page's stream and its dictionary, each kind breaking another rule of the format, and 0 none."""
    dot = np.ones((2, 2), np.uint8)
    two = jb2.encode(0, 0, [(dot, 0, 0), (np.ones((3, 1), np.uint8), 0, 0)])
    c = jb2.Codec(Encoder())
    if kind == 0:
        return jb2.encode(20, 20, [(dot, 1, 1)], jb2.decode(two, is_image=False)), two
    if kind == 1:  # no size
        c.number(jb2.START, jb2.END, "record", jb2.START)
        c.number(0, jb2.LARGEST, "image size", 0)
        c.number(0, jb2.LARGEST, "image size", 0)
    elif kind == 2:  # a dictionary of other length
        return jb2.encode(20, 20, [(dot, 1, 1)], jb2.decode(jb2.encode(0, 0, [(dot, 0, 0)]), is_image=False)), two
    elif kind == 3:  # inherits, but there is no dictionary
        return jb2.encode(20, 20, [(dot, 1, 1)], jb2.decode(two, is_image=False)), None
    elif kind == 4:  # a shape too wide
        c.number(jb2.START, jb2.END, "record", jb2.START)
        c.start(True, (20, 20))
        c.number(jb2.START, jb2.END, "record", jb2.MARK)
        c.number(0, jb2.LARGEST, "width", 70000)
        c.number(0, jb2.LARGEST, "height", 1)
    else:  # ends before it starts
        c.number(jb2.START, jb2.END, "record", jb2.END)
    return c.coder.finish(), None


@query("SELECT o_orderkey, o_orderkey % 6 = 0 AS rendered, CASE o_orderkey % 6 WHEN 0 THEN 4::BIGINT END AS ink FROM orders")
def stream_rules(spark, sf_dir):
    """Streams that break a rule on sizes, dictionaries or order give an error row, and no job fails."""
    streams = [rule_stream(k) for k in range(6)]

    def make(o_orderkey):
        own, base = streams[o_orderkey % 6]
        return str(o_orderkey), X.single(X.info(20, 20), *([X.chunk("Djbz", base)] if base else []), X.chunk("Sjbz", own))

    def emit(path, data, error):
        yield int(path), error is None, int((np.frombuffer(data, np.uint8) == 0).sum()) if data is not None else None

    images = tables.renders(tables.page_units(X.pack(table(spark, sf_dir, "orders").select("o_orderkey"), make)))
    return tables.rows(images, "o_orderkey long, rendered boolean, ink long", emit)
