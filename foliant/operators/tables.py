"""Containers as DataFrames.

`files` is any frame with path, length and content, such as `read_files` gives. Structure, text
and links come from one narrow pass over the files. Pixels take two: files are first cut into
page units (a page's form and its shared dictionary), dealt out by page so that a book of a
thousand pages is not one task, then decoded. Metadata functions never decode pixels, and each
table has its own function, so a plan holds only the decoding that it uses.

A file or page that can't be decoded gives no rows, or a row with an error text; a job never
fails for it.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from foliant import schemas as S
from foliant.functions import iw44, jb2, raster, text
from foliant.functions.coder import blockless
from foliant.functions.streams import decompress_all
from foliant.sources import container as C

#: Rows to a batch that leaves a decoder; small, as rows may hold images.
BATCH = 64
#: Hardening of our own: pixels that one page may declare.
PAGE_PIXELS = 1 << 27
#: Page types by code.
TYPES = ("unknown", "bitonal", "photo", "compound")


def read_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, length and content of each container below a path."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.djvu").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).select("path", "length", "content")


def rows(frame: DataFrame, schema: str, make: Callable[..., Iterator[tuple]]) -> DataFrame:
    """A frame of the rows that make(**row) yields for each row of a frame, in small Arrow batches."""
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)
    wanted = [p for p in inspect.signature(make).parameters]

    def run(batches):
        held: list[tuple] = []

        def out():
            columns = list(zip(*held, strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for b in batches:
            columns = [b.column(x) for x in wanted]
            for i in range(b.num_rows):
                for row in make(*(c[i].as_py() for c in columns)):
                    held.append(row)
                    if len(held) >= BATCH * 16 or len(held) >= BATCH and "binary" in schema:
                        yield out()
        if held:
            yield out()

    return frame.select(*wanted).mapInArrow(run, kind)


def page_type(mask: bool, background: bool, foreground: bool) -> int:
    return (3 if background or foreground else 1) if mask else (2 if background or foreground else 0)


def document_rows(path: str, content: bytes) -> Iterator[tuple]:
    d = C.open_document(content)
    yield path, len(content), d.form, d.root, d.bundled, d.version, len(d.components), len(d.pages), d.error


def documents(files: DataFrame) -> DataFrame:
    return rows(files, S.DOCUMENTS, document_rows)


def component_rows(path: str, content: bytes) -> Iterator[tuple]:
    for c in C.open_document(content).components:
        yield path, c.no, c.offset, c.size, c.id, c.title, c.type


def components(files: DataFrame) -> DataFrame:
    return rows(files, S.COMPONENTS, component_rows)


def page_rows(path: str, content: bytes) -> Iterator[tuple]:
    for p in C.open_document(content).pages:
        own = list(C.chunks(content, p.offset))
        ids = {c.id for c in own}
        i = C.page_info(content, own)
        background = next((b for b in C.BACKGROUNDS if b in ids), None)
        code = page_type("Sjbz" in ids, background is not None, bool(ids & {"FG44", "FGbz"}))
        geometry = (i.width, i.height, i.version, i.dpi, i.rotation, i.gamma) if i else (None,) * 6
        yield (path, p.no, p.offset, p.id, p.title, *geometry, "Sjbz" in ids, background is not None, "FG44" in ids, "FGbz" in ids, "Djbz" in ids, background, TYPES[code], code)


def pages(files: DataFrame) -> DataFrame:
    return rows(files, S.PAGES, page_rows)


def chunk_rows(path: str, content: bytes, wanted: set[str] | None = None, payloads: bool = True) -> Iterator[tuple]:
    d = C.open_document(content)
    if d.error:
        return
    forms = {p.offset: p.no for p in d.pages}
    for c in d.components:
        if d.bundled:
            forms.setdefault(c.offset, -1)
    forms.setdefault(d.root, -1)
    for form, page in forms.items():
        for c in C.chunks(content, form):
            if wanted is None or c.id in wanted:
                yield path, page, form, c.no, c.id, c.offset, c.size, C.payload(content, c) if payloads else None


def chunks(files: DataFrame, chunk_ids: list[str] | None = None, payloads: bool = True) -> DataFrame:
    """Chunks of all pages, and of the root and the other components with page_no -1; ids and payloads are chosen before any byte is copied."""
    wanted = set(chunk_ids) if chunk_ids is not None else None
    return rows(files, S.CHUNKS, lambda path, content: chunk_rows(path, content, wanted, payloads))


def text_rows(path: str, content: bytes) -> Iterator[tuple]:
    for p in C.open_document(content).pages:
        found = text.text_bytes(C.text_payload(content, list(C.chunks(content, p.offset))))
        if found is not None:
            yield path, p.no, found.decode("utf-8", "replace"), found


def page_text(files: DataFrame) -> DataFrame:
    return rows(files, S.TEXT, text_rows)


def zone_rows(path: str, content: bytes) -> Iterator[tuple]:
    for p in C.open_document(content).pages:
        own = list(C.chunks(content, p.offset))
        i = C.page_info(content, own)
        for z in text.zones(C.text_payload(content, own), i.height if i else None):
            yield path, p.no, z.zone_id, z.parent_id, z.depth, z.ordinal, z.type, text.ZONES.get(z.type), z.x, z.y, z.w, z.h, z.text


def zones(files: DataFrame) -> DataFrame:
    return rows(files, S.ZONES, zone_rows)


def link_rows(path: str, content: bytes) -> Iterator[tuple]:
    d = C.open_document(content)
    for p in d.pages:
        own = list(C.chunks(content, p.offset))
        found, i = C.annotation(d, content, own), C.page_info(content, own)
        for k, x in enumerate(text.links(found.decode("utf-8", "replace"), i.height if i else 0) if found else ()):
            yield path, p.no, k, x.url, x.comment, x.shape, x.x, x.y, x.w, x.h


def links(files: DataFrame) -> DataFrame:
    return rows(files, S.LINKS, link_rows)


def outline_rows(path: str, content: bytes) -> Iterator[tuple]:
    d = C.open_document(content)
    if not d.error:
        for n in text.outline(C.outline_payload(content, d.root)):
            yield path, n.node_id, n.parent_id, n.depth, n.ordinal, n.title, n.url, None


def outline_nodes(files: DataFrame) -> DataFrame:
    """Bookmarks in preorder, page_no still to be resolved (null)."""
    return rows(files, S.OUTLINE, outline_rows)


#: What a table's rows are made by, for the data source and the SQL functions.
MAKERS = {"documents": document_rows, "components": component_rows, "pages": page_rows, "chunks": chunk_rows, "text": text_rows, "zones": zone_rows, "outline_nodes": outline_rows, "links": link_rows}


def outline(files: DataFrame) -> DataFrame:
    """Bookmarks with their page: by number, or by component id; -1 if there is none."""
    from foliant.operators.relational import resolve_destinations

    return resolve_destinations(outline_nodes(files).drop("page_no"), pages(files).select("path", "page_no", "page_id"))


def unit_rows(path: str, content: bytes) -> Iterator[tuple]:
    d = C.open_document(content)
    for p in d.pages:
        own = list(C.chunks(content, p.offset))
        last = max((c.start + c.size for c in own), default=p.offset + 12)
        shared = next((c for c in own if c.id == "Djbz"), None)
        source = shared or next((hit[0] for hit in [C.included(d, content, own, "Djbz")] if hit), None)
        yield path, p.no, p.offset, last - p.offset, content[p.offset : last], C.payload(content, source) if source else None


def page_units(files: DataFrame) -> DataFrame:
    """Pages on their own: the form's bytes and the dictionary's, dealt out by page, heavy ones apart."""
    return rows(files, S.UNITS, unit_rows).repartition("path", "page_no")


def _own(unit: bytes) -> list[C.Chunk]:
    return list(C.chunks(unit, 0))


def mask_of(unit: bytes, dictionary: bytes | None) -> jb2.Image | None:
    found = next((c for c in _own(unit) if c.id == "Sjbz"), None)
    if found is None:
        return None
    base = None
    if dictionary is not None:
        try:
            base = jb2.decode(dictionary, is_image=False)
        except jb2.Broken:
            base = None
    return jb2.decode(C.payload(unit, found), base)


def _mask_rows(of: Callable[[jb2.Image], Iterator[tuple]]) -> Callable[..., Iterator[tuple]]:
    def make(path, page_no, own, dictionary):
        try:
            image = mask_of(own, dictionary)
        except jb2.Broken:
            return
        if image:
            for row in of(image):
                yield path, page_no, *row

    return make


def _records(im: jb2.Image) -> Iterator[tuple]:
    return ((jb2.NAMES[k], n) for k, n in enumerate(im.histogram) if n)


def _runs(im: jb2.Image) -> Iterator[tuple]:
    return ((i, *r) for i, runs in raster.placed_runs(im) for r in runs.tolist())


def jb2_shapes(units: DataFrame) -> DataFrame:
    def of(im):
        for n, s in enumerate(im.all_shapes()):
            own = n - len(im.inherited)
            yield n, im.parents[own] if own >= 0 else -1, s.shape[1], s.shape[0], own < 0, raster.pack(s)

    return rows(units, S.SHAPES, _mask_rows(of))


def jb2_blits(units: DataFrame) -> DataFrame:
    return rows(units, S.BLITS, _mask_rows(lambda im: ((i, n, left, bottom) for i, (left, bottom, n) in enumerate(im.blits))))


def jb2_records(units: DataFrame) -> DataFrame:
    """How many records of each type a page's stream has."""
    return rows(units, S.RECORDS, _mask_rows(_records))


def ink_runs(units: DataFrame) -> DataFrame:
    """Runs of ink on the page, placement by placement, half open, bottom-up and unclipped."""
    return rows(units, S.INK_RUNS, _mask_rows(_runs))


def _palette(unit: bytes) -> C.Palette | None:
    found = next((c for c in _own(unit) if c.id == "FGbz"), None)
    return C.palette(C.payload(unit, found)) if found else None


def palettes(units: DataFrame) -> DataFrame:
    def make(path, page_no, own):
        found = _palette(own)
        for k, c in enumerate(found.colours if found else ()):
            yield path, page_no, k, *c

    return rows(units, S.PALETTE, make)


def blit_colors(units: DataFrame) -> DataFrame:
    def make(path, page_no, own):
        found = _palette(own)
        for k, c in enumerate(found.indices or () if found else ()):
            yield path, page_no, k, c

    return rows(units, S.BLIT_COLORS, make)


def _layer(unit: bytes, ids: tuple[str, ...], most: int = 0) -> iw44.Pixmap | None:
    own = _own(unit)
    name = next((i for i in ids if any(c.id == i for c in own)), None)
    return iw44.decode([C.payload(unit, c) for c in own if c.id == name], most) if name else None


LAYERS = {"background": C.BACKGROUNDS, "foreground": ("FG44",)}


def layers(units: DataFrame, most_chunks: int = 0) -> DataFrame:
    """Headers of the wavelet layers, after decoding."""

    def make(path, page_no, own):
        for name, ids in LAYERS.items():
            try:
                if x := _layer(own, ids, most_chunks):
                    yield path, page_no, name, x.width, x.height, x.serial, x.slices, len(x.planes) == 3, x.delay if len(x.planes) == 3 else -1, x.half, None
            except iw44.Broken as e:
                yield path, page_no, name, None, None, None, None, None, None, None, str(e)

    return rows(units, S.LAYERS, make)


def layer_images(units: DataFrame, layer: str = "background", plane: str = "rgb", most_chunks: int = 0) -> DataFrame:
    """A layer's pixels: rgb or gray from the top, or the planes y, cb, cr as stored, bottom row first."""

    def make(path, page_no, own):
        try:
            x = _layer(own, LAYERS[layer], most_chunks)
            if x is None or plane in ("cb", "cr") and len(x.planes) < 3:
                return
            p = x.rgb()[::-1] if plane == "rgb" else x.gray() if plane == "gray" else x.plane(("y", "cb", "cr").index(plane))
            yield image_row(path, page_no, 1, p)
        except iw44.Broken as e:
            yield path, page_no, 1, None, None, None, None, None, str(e)

    return rows(units, S.RENDERS, make)


def image_row(path: str, page_no: int, sub: int, p: np.ndarray) -> tuple:
    n = 1 if p.ndim == 2 else 3
    return path, page_no, sub, p.shape[1], p.shape[0], "GRAY8" if n == 1 else "RGB24", p.shape[1] * n, np.ascontiguousarray(p).tobytes(), None


def render_unit(unit: bytes, dictionary: bytes | None, sub: int = 1, compose: bool = True, swap: bool = False, most_chunks: int = 0) -> np.ndarray | None:
    """Top-down pixels of a page, grey or colour; None if it renders nothing. Raises Broken of either codec."""
    sub = max(sub, 1)
    own = _own(unit)
    ids = {c.id for c in own}
    i = C.page_info(unit, own)
    if i and i.width * i.height > PAGE_PIXELS:
        raise iw44.Broken("page size")
    code = page_type("Sjbz" in ids, bool(ids & set(C.BACKGROUNDS)), bool(ids & {"FG44", "FGbz"}))
    mask = mask_of(unit, dictionary) if code in (1, 3) else None
    if mask and mask.width * mask.height > PAGE_PIXELS:
        raise jb2.Broken("page size")
    page = None
    if i and i.width and i.height and compose and code in (2, 3) and ids & set(C.BACKGROUNDS):
        page = composed(unit, i, mask, sub, most_chunks)
        if page is not None:
            page = raster.finish(page, i.gamma, swap)
    if page is None and code == 0 and i and i.width and i.height:
        page = np.full((-(-i.height // sub), -(-i.width // sub)), 255, np.uint8)
    if page is None and mask:
        page = raster.bitonal(mask, sub)
    return raster.turn(page, i.rotation if i else 0) if page is not None else None


def composed(unit: bytes, i: C.Info, mask: jb2.Image | None, sub: int, most_chunks: int) -> np.ndarray | None:
    """Bottom-up colour page at the reduced size; None if its background can't be used."""
    try:
        back = _layer(unit, C.BACKGROUNDS, most_chunks)
    except iw44.Broken:
        return None
    ratio = raster.reduction(i.width, i.height, back.width, back.height)
    if not ratio:
        return None
    w, h = -(-i.width // sub), -(-i.height // sub)
    page = back.rgb()
    if not (ratio == sub and (back.width, back.height) == (w, h)):
        page = raster.scale(page, w, h, ratio, sub)
    if mask:
        colours, front = _palette(unit), None
        if colours is None:
            try:
                layer = _layer(unit, LAYERS["foreground"], most_chunks)
                front = layer.rgb() if layer else None
            except iw44.Broken:
                front = None
        table = np.array(colours.colours, np.uint8).reshape(-1, 3) if colours else None
        indices = np.array(colours.indices) if colours and colours.indices is not None else None
        raster.stencil(page, mask, i.width, i.height, sub, table, indices, front)
    return page


def plan_unit(unit: bytes, sub: int = 1, compose: bool = True) -> tuple[int, int, int] | None:
    """Height, width and samples a pixel that a page's metadata promise; None if they promise nothing."""
    own = _own(unit)
    ids, i = {c.id for c in own}, C.page_info(unit, own)
    back = bool(ids & set(C.BACKGROUNDS))
    code = page_type("Sjbz" in ids, back, bool(ids & {"FG44", "FGbz"}))
    colour = compose and code in (2, 3) and back
    if not i or i.width <= 0 or i.height <= 0 or not (colour or code == 0 or "Sjbz" in ids):
        return None
    size = -(-i.height // max(sub, 1)), -(-i.width // max(sub, 1))
    return (*(size[::-1] if i.rotation in (90, 270) else size), 3 if colour else 1)


def renders(units: DataFrame, subsample: int = 1, compose: bool = True, bgr: bool = False, most_chunks: int = 0, exact: bool = False) -> DataFrame:
    """Rendered pages, turned as their INFO says. exact: what isn't of the size and format that the page's metadata promise is an error, such as a mask alone where a background can't be used."""

    def make(path, page_no, own, dictionary):
        def failed(why):
            return path, page_no, max(subsample, 1), None, None, None, None, None, why

        try:
            p = render_unit(own, dictionary, subsample, compose, bgr, most_chunks)
            if p is None:
                yield failed("nothing to render")
            elif exact and plan_unit(own, subsample, compose) != (*p.shape[:2], 1 if p.ndim == 2 else 3):
                yield failed("not as planned")
            else:
                yield image_row(path, page_no, max(subsample, 1), p)
        except (jb2.Broken, iw44.Broken) as e:
            yield failed(str(e) or type(e).__name__)

    return rows(units, S.RENDERS, make)


def pnm(images: DataFrame) -> DataFrame:
    """path, page_no and pnm: each image as a binary grey or colour map."""

    def make(path, page_no, width, height, format, data):
        if data is not None:
            shape = (height, width) if format == "GRAY8" else (height, width, 3)
            yield path, page_no, raster.pnm(np.frombuffer(data, np.uint8).reshape(shape))

    return rows(images, "path string, page_no int, pnm binary", make)


def from_pnm(maps: DataFrame) -> DataFrame:
    """The inverse of pnm; what is no such map gives a row with an error."""

    def make(path, page_no, pnm):
        try:
            yield image_row(path, page_no, 1, raster.read_pnm(pnm))
        except ValueError as e:
            yield path, page_no, 1, None, None, None, None, None, str(e)

    return rows(maps, S.RENDERS, make)


def layer_file(all_chunks: DataFrame, chunk_id: str = "BG44") -> DataFrame:
    """A layer's chunks as a standalone image form, one row per page."""
    inner = F.array_sort(F.collect_list(F.struct("chunk_no", "payload")))
    pad = lambda x: F.when(F.octet_length(x.payload) % 2 == 1, F.concat(x.payload, F.lit(b"\0"))).otherwise(x.payload)
    size = lambda n: F.unhex(F.lpad(F.hex(n), 8, "0"))
    body = F.aggregate("inner", F.lit(b""), lambda acc, x: F.concat(acc, F.lit(b"PM44"), size(F.octet_length(x.payload).cast("long")), pad(x)))
    grouped = all_chunks.where(F.col("chunk_id") == chunk_id).groupBy("path", "page_no").agg(inner.alias("inner")).select("path", "page_no", body.alias("body"))
    return grouped.select("path", "page_no", F.concat(F.lit(C.MAGIC + C.FORM), size((F.octet_length("body") + 4).cast("long")), F.lit(b"PM44"), F.col("body")).alias("file"))


def blob_texts(blobs: DataFrame) -> DataFrame:
    """path, page_no and text of blobs (path, blob, n_pages) in which each page's bytes follow their length, four bytes, great end first. A blob that ends early has no more texts; its further pages are empty."""

    def make(path, blob, n_pages):
        at = 0
        for page in range(n_pages):
            end = at + 4 + int.from_bytes(blob[at : at + 4], "big") if at + 4 <= len(blob) else len(blob) + 1
            whole = end <= len(blob)
            yield path, page, blob[at + 4 : end].decode("utf-8", "replace") if whole else ""
            at = end if whole else len(blob)

    return rows(blobs, "path string, page_no int, text string", make)


def _unit_table(make: Callable[..., Iterator[tuple]]) -> Callable[..., Iterator[tuple]]:
    return lambda path, content: (row for _, page_no, _, _, own, dictionary in unit_rows(path, content) for row in make(path, page_no, own, dictionary))


#: Names of SQL table functions of a file's content: what makes the rows, and their schema with the path in front.
SQL_FUNCTIONS = {
    "doc_zones": (zone_rows, S.ZONES),
    "doc_outline": (outline_rows, S.OUTLINE),
    "doc_links": (link_rows, S.LINKS),
    "doc_jb2_records": (_unit_table(_mask_rows(_records)), S.RECORDS),
    "doc_ink_runs": (_unit_table(_mask_rows(_runs)), S.INK_RUNS),
}


def register_functions(spark: SparkSession) -> None:
    """SQL_FUNCTIONS as table functions, for `SELECT ... FROM files, LATERAL doc_zones(content)`."""

    def table_function(make, schema):
        class Rows:
            def eval(self, content: bytes):
                for _, *row in make("", bytes(content)) if content is not None else ():
                    yield tuple(row)

        return F.udtf(Rows, returnType=schema.removeprefix("path string, "))

    for name, (make, schema) in SQL_FUNCTIONS.items():
        spark.udtf.register(name, table_function(make, schema))


def unpack_stream(streams: DataFrame, column: str = "payload", empty: bytes | None = None) -> DataFrame:
    """All columns, and `raw`: the block-sorted stream of a column decompressed, null if corrupt; `empty` stands for a stream that ends before its first block."""
    def raw(x: pd.Series) -> pd.Series:
        held = x.tolist()
        out = decompress_all(held)
        if empty is not None:
            out = [empty if y is None and data is not None and blockless(data) else y for data, y in zip(held, out, strict=True)]
        return pd.Series(out, x.index, object)

    return streams.withColumn("raw", F.pandas_udf(raw, "binary")(F.col(column)))
