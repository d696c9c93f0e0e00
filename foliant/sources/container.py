"""Reading containers: forms, chunks, directories and headers, from whole buffers.

Everything here is a plain function from bytes to records; foliant.operators.tables turns them
into DataFrames. A bad file gives an error text, never an exception to the caller.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from foliant.functions.coder import decompress

#: Magic, forms that are one page, chunk ids by role.
MAGIC, FORM, BUNDLE = b"AT&T", b"FORM", b"DJVM"
PAGE_FORMS = (b"DJVU", b"PM44", b"BM44")
BACKGROUNDS = ("BG44", "PM44", "BM44")
#: Rotation by the low bits of the flag byte.
ROTATIONS = {6: 90, 2: 180, 5: 270}


@dataclass
class Chunk:
    no: int
    id: str
    offset: int  # of the tag
    size: int  # clamped to the form
    start: int  # of the payload


@dataclass
class Component:
    no: int
    offset: int = 0
    size: int = 0
    id: str | None = None
    title: str | None = None
    type: int = 0


@dataclass
class Page:
    no: int
    offset: int
    id: str | None = None
    title: str | None = None


@dataclass
class Document:
    error: str | None = None
    form: str | None = None
    root: int | None = None
    bundled: bool = False
    version: int | None = None
    components: list[Component] = field(default_factory=list)
    pages: list[Page] = field(default_factory=list)


def u32(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 4], "big")


def chunks(data: bytes, form: int) -> Iterator[Chunk]:
    """The chunks of the form whose tag is at `form`; sizes are clamped to the form's end, chunks are padded to even length."""
    if form + 12 > len(data) or data[form : form + 4] != FORM:
        return
    end = min(form + 8 + u32(data, form + 4), len(data))
    at, no = form + 12, 0
    while at + 8 <= end:
        size = min(u32(data, at + 4), end - at - 8)
        yield Chunk(no, data[at : at + 4].decode("latin-1"), at, size, at + 8)
        at, no = at + 8 + size + (size & 1), no + 1


def strings(data: bytes) -> Iterator[str]:
    """The strings of a stretch, each up to a zero byte or the end."""
    at = 0
    while at < len(data):
        end = data.find(b"\0", at)
        end = len(data) if end < 0 else end
        yield data[at:end].decode("utf-8", "replace")
        at = end + 1


def directory(data: bytes, start: int, size: int, doc: Document) -> bool:
    """Fill the components and pages of a bundle; False if the fixed part is broken."""
    end = start + size
    if start + 3 > end:
        return False
    flag, count = data[start], int.from_bytes(data[start + 1 : start + 3], "big")
    doc.bundled, doc.version = bool(flag & 0x80), flag & 0x7F
    at = start + 3
    if not count or doc.bundled and at + 4 * count > len(data):
        return False
    doc.components = [Component(i) for i in range(count)]
    if doc.bundled:
        for c in doc.components:
            c.offset = u32(data, at + 4 * c.no)
        at += 4 * count
    names = decompress(data[at:end]) if at < end else None
    if names is not None:
        for c in doc.components[: len(names) // 3]:
            c.size = int.from_bytes(names[3 * c.no : 3 * c.no + 3], "big")
        flags = names[3 * count : 4 * count]
        id_bit, title_bit = (0x02, 0x04) if doc.version == 0 else (0x80, 0x40)
        rest = strings(names[4 * count :])
        for c in doc.components:
            f = flags[c.no] if c.no < len(flags) else 0
            if c.no < len(flags):
                c.type = f & 1 if doc.version == 0 else f & 0x3F
            c.id = next(rest, None)
            if f & id_bit:
                next(rest, None)  # a file name, which has no use here
            if f & title_bit:
                c.title = next(rest, None)
    for c in doc.components if doc.bundled else ():
        if c.offset + 12 <= len(data) and data[c.offset : c.offset + 4] == FORM and (c.type == 1 if names is not None else data[c.offset + 8 : c.offset + 12] == b"DJVU"):
            doc.pages.append(Page(len(doc.pages), c.offset, c.id, c.title))
    return True


def open_document(data: bytes) -> Document:
    """Structure of a container; `error` says why it can't be opened."""
    doc = Document()
    if len(data) < 16:
        doc.error = "shorter than 16 bytes"
        return doc
    root = 4 if data.startswith(MAGIC) else 0
    if root + 12 > len(data) or data[root : root + 4] != FORM:
        doc.error = "no FORM"
        return doc
    kind = data[root + 8 : root + 12]
    doc.form, doc.root = kind.decode("latin-1"), root
    if kind in PAGE_FORMS:
        doc.pages.append(Page(0, root))
    elif kind == BUNDLE:
        found = next((c for c in chunks(data, root) if c.id == "DIRM"), None)
        if found is None:
            doc.error = "no directory"
        elif not directory(data, found.start, found.size, doc):
            doc.error, doc.components, doc.pages = "bad directory", [], []
    else:
        doc.error = f"form {doc.form!r} is not supported"
    return doc


@dataclass
class Info:
    width: int
    height: int
    version: int
    dpi: int = 300
    rotation: int = 0
    gamma: float = 2.2
    gamma_byte: int | None = None


def info(payload: bytes) -> Info | None:
    """Page geometry; None under five bytes. The resolution alone is little-endian."""
    if len(payload) < 5:
        return None
    out = Info(int.from_bytes(payload[:2], "big"), int.from_bytes(payload[2:4], "big"), payload[4])
    if len(payload) >= 8:
        out.dpi = int.from_bytes(payload[6:8], "little") or 300
    if len(payload) >= 9:
        out.gamma_byte = payload[8]
        out.gamma = payload[8] / 10 if payload[8] else 2.2
    if len(payload) >= 10:
        out.rotation = ROTATIONS.get(payload[9] & 7, 0)
    return out


def wavelet_info(payload: bytes) -> Info | None:
    """Geometry from a layer's first chunk, for pages without an INFO chunk."""
    if len(payload) < 8 or payload[0] or payload[2] & 0x7F != 1:
        return None
    w, h = int.from_bytes(payload[4:6], "big"), int.from_bytes(payload[6:8], "big")
    return Info(w, h, payload[2] << 8 | payload[3], 100) if w and h else None


def page_info(data: bytes, own: list[Chunk]) -> Info | None:
    """The first INFO decides, even if it is bad; without one, the background layer's header."""
    first = next((c for c in own if c.id == "INFO"), None)
    if first:
        return info(data[first.start : first.start + first.size])
    for name in BACKGROUNDS:
        layer = next((c for c in own if c.id == name), None)
        if layer:
            return wavelet_info(data[layer.start : layer.start + layer.size])
    return None


def include_id(payload: bytes) -> str:
    """An include's target: at most 63 bytes, without blanks and ends of line behind."""
    return payload[:63].rstrip(b"\n\r \t\x1a").decode("utf-8", "replace")


def included(doc: Document, data: bytes, own: list[Chunk], wanted: str) -> tuple[Chunk, int] | None:
    """The first chunk `wanted` among the included components, in order; includes that don't resolve are skipped."""
    by_id: dict[str, int] = {}
    for c in doc.components:
        if c.id is not None:
            by_id.setdefault(c.id, c.offset)
    for c in own:
        if c.id == "INCL" and (at := by_id.get(include_id(data[c.start : c.start + c.size]))):
            for x in chunks(data, at):
                if x.id == wanted:
                    return x, at
    return None


def payload(data: bytes, chunk: Chunk) -> bytes:
    return data[chunk.start : chunk.start + chunk.size]


def text_payload(data: bytes, own: list[Chunk]) -> bytes | None:
    """The compressed text chunk if there is one, even if it fails; else the plain one."""
    for name in ("TXTz", "TXTa"):
        found = next((c for c in own if c.id == name), None)
        if found:
            return decompress(payload(data, found)) if name == "TXTz" else payload(data, found)
    return None


def annotation(doc: Document, data: bytes, own: list[Chunk]) -> bytes | None:
    """The first annotation found: the page's compressed, its plain, then those of its includes; one that fails gives none."""
    for name in ("ANTz", "ANTa"):
        found = next((c for c in own if c.id == name), None)
        if found:
            return decompress(payload(data, found)) if name == "ANTz" else payload(data, found)
    for name in ("ANTz", "ANTa"):
        if hit := included(doc, data, own, name):
            return decompress(payload(data, hit[0])) if name == "ANTz" else payload(data, hit[0])
    return None


def outline_payload(data: bytes, root: int) -> bytes | None:
    found = next((c for c in chunks(data, root) if c.id == "NAVM"), None)
    return decompress(payload(data, found)) if found else None


@dataclass
class Palette:
    colours: list[tuple[int, int, int]]  # red, green, blue
    indices: list[int] | None  # colour of each placement


def palette(data: bytes) -> Palette | None:
    """Colours (stored blue first) and, if flagged and whole, an index for each placement."""
    if len(data) < 3:
        return None
    n = int.from_bytes(data[1:3], "big")
    if 3 + 3 * n > len(data):
        return None
    colours = [(data[i + 2], data[i + 1], data[i]) for i in range(3, 3 + 3 * n, 3)]
    at = 3 + 3 * n
    if data[0] & 0x80 and at + 3 <= len(data):
        k = int.from_bytes(data[at : at + 3], "big")
        raw = decompress(data[at + 3 :])
        if raw is not None and 2 * k <= len(raw):
            return Palette(colours, [int.from_bytes(raw[i : i + 2], "big", signed=True) for i in range(0, 2 * k, 2)])
    return Palette(colours, None)
