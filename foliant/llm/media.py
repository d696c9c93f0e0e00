"""Media columns by signature sniffing.

A payload is stored as 8-bit samples of one of three containers (wave audio, grey bitmap, grey
PNG), chosen by the content. An Aho-Corasick automaton then locates magic bytes anywhere in the
stored bytes (thirteen signatures, twelve formats and more), a validator per format walks the structure and
proves the length, by checksums where the format has them, a wrong declared type is corrected, and media found inside other bytes are carved out.

Defined results: null text counts as empty text; an empty payload is padded to one block. Bytes
that no validator accepts have the type `application/octet-stream`. Overlapping finds: the
leftmost valid one wins, then the longer. Equal bytes give equal values. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import batch, lean

BLOCK = 576
PAD = 255
TAIL = 32
WIDTH = 24

#: Magic bytes, where they stand from the start, and the formats that they may begin.
MAGIC = (
    (b"RIFF", 0, ("audio/wav", "image/webp")),
    (b"BM", 0, ("image/bmp",)),
    (b"\x89PNG\r\n\x1a\n", 0, ("image/png",)),
    (b"GIF87a", 0, ("image/gif",)),
    (b"GIF89a", 0, ("image/gif",)),
    (b"P5", 0, ("image/x-portable-graymap",)),
    (b"AT&TFORM", 0, ("image/vnd.djvu",)),
    (b"\xff\xd8\xff", 0, ("image/jpeg",)),
    (b"OggS", 0, ("application/ogg",)),
    (b"ftyp", 4, ("video/mp4",)),
    (b"%PDF-", 0, ("application/pdf",)),
    (b"PK\x03\x04", 0, ("application/zip",)),
    (b"\x1f\x8b\x08", 0, ("application/gzip",)),
)
#: Boxes that stand at the top of an MP4 file.
BOXES = frozenset((b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"moof", b"mfra", b"sidx", b"styp", b"uuid", b"meta", b"pdin", b"udta"))
UNKNOWN = "application/octet-stream"
STORED = ("audio/wav", "image/bmp", "image/png")


class Find(NamedTuple):
    start: int
    length: int
    kind: str


def pad(payload: bytes) -> bytes:
    return payload + bytes([PAD]) * (-len(payload) % BLOCK if payload else BLOCK)


def write_wav(x: bytes) -> bytes:
    odd = len(x) & 1
    return b"RIFF" + struct.pack("<I", 36 + len(x) + odd) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(x)) + x + b"\0" * odd


def write_bmp(x: bytes) -> bytes:
    """Grey palette, 24 samples to a row (a multiple of 4, so rows need no filling), first row on top."""
    rows, start = len(x) // WIDTH, 14 + 40 + 1024
    palette = b"".join(bytes([i, i, i, 0]) for i in range(256))
    return b"BM" + struct.pack("<IHHI", start + len(x), 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, WIDTH, -rows, 1, 8, 0, len(x), 2835, 2835, 256, 0) + palette + x


def _png_chunk(tag: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))


def write_png(x: bytes) -> bytes:
    rows = np.frombuffer(x, np.uint8).reshape(-1, WIDTH)
    raw = np.hstack([np.zeros((len(rows), 1), np.uint8), rows]).tobytes()
    return b"\x89PNG\r\n\x1a\n" + _png_chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _png_chunk(b"IDAT", zlib.compress(raw, 1)) + _png_chunk(b"IEND", b"")


WRITERS = dict(zip(STORED, (write_wav, write_bmp, write_png), strict=True))


def store(payload: bytes) -> tuple[bytes, str]:
    """The stored form of a padded payload and the type it is declared to have. The declared type
    follows the checksum's next bits and so is often wrong, as in the wild."""
    crc = zlib.crc32(payload)
    return WRITERS[STORED[crc % 3]](payload), STORED[crc // 3 % 3]


def _riff(b: bytes, at: int, form: bytes) -> tuple[int, list[tuple[bytes, int, int]]]:
    """Length and chunks (tag, place, size) of a RIFF file of a form; 0 if they don't fill it."""
    if at + 12 > len(b) or b[at + 8 : at + 12] != form:
        return 0, []
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    i, chunks = at + 12, []
    while end <= len(b) and i + 8 <= end:
        n = struct.unpack_from("<I", b, i + 4)[0]
        chunks.append((b[i : i + 4], i + 8, n))
        i += 8 + n + (n & 1)
    return (end - at if i == end else 0), chunks


def wav_length(b: bytes, at: int) -> int:
    """Chunks must fill the file; the format comes before the data and its block size must agree with channels and bits."""
    length, chunks = _riff(b, at, b"WAVE")
    tags = [t for t, *_ in chunks]
    if not length or b"fmt " not in tags or b"data" not in tags or tags.index(b"fmt ") > tags.index(b"data"):
        return 0
    _, place, n = chunks[tags.index(b"fmt ")]
    if n < 16:
        return 0
    kind, channels, rate, per_second, align, bits = struct.unpack_from("<HHIIHH", b, place)
    plain = kind == 1
    return length if channels and rate and (not plain or align == channels * ((bits + 7) // 8) and per_second == rate * align) else 0


def webp_length(b: bytes, at: int) -> int:
    """Chunks must fill the file, and the first must hold a picture or the extended header."""
    length, chunks = _riff(b, at, b"WEBP")
    if not length or not chunks:
        return 0
    tag, place, n = chunks[0]
    lossy = tag == b"VP8 " and n >= 10 and b[place + 3 : place + 6] == b"\x9d\x01\x2a"
    return length if lossy or tag == b"VP8L" and n >= 5 and b[place] == 0x2F or tag == b"VP8X" and n >= 10 else 0


def jpeg_length(b: bytes, at: int) -> int:
    """Segments from marker to marker up to the end marker, with a frame before the first scan."""
    i, frame, scan = at + 2, False, False
    while i + 4 <= len(b) or b[i : i + 2] == b"\xff\xd9":
        if b[i] != 0xFF:
            return 0
        mark = b[i + 1]
        if mark == 0xD9:
            return i + 2 - at if scan else 0
        if mark == 0xFF:
            i += 1
            continue
        if mark == 1 or 0xD0 <= mark <= 0xD7:
            i += 2
            continue
        n = int.from_bytes(b[i + 2 : i + 4], "big")
        if n < 2 or mark in (0, 0xD8):
            return 0
        frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        i += 2 + n
        if mark == 0xDA:
            if not frame:
                return 0
            scan = True
            while (i := b.find(b"\xff", i)) >= 0 and i + 1 < len(b) and (b[i + 1] == 0 or 0xD0 <= b[i + 1] <= 0xD7):
                i += 2
            if i < 0:
                return 0
    return 0


def _ogg_crc(page: bytes) -> int:
    crc = 0
    for x in page:
        crc ^= x << 24
        for _ in range(8):
            crc = crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1
    return crc & 0xFFFFFFFF


def ogg_length(b: bytes, at: int) -> int:
    """Pages with their checksums, the first of which begins a stream, up to the last that ends one."""
    i, last = at, 0
    while b[i : i + 4] == b"OggS" and i + 27 <= len(b) and not b[i + 4]:
        head = 27 + b[i + 26]
        n = head + sum(b[i + 27 : i + head])
        if i + n > len(b) or i == at and not b[i + 5] & 2:
            break
        page = b[i : i + 22] + b"\0\0\0\0" + b[i + 26 : i + n]
        if _ogg_crc(page) != struct.unpack_from("<I", b, i + 22)[0]:
            break
        i += n
        if b[i - n + 5] & 4:
            last = i - at
    return last


def mp4_length(b: bytes, at: int) -> int:
    """Boxes one behind the other, as long as they are known ones; there must be a description of the film."""
    i, seen = at, set()
    while i + 8 <= len(b) and b[i + 4 : i + 8] in BOXES:
        n = int.from_bytes(b[i : i + 4], "big")
        if n == 1 and i + 16 <= len(b):
            n = int.from_bytes(b[i + 8 : i + 16], "big")
        elif n == 0:
            n = len(b) - i
        if n < 8 or i + n > len(b):
            break
        seen.add(b[i + 4 : i + 8])
        i += n
    return i - at if {b"ftyp", b"moov"} <= seen else 0


def pdf_length(b: bytes, at: int) -> int:
    """Up to the last end mark, before another file begins, whose reference leads to a cross-reference table or stream."""
    if not b[at + 5 : at + 8].replace(b".", b"").isdigit():
        return 0
    stop, i, last = b.find(b"%PDF-", at + 5), at, 0
    while (i := b.find(b"%%EOF", i + 5)) >= 0 and (stop < 0 or i < stop):
        words = bytes(b[max(at, i - 64) : i]).split()
        if len(words) >= 2 and words[-2] == b"startxref" and words[-1].isdigit() and len(words[-1]) < 12:
            place = at + int(words[-1])
            target = bytes(b[place : place + 32]).split()
            if place < i and (target[:1] == [b"xref"] or len(target) > 2 and target[0].isdigit() and target[2].startswith(b"obj")):
                last = i + 5 - at
    return last


def zip_length(b: bytes, at: int) -> int:
    """Up to an end record whose directory stands right before it, counts its entries, and finds each entry's local header."""
    i = at
    while (i := b.find(b"PK\x05\x06", i + 1)) >= 0 and i + 22 <= len(b):
        disk, first_disk, here, entries, size, offset, comment = struct.unpack_from("<HHHHIIH", b, i + 4)
        place = at + offset
        if disk or first_disk or here != entries or not entries or place + size != i or i + 22 + comment > len(b):
            continue
        for _ in range(entries):
            if b[place : place + 4] != b"PK\x01\x02" or place + 46 > i:
                break
            name, extra, note = struct.unpack_from("<HHH", b, place + 28)
            local = at + struct.unpack_from("<I", b, place + 42)[0]
            if b[local : local + 4] != b"PK\x03\x04":
                break
            place += 46 + name + extra + note
        else:
            if place == i:
                return i + 22 + comment - at
    return 0


def gzip_length(b: bytes, at: int) -> int:
    """One member, which decompresses to what its checksum and size say; held in pieces of a megabyte."""
    d, rest = zlib.decompressobj(31), bytes(b[at:])
    try:
        while not d.eof:
            out = d.decompress(rest, 1 << 20)
            rest = d.unconsumed_tail
            if not out and not rest and not d.eof:
                return 0
    except zlib.error:
        return 0
    return len(b) - at - len(d.unused_data) - len(rest)


def bmp_length(b: bytes, at: int) -> int:
    if at + 54 > len(b):
        return 0
    size, a, c, start, header, w, h, planes, bits = struct.unpack_from("<IHHIIiiHH", b, at + 2)
    if a or c or header != 40 or planes != 1 or bits not in (1, 4, 8, 24, 32) or w <= 0 or h == 0 or at + size > len(b):
        return 0
    return size if size == start + (w * bits + 31) // 32 * 4 * abs(h) and start >= 54 else 0


def png_length(b: bytes, at: int) -> int:
    i, first = at + 8, True
    while i + 12 <= len(b):
        n = int.from_bytes(b[i : i + 4], "big")
        tag = b[i + 4 : i + 8]
        if i + 12 + n > len(b) or first != (tag == b"IHDR") or zlib.crc32(memoryview(b)[i + 4 : i + 8 + n]) != int.from_bytes(b[i + 8 + n : i + 12 + n], "big"):
            return 0
        i, first = i + 12 + n, False
        if tag == b"IEND":
            return i - at
    return 0


def gif_length(b: bytes, at: int) -> int:
    if at + 13 > len(b):
        return 0
    i = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)

    def blocks(i: int) -> int:
        while i < len(b) and b[i]:
            i += 1 + b[i]
        return i + 1

    while i < len(b):
        if b[i] == 0x3B:
            return i + 1 - at
        if b[i] == 0x21:
            i = blocks(i + 2)
        elif b[i] == 0x2C and i + 10 <= len(b):
            i = blocks(i + 11 + (3 << (b[i + 9] & 7) + 1 if b[i + 9] & 0x80 else 0))
        else:
            return 0
    return 0


def pgm_length(b: bytes, at: int) -> int:
    parts = bytes(b[at : at + 64]).split(None, 3)
    head = bytes(b[at : at + 64])
    if len(parts) < 4 or not all(p.isdigit() and len(p) < 9 for p in parts[1:3]):
        return 0
    top = parts[3].split(None, 1)[0] if parts[3].split(None, 1) else b""
    if not top.isdigit() or not 0 < int(top[:6]) < 256:
        return 0
    start = head.index(top, head.index(parts[2], head.index(parts[1]) + len(parts[1])) + len(parts[2])) + len(top) + 1
    n = start + int(parts[1]) * int(parts[2])
    return n if int(parts[1]) * int(parts[2]) > 0 and at + n <= len(b) else 0


def djvu_length(b: bytes, at: int) -> int:
    """Chunks of the form must fill it."""
    if at + 16 > len(b) or b[at + 12 : at + 16] not in (b"DJVU", b"DJVM", b"PM44", b"BM44"):
        return 0
    n = int.from_bytes(b[at + 8 : at + 12], "big")
    i, end = at + 16, at + 12 + n
    while n >= 4 and i + 8 <= end <= len(b):
        i += 8 + int.from_bytes(b[i + 4 : i + 8], "big")
        i += (i - at) & 1 if i < end else 0
    return 12 + n if n >= 4 and i == end <= len(b) else 0


VALIDATORS = {
    "audio/wav": wav_length, "image/webp": webp_length, "image/bmp": bmp_length, "image/png": png_length, "image/gif": gif_length, "image/x-portable-graymap": pgm_length, "image/vnd.djvu": djvu_length,
    "image/jpeg": jpeg_length, "application/ogg": ogg_length, "video/mp4": mp4_length, "application/pdf": pdf_length, "application/zip": zip_length, "application/gzip": gzip_length,
}
_automaton: list = []


def automaton():
    if not _automaton:
        a = ahocorasick.Automaton()
        for magic, ahead, kinds in MAGIC:
            a.add_word(magic.decode("latin-1"), (len(magic) + ahead, kinds))
        a.make_automaton()
        _automaton.append(a)
    return _automaton[0]


def sniff(b: bytes) -> list[Find]:
    """All valid media in the bytes that do not lie in another, left to right."""
    found, free = [], 0
    spots = sorted((end - n + 1, kind) for end, (n, kinds) in automaton().iter(b.decode("latin-1")) for kind in kinds)
    for start, kind in spots:
        if start >= free and (n := VALIDATORS[kind](b, start)):
            found.append(Find(start, n, kind))
            free = start + n
    return found


def sniff_type(b: bytes) -> str:
    first = sniff(b)[:1]
    return first[0].kind if first and first[0].start == 0 else UNKNOWN


def read_payload(b: bytes, kind: str) -> bytes:
    """The 8-bit samples of a stored form."""
    if kind == "audio/wav":
        i = 12
        while b[i : i + 4] != b"data":
            n = struct.unpack_from("<I", b, i + 4)[0]
            i += 8 + n + (n & 1)
        return b[i + 8 : i + 8 + struct.unpack_from("<I", b, i + 4)[0]]
    if kind == "image/bmp":
        start, = struct.unpack_from("<I", b, 10)
        w, h = struct.unpack_from("<ii", b, 18)
        rows = np.frombuffer(b, np.uint8, abs(h) * ((w + 3) // 4 * 4), start).reshape(abs(h), -1)[:, :w]
        return (rows if h < 0 else rows[::-1]).tobytes()
    if kind == "image/png":
        i, data, w = 8, [], int.from_bytes(b[16:20], "big")
        while b[i + 4 : i + 8] != b"IEND":
            n = int.from_bytes(b[i : i + 4], "big")
            if b[i + 4 : i + 8] == b"IDAT":
                data.append(b[i + 8 : i + 8 + n])
            i += 12 + n
        rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, w + 1)
        if rows[:, 0].any():
            raise ValueError("only unfiltered rows are written here")
        return rows[:, 1:].tobytes()
    raise ValueError(f"no samples in {kind}")


SCHEMA = pa.schema([("doc_id", pa.int64()), ("media", pa.binary()), ("declared", pa.string())])


def to_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, media (stored bytes) and declared type of each row's text."""

    def write(batches):
        for b in batches:
            for i, j, data, at in K.chunks(b.column("text"), 1 << 22):
                rows = [store(pad(data[x:y].tobytes())) for x, y in zip(at[:-1], at[1:], strict=True)]
                yield batch(SCHEMA, b.column("doc_id").slice(i, j - i).cast(pa.int64()), [x for x, _ in rows], [x for _, x in rows])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(write), "doc_id long, media binary, declared string")


def inspect(media: DataFrame) -> DataFrame:
    """For rows (doc_id, media, declared): the sniffed type, whether it corrects the declared one, the carved media, the samples' digests and features."""
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("media_type", pa.string()), ("corrected", pa.bool_()), ("carved", pa.int64()), ("feature", pa.string())])

    def read(batches):
        for b in batches:
            rows = []
            for stored, declared in zip(b.column("media"), b.column("declared").to_pylist(), strict=True):
                m = stored.as_py() or b""
                found = sniff(m)
                kind = found[0].kind if found and found[0].start == 0 else UNKNOWN
                x = read_payload(m, kind) if kind in STORED else b""
                inner = [f for f in sniff(x) if f.length < len(x)] if x else []
                v = np.frombuffer(x, np.uint8)
                counts = np.bincount(v, minlength=256)
                p = counts[counts > 0] / max(len(v), 1)
                edge = int(np.abs(np.diff(v.astype(np.int16))).sum()) if len(v) > 1 else 0
                feature = f"{kind};declared={declared};n={len(v)};mean={counts @ np.arange(256) / max(len(v), 1):.4f};entropy={-(p * np.log2(p)).sum() + 0:.4f};edge={edge / max(len(v) - 1, 1):.4f};inner={','.join(f'{f.kind}@{f.start}+{f.length}' for f in inner)}"
                n = len(x.rstrip(bytes([PAD])))  # the byte 255 never occurs in UTF-8, so all of them at the end are padding
                rows.append((n, len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-TAIL:]), len(m), hashlib.sha256(m).hexdigest(), kind, kind != declared, len(inner), feature))
            yield batch(out, b.column("doc_id"), *(list(zip(*rows, strict=True)) if rows else [[]] * 10))

    return media.mapInArrow(lean(read), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, media_type string, corrected boolean, carved long, feature string")


def media_columns(docs: DataFrame) -> DataFrame:
    return inspect(to_media(docs))
