"""A container writer for tests and for queries that pack table rows before decoding them.

It is no part of the engine's interface: the engine decodes only.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from foliant.functions.coder import compress
from foliant.functions.streams import compress_all


def chunk(name: str, payload: bytes) -> bytes:
    return name.encode("latin-1") + struct.pack(">I", len(payload)) + payload + b"\0" * (len(payload) & 1)


def form(kind: str, *chunks: bytes) -> bytes:
    body = b"".join(chunks)
    return b"FORM" + struct.pack(">I", len(body) + 4) + kind.encode() + body


def single(*chunks: bytes, kind: str = "DJVU") -> bytes:
    return b"AT&T" + form(kind, *chunks)


def info(width: int, height: int, version: int = 26, dpi: int = 300, gamma: int = 22, flags: int = 1) -> bytes:
    return chunk("INFO", struct.pack(">HHBBHBB", width, height, version, 0, int.from_bytes(struct.pack("<H", dpi), "big"), gamma, flags))


def u24(n: int) -> bytes:
    return n.to_bytes(3, "big")


def s16(n: int) -> bytes:
    return struct.pack(">H", n + 0x8000)


def zone(kind: int, x: int, y: int, w: int, h: int, offset: int, length: int, *children: bytes) -> bytes:
    """A zone record as stored: offsets relative to the zone before it."""
    return bytes([kind]) + b"".join(map(s16, (x, y, w, h, offset))) + u24(length) + u24(len(children)) + b"".join(children)


def text_payload(text: bytes, root: bytes = b"") -> bytes:
    return u24(len(text)) + text + b"\x01" + root


def bookmark(title: str, url: str, *children: bytes) -> bytes:
    t, u = title.encode(), url.encode()
    return bytes([len(children)]) + u24(len(t)) + t + u24(len(u)) + u + b"".join(children)


def outline(total: int, *nodes: bytes) -> bytes:
    return chunk("NAVM", compress(struct.pack(">H", total) + b"".join(nodes)))


def quoted(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'


def bundle(components: list[tuple[str, str | None, int, bytes]], *root: bytes) -> bytes:
    """A document of components (id, title, type, form), with further chunks in the root."""
    flags = bytes(kind | (0x40 if title is not None else 0) for _, title, kind, _ in components)
    names = b"".join(i.encode() + b"\0" + (title.encode() + b"\0" if title is not None else b"") for i, title, _, _ in components)
    packed = compress(b"".join(u24(len(f)) for *_, f in components) + flags + names)
    size = 3 + 4 * len(components) + len(packed)
    at = 16 + 8 + size + (size & 1) + sum(map(len, root))
    offsets = []
    for *_, f in components:
        offsets.append(at)
        at += len(f) + (len(f) & 1)
    head = chunk("DIRM", struct.pack(">BH", 0x81, len(components)) + struct.pack(f">{len(components)}I", *offsets) + packed)
    return single(head, *root, *[f + b"\0" * (len(f) & 1) for *_, f in components], kind="DJVM")


FILES = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])


def _spread(table: DataFrame) -> DataFrame:
    """Dealt out over all cores, as a small table is one file."""
    return table.repartition(table.sparkSession.sparkContext.defaultParallelism)


def _files(files: list[tuple[str, bytes]]):
    for i in range(0, len(files), 256):
        part = files[i : i + 256]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in part], pa.string()), pa.array([None if c is None else len(c) for _, c in part], pa.int64()), pa.array([c for _, c in part], pa.binary())], schema=FILES)


def pack(table: DataFrame, make: Callable[..., tuple[str, bytes]]) -> DataFrame:
    """Files (path, length, content) made from the rows of a table by make(**row)."""
    names = table.columns

    def run(batches):
        for b in batches:
            yield from _files([make(*r) for r in zip(*(b.column(n).to_pylist() for n in names), strict=True)])

    return _spread(table).mapInArrow(run, "path string, length long, content binary")


def pack_streams(table: DataFrame) -> DataFrame:
    """Files (path, length, content) of a table's first column as a name and its second, a text, as a block-sorted stream; null stays null."""
    name, text = table.columns

    def run(batches):
        for b in batches:
            texts = b.column(text).to_pylist()
            streams = iter(compress_all([x.encode() for x in texts if x is not None]))
            names = [None if x is None else str(x) for x in b.column(name).to_pylist()]
            yield from _files([(x, None if t is None else next(streams)) for x, t in zip(names, texts, strict=True)])

    return _spread(table).mapInArrow(run, "path string, length long, content binary")
