"""Media against readers that are not the operator's own: the standard library's, and plain parsing here."""

import gzip
import io
import struct
import wave
import zipfile
import zlib

import corpus as B

from foliant.llm import media


def samples_elsewhere(stored: bytes) -> bytes:
    """The samples of a stored form, read without the operator."""
    if stored[:4] == b"RIFF":
        with wave.open(io.BytesIO(stored)) as w:
            assert (w.getnchannels(), w.getsampwidth()) == (1, 1)
            return w.readframes(w.getnframes())
    if stored[:2] == b"BM":
        start, width, height = struct.unpack_from("<I", stored, 10)[0], *struct.unpack_from("<ii", stored, 18)
        assert all(stored[54 + 4 * i : 57 + 4 * i] == bytes([i]) * 3 for i in range(256)) and width % 4 == 0 and height < 0
        return stored[start : start + width * -height]
    i, data, size = 8, b"", None
    while i < len(stored):
        n, tag = struct.unpack_from(">I4s", stored, i)
        body = stored[i + 8 : i + 8 + n]
        assert struct.unpack_from(">I", stored, i + 8 + n)[0] == zlib.crc32(tag + body)
        size = struct.unpack_from(">IIBB", body) if tag == b"IHDR" else size
        data += body if tag == b"IDAT" else b""
        i += 12 + n
    width, height, depth, colour = size
    raw = zlib.decompress(data)
    assert (depth, colour) == (8, 0) and len(raw) == height * (width + 1)
    return b"".join(raw[r * (width + 1) + 1 : (r + 1) * (width + 1)] for r in range(height))


def test_stored_forms_by_other_readers(spark):
    """Every text comes back from its stored bytes, whatever the form."""
    rows = media.to_media(B.frame(spark)).collect()
    assert len(rows) == len(B.rows()) and {bytes(r.media[:2]) for r in rows} == {b"RI", b"BM", b"\x89P"}
    for r in rows:
        b = (B.texts()[r.doc_id] or "").encode()
        assert samples_elsewhere(bytes(r.media)) == b + b"\xff" * (-len(b) % 576 if b else 576)


def jpeg() -> bytes:
    part = lambda mark, body: bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + part(0xDB, bytes(65)) + part(0xC0, bytes([8, 0, 1, 0, 1, 1, 1, 17, 0])) + part(0xDA, bytes([1, 1, 0, 0, 63, 0])) + b"\x12\xff\x00\x34\xff\xd0\x56" + b"\xff\xd9"


def ogg(body: bytes) -> bytes:
    out = b""
    for n, (flags, data) in enumerate(((2, b"head"), (0, body), (4, b"end"))):
        head = struct.pack("<4sBBqIII", b"OggS", 0, flags, n, 7, n, 0) + bytes([1, len(data)])
        crc = 0
        for x in head + data:  # by single bits, the highest first
            for k in range(7, -1, -1):
                top = crc >> 31 & 1
                crc = (crc << 1 | 0) & 0xFFFFFFFF
                if top ^ (x >> k & 1):
                    crc ^= 0x04C11DB7
        out += head[:22] + struct.pack("<I", crc) + head[26:] + data
    return out


def mp4() -> bytes:
    box = lambda kind, body: struct.pack(">I4s", len(body) + 8, kind) + body
    return box(b"ftyp", b"isom\0\0\0\0isom") + box(b"moov", box(b"mvhd", bytes(100))) + box(b"mdat", b"x" * 33)


def pdf() -> bytes:
    body = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\n"
    return body + b"xref\n0 1\n0000000000 65535 f \ntrailer\n<<>>\nstartxref\n%d\n%%%%EOF" % len(body)


def zipped() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", "text " * 50)
        z.writestr("b.bin", bytes(range(256)))
        z.comment = b"note"
    return out.getvalue()


def riff(form: bytes, tag: bytes, body: bytes) -> bytes:
    chunk = tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", len(chunk) + 4) + form + chunk


def every() -> dict[str, bytes]:
    wav = io.BytesIO()
    with wave.open(wav, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(bytes(400))
    return {
        "audio/wav": wav.getvalue(), "image/webp": riff(b"WEBP", b"VP8 ", b"\0\0\0\x9d\x01\x2a\1\0\1\0z"), "image/jpeg": jpeg(), "application/ogg": ogg(b"data" * 9), "video/mp4": mp4(),
        "application/pdf": pdf(), "application/zip": zipped(), "application/gzip": gzip.compress(b"some text " * 40),
        "image/vnd.djvu": b"AT&TFORM" + struct.pack(">I", 4 + 8 + 10 + 8 + 3) + b"DJVUINFO" + struct.pack(">I", 10) + bytes(10) + b"TXTa" + struct.pack(">I", 3) + b"abc",
    }


def test_each_format_is_told_and_measured():
    for kind, b in every().items():
        assert media.sniff(b) == [(0, len(b), kind)], kind
        assert media.sniff(b + b"tail of other bytes")[0] == (0, len(b), kind), kind


def test_carving():
    """All of them, in junk that holds signatures without anything behind them."""
    data, expected = b"", []
    for kind, b in every().items():
        data += b"junk \xff\xd8\xff PK\x03\x04 OggS BM P5 RIFF %PDF- \0\0\0\x08ftyp "
        expected.append((len(data), len(b), kind))
        data += b
    assert media.sniff(data) == expected


def test_damage_is_noticed():
    """Files cut short are never taken for whole, nor such with a wrong checksum or reference."""
    for kind, b in every().items():
        assert not any(f.start == 0 and f.length == len(b) for f in media.sniff(b[:-1])), kind
    bad = {"application/ogg": 40, "application/gzip": -6, "application/pdf": -8, "application/zip": -8, "audio/wav": 32}
    for kind, at in bad.items():
        b = bytearray(every()[kind])
        b[at] ^= 1
        assert media.sniff(bytes(b))[:1] != [(0, len(b), kind)], kind


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "x")], "doc_id long, text string")
    out = media.media_columns(docs).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.payload_bytes) for r in out) == [(0, 1, 576), (1, 0, 576), (2, 0, 576), (2, 0, 576)]
