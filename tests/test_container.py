"""The reader against hand-assembled bytes and malformed input."""

import pytest

from foliant.functions import text as T
from foliant.plans import fixtures as X
from foliant.sources import container as C

INFO = bytes.fromhex("006400321a002c011601")
TEXT = bytes.fromhex("000005486920796f01018000800080648032800000000500000105800a8014803c800a800000000500000206800080008019800a800000000200000006800a8002801980088001000002000000")
NOTE = b'(maparea "#2" "next" (rect 10 20 30 5) (xor))'
FILE = b"AT&TFORM\0\0\0\xa2DJVU" + X.chunk("INFO", INFO) + X.chunk("TXTa", TEXT) + X.chunk("ANTa", NOTE)


def test_info():
    i = C.info(INFO)
    assert (i.width, i.height, i.version, i.dpi, i.gamma, i.rotation) == (100, 50, 26, 300, 2.2, 0)
    assert [C.info(INFO[:-1] + bytes([b])).rotation for b in (6, 2, 5)] == [90, 180, 270]
    assert C.info(INFO[:4]) is None
    short = C.info(bytes.fromhex("0064003218"))
    assert (short.width, short.height, short.version, short.dpi, short.rotation) == (100, 50, 24, 300, 0)


def test_whole_file():
    assert len(FILE) == 174
    d = C.open_document(FILE)
    assert d.error is None and len(d.pages) == 1
    assert [(c.id, c.size, c.offset) for c in C.chunks(FILE, d.root)] == [("INFO", 10, 16), ("TXTa", 77, 34), ("ANTa", 45, 120)]


def test_zones():
    z = T.zones(TEXT, 50)
    assert [(x.type, x.x, x.y, x.w, x.h) for x in z] == [(1, 0, 0, 100, 50), (5, 10, 20, 60, 10), (6, 10, 20, 25, 10), (6, 45, 20, 25, 8)]
    assert [x.text for x in z[2:]] == ["Hi", "yo"]
    assert [(x.zone_id, x.parent_id, x.depth, x.ordinal) for x in z] == [(0, None, 0, 0), (1, 0, 1, 0), (2, 1, 2, 0), (3, 1, 2, 1)]


def test_sibling_rules():
    region = X.zone(1, 0, 0, 90, 80, 0, 0, X.zone(3, 5, 5, 10, 10, 0, 0), X.zone(3, 7, 9, 10, 10, 0, 0))
    z = T.zones(X.text_payload(b"", region), 80)
    assert (z[2].x, z[2].y) == (7, 80 - 9 - 10)  # a region leaves its younger sibling where it says
    column = X.zone(1, 0, 0, 90, 80, 0, 0, X.zone(2, 5, 5, 10, 10, 0, 0), X.zone(2, 7, 1, 10, 10, 0, 0))
    z = T.zones(X.text_payload(b"", column), None)
    assert (z[2].x, z[2].y) == (5 + 10 + 7, 80 - (80 - 15 + 1) - 10)


def test_links():
    (x,) = T.links(NOTE.decode(), 50)
    assert (x.url, x.comment, x.shape, x.x, x.y, x.w, x.h) == ("#2", "next", "rect", 10, 25, 30, 5)
    assert T.links('(maparea (url "u" "_top") "" (oval 1 2 3 4))', 10)[0].comment is None
    assert T.links('(x (maparea (rect 1 2 3 4) "u" "c"))', 10)[0].url == "u"
    for bad in ('(maparea "" "" (rect 1 2 3 4))', '(maparea "u" "" (poly 1 2 3 4))', '(maparea "u" "" (rect 1 2 3))', '(maparea "u")'):
        assert not T.links(bad, 10)
    assert T.links('(maparea "u\\"\\n" "c" (text 1 2 3 4', 10)[0].url == 'u"\n'  # unterminated


def test_outline():
    payload = bytes.fromhex("0002010000014100000223310000000142000003237032")
    assert [(n.title, n.url, n.parent_id) for n in T.outline(payload)] == [("A", "#1", None), ("B", "#p2", 0)]
    more = b"\0\x05" + payload[2:]
    assert len(T.outline(more)) == 2  # fewer nodes than announced
    broken = b"\0\x05" + payload[2:] + X.bookmark("C", "", X.bookmark("D", ""))[:-3]
    assert [n.title for n in T.outline(broken)] == ["A", "B"]


def test_wavelet_header_and_palette():
    i = C.wavelet_info(bytes.fromhex("00640102002200118a"))
    assert (i.width, i.height, i.dpi) == (34, 17, 100)
    assert C.palette(bytes.fromhex("000002ff0000010203")).colours == [(0, 0, 255), (3, 2, 1)]
    assert C.palette(b"\0\0\x05abc") is None
    with_index = b"\x80\0\x01abc\0\0\x02" + X.compress(b"\0\0\0\x01")
    assert C.palette(with_index).indices == [0, 1]


@pytest.mark.parametrize("data", [b"", b"AT&TFORM", b"x" * 40, X.single(kind="DJVX"), X.single(kind="DJVM"), X.single(X.chunk("DIRM", b"\x81\0\0"), kind="DJVM"), X.single(X.chunk("DIRM", b"\x81\0\x09"), kind="DJVM")])
def test_errors(data):
    assert C.open_document(data + b"\0" * (16 - len(data) if 0 < len(data) < 16 else 0)).error


def test_bundle_and_includes():
    shared = X.form("DJVI", X.chunk("ANTa", NOTE), X.chunk("Djbz", b"dict"))
    page = X.form("DJVU", X.info(10, 20), X.chunk("INCL", b"nowhere"), X.chunk("INCL", b"dict.djvi \n"))
    data = X.bundle([("dict.djvi", None, 0, shared), ("one.djvu", "First", 1, page), ("two.djvu", None, 1, X.form("DJVU"))])
    d = C.open_document(data)
    assert d.error is None and [(c.id, c.title, c.type) for c in d.components] == [("dict.djvi", None, 0), ("one.djvu", "First", 1), ("two.djvu", None, 1)]
    assert [(p.no, p.id, p.title) for p in d.pages] == [(0, "one.djvu", "First"), (1, "two.djvu", None)]
    own = list(C.chunks(data, d.pages[0].offset))
    assert C.annotation(d, data, own) == NOTE
    assert C.payload(data, C.included(d, data, own, "Djbz")[0]) == b"dict"
    assert C.page_info(data, list(C.chunks(data, d.pages[1].offset))) is None


def test_indirect_has_no_pages():
    data = X.single(X.chunk("DIRM", b"\x01\0\x01" + X.compress(b"\0\0\0\x01a\0")), kind="DJVM")
    d = C.open_document(data)
    assert d.error is None and not d.pages and d.components[0].id == "a"


def test_sizes_are_clamped():
    data = b"FORM\0\0\1\0DJVUINFO\xff\xff\xff\xef" + INFO
    (c,) = C.chunks(data, 0)
    assert c.size == 10
    assert T.text_bytes(b"\xff\xff\xffab") == b"ab"


def test_text_rules():
    both = X.form("DJVU", X.chunk("TXTa", X.text_payload(b"plain")), X.chunk("TXTz", b"\xff" * 9))
    assert C.text_payload(both, list(C.chunks(both, 0))) is None  # a broken stream doesn't fall back
    cut = X.text_payload(b"abc", X.zone(1, 0, 0, 9, 9, 0, 3))
    assert T.zones(cut[:-3], 9) == [] and T.text_bytes(cut[:-3]) == b"abc"
    half = T.zones(X.text_payload("é".encode(), X.zone(1, 0, 0, 9, 9, 0, 1)), 9)
    assert half[0].text == "�"
    deep = X.zone(1, 0, 0, 1, 1, 0, 0)
    for _ in range(80):
        deep = X.zone(1, 0, 0, 1, 1, 0, 0, deep)
    assert T.zones(X.text_payload(b"", deep), 9) == []
    assert T.expressions("(" * 500)  # deep nesting ends early


def test_bad_info_keeps_page():
    data = X.single(X.chunk("INFO", b"ab"), X.chunk("BG44", bytes.fromhex("00640102002200118a")))
    assert C.page_info(data, list(C.chunks(data, 4))) is None
