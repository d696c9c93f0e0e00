"""Coders by round trips, kernels against scalar formulas, and random bytes that must not crash."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.functions import iw44, jb2, raster
from foliant.functions.coder import DOWN, LEARNING, M, P, STEADY, UP, Decoder, Encoder, compress, decompress

rng = np.random.default_rng(5)


def test_states():
    assert len(P) == len(M) == len(UP) == len(DOWN) == 256 and len(STEADY) + len(LEARNING) == 209
    assert (UP[0], DOWN[0], UP[1], DOWN[1], UP[2], DOWN[2], UP[3], DOWN[3], UP[82], DOWN[82], UP[81]) == (84, 145, 3, 4, 4, 3, 5, 1, 82, 80, 81)
    assert all(x < 251 for x in UP + DOWN)


@given(st.lists(st.tuples(st.integers(0, 3), st.booleans()), max_size=300))
def test_bits_round_trip(bits):
    e, states = Encoder(), bytearray(4)
    for at, b in bits:
        e.raw(int(b)) if at == 3 else e.bit(states, at, int(b))
    d, states = Decoder(e.finish()), bytearray(4)
    assert [d.raw() if at == 3 else d.bit(states, at) for at, _ in bits] == [int(b) for _, b in bits]


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=200), st.integers(1, 60))
def test_compression_round_trip(data, block):
    assert decompress(compress(data, block)) == data


def test_compression_of_text():
    data = ("Éauouon. Enpaeux leaux le ouè.\n" * 200).encode()
    packed = compress(data)
    assert len(packed) < len(data) / 20 and decompress(packed) == data
    assert decompress(packed[: len(packed) // 3]) != data


def test_corrupt_streams():
    assert decompress(b"") is None and decompress(b"\xff" * 4) is None and decompress(b"\0" * 40) is None


def marks():
    s = [(rng.random(d) < 0.4).astype(np.uint8) for d in ((5, 7), (9, 3), (1, 1), (12, 20))]
    return [(s[0], 3, 40), (s[1], 20, 41), (s[0], 30, 39), (s[3], 50, 10), (s[2], 5, 5), (s[1], 60, 7)]


def test_marks_round_trip():
    own = marks()
    im = jb2.decode(jb2.encode(100, 60, own))
    assert (im.width, im.height) == (100, 60) and [b[:2] for b in im.blits] == [(x, y) for _, x, y in own]
    assert all((im.shape(b[2]) == m[0]).all() for b, m in zip(im.blits, own, strict=True))
    assert im.histogram[jb2.COPY] == 2 and im.histogram[jb2.MARK] == 4


def test_dictionary():
    own = marks()
    base = jb2.decode(jb2.encode(0, 0, [(m, 0, 0) for m, *_ in own]), is_image=False)
    im = jb2.decode(jb2.encode(100, 60, own, base), base)
    assert not im.shapes and im.inherited and [b[:2] for b in im.blits] == [(x, y) for _, x, y in own]
    with pytest.raises(jb2.Broken):
        jb2.decode(jb2.encode(100, 60, own, base))
    with pytest.raises(jb2.Broken):
        jb2.decode(jb2.encode(100, 60, own), is_image=False)


def test_refinement():
    first, second = (rng.random((9, 11)) < 0.5).astype(np.uint8), (rng.random((8, 13)) < 0.5).astype(np.uint8)
    first[0, 0] = first[-1, -1] = 1
    c = jb2.Codec(Encoder())
    c.number(jb2.START, jb2.END, "record", jb2.START)
    c.start(True, (60, 40))
    c.number(jb2.START, jb2.END, "record", jb2.MARK)
    c.number(0, jb2.LARGEST, "width", 11)
    c.number(0, jb2.LARGEST, "height", 9)
    c.plain(11, 9, first)
    c.add(first, -1, True, c.place(11, 9, (4, 5)))
    c.number(jb2.START, jb2.END, "record", jb2.REFINE)
    c.number(0, 0, "match", 0)
    c.number(jb2.SMALLEST, jb2.LARGEST, "width change", 2)
    c.number(jb2.SMALLEST, jb2.LARGEST, "height change", -1)
    c.refined(13, 8, 0, second)
    c.add(second, 0, True, c.place(13, 8, (20, 6)))
    c.number(jb2.START, jb2.END, "record", jb2.END)
    im = jb2.decode(c.coder.finish())
    assert (im.shapes[0] == first).all() and (im.shapes[1] == second).all() and im.parents == [-1, 0]
    assert im.blits == [(4, 5, 0), (20, 6, 1)]


@settings(max_examples=60, deadline=None)
@given(st.integers(-1000, 1000), st.integers(0, 500), st.integers(0, 500))
def test_numbers(value, below, above):
    c = jb2.Codec(Encoder())
    c.number(value - below, value + above, "n", value)
    c.number(value - below, value + above, "n", value)
    d = jb2.Codec(Decoder(c.coder.finish()))
    assert [d.number(value - below, value + above, "n") for _ in range(2)] == [value] * 2


def test_random_bytes_never_crash():
    for _ in range(150):
        data = rng.integers(0, 256, 80).astype(np.uint8).tobytes()
        for make in (lambda d: jb2.decode(d), lambda d: iw44.decode([b"\0\x0a\x01\x02\0\x14\0\x14\x0a" + d])):
            try:
                make(data)
            except (jb2.Broken, iw44.Broken):
                pass


class Tape:
    """Answers a layer's questions at random and writes the answers down."""

    def __init__(self, seed):
        self.encoder, self.random = Encoder(), np.random.default_rng(seed)

    def bit(self, states, at):
        return self.encoder.bit(states, at, int(self.random.random() < 0.4))

    def raw_wavelet(self):
        b = int(self.random.random() < 0.5)
        self.encoder.split(0x8000 + (3 * self.encoder.a >> 3), bool(b))
        return b


def test_layer_round_trip():
    plane, tape = iw44.Plane(70, 40), Tape(1)
    for _ in range(40):
        plane.slice(tape)
    layer = iw44.decode([bytes([0, 40, 0x81, 2, 0, 70, 0, 40, 0]) + tape.encoder.finish()])
    assert (layer.planes[0].coefficients() == plane.coefficients()).all() and plane.coefficients().any()
    assert layer.rgb().shape == (40, 70, 3) and (layer.gray()[::-1].astype(int) - 128 == 127 - layer.rgb()[..., 0].astype(int)).mean() > 0.5


def test_layer_rules():
    head = bytes([0, 0, 1, 2, 0, 34, 0, 17, 0x8A])
    layer = iw44.decode([head])
    assert (layer.width, layer.height, layer.delay, layer.half, len(layer.planes)) == (34, 17, 10, False, 3)
    for bad in ([], [b"\0"], [b"\x01\0" + head[2:]], [b"\0\0\x02\x02" + head[4:]], [head, head], [head[:4] + b"\xff\xff\xff\xff\0"]):
        with pytest.raises(iw44.Broken):
            iw44.decode(bad)


@pytest.mark.parametrize("n", range(1, 24))
def test_lifting_against_scalar(n):
    x = rng.integers(-500, 500, n)
    v, get = x.tolist(), lambda i: v[i] if 0 <= i < n else 0
    for i in range(0, n, 2):
        v[i] -= (9 * (get(i - 1) + get(i + 1)) - get(i - 3) - get(i + 3) + 16) >> 5
    for i in range(1, n, 2):
        inner = i >= 3 and i + 3 < n
        v[i] += (9 * (v[i - 1] + v[i + 1]) - v[i - 3] - v[i + 3] + 8) >> 4 if inner else (v[i - 1] + (v[i + 1] if i + 1 < n else v[i - 1]) + 1) >> 1
    y = x.astype(np.int16)
    iw44.lift(y)
    assert y.tolist() == v


def test_fixed_kernels():
    assert iw44.PLACES[:8].tolist() == [0, 16, 512, 528, 8, 24, 520, 536] and sorted(iw44.PLACES) == list(range(1024))
    assert raster.coordinates(4, 12, 1, 3).tolist() == [-5, 0, 6, 11, 16, 22, 27, 32, 38, 43, 48, 48]
    assert raster.coordinates(3, 12, 1, 4).tolist() == [-6, -2, 2, 6, 10, 14, 18, 22, 26, 30, 32, 32]
    assert raster.gamma_table(1.8)[[0, 1, 64, 128, 200, 255]].tolist() == [0, 3, 82, 145, 209, 255]
    assert raster.coverage_gray(np.arange(10), 3).tolist() == [255, 227, 199, 170, 142, 114, 85, 57, 29, 0]
    a = [np.array(x, np.int8) for x in ([0, -5, 127, 10], [0, -5, -128, 20], [0, -5, 127, -30])]
    assert iw44.ycbcr_to_rgb(*a).tolist() == [[128, 128, 128], [115, 129, 115], [255, 192, 31], [93, 156, 173]]


@pytest.mark.parametrize(("limit", "count", "source", "target"), [(9, 30, 3, 10), (40, 17, 7, 3), (5, 60, 1, 12)])
def test_coordinates_by_recurrence(limit, count, source, target):
    place, rest, out = (16 * source + target) // (2 * target) - 8, target // 2, []
    for _ in range(count):
        out.append(min(place, (limit - 1) * 16))
        rest += 16 * source
        place, rest = place + rest // target, rest % target
    assert raster.coordinates(limit, count, source, target).tolist() == out


def test_runs_and_packing():
    b = (rng.random((7, 33)) < 0.4).astype(np.uint8)
    again = np.zeros_like(b)
    for y, x0, x1 in raster.runs(b).tolist():
        again[y, x0:x1] += 1
    assert (again == b).all() and (raster.unpack(raster.pack(b), 33, 7) == b).all()
    wide = np.zeros((1, 40000), np.uint8)
    wide[0, 20000:39000] = 1
    assert (raster.unpack(raster.pack(wide), 40000, 1) == wide).all()


def test_median():
    assert [jb2.median3(*x) for x in ((1, 2, 3), (3, 1, 2), (2, 2, 1), (5, 5, 5))] == [2, 2, 2, 5]


def test_jb2_beyond_the_bound_of_records(monkeypatch):
    """A stream cut by the bound is broken, not a partial image."""
    data = jb2.encode(100, 60, [(np.ones((3, 3), np.uint8), x, 5) for x in range(0, 40, 4)])
    records = sum(jb2.decode(data).histogram)
    monkeypatch.setattr(jb2, "RECORDS", records)
    assert len(jb2.decode(data).blits) == 10
    monkeypatch.setattr(jb2, "RECORDS", records - 1)
    with pytest.raises(jb2.Broken):
        jb2.decode(data)
