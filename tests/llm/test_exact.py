"""Operators with one right answer, against brute force on the awkward corpus."""

import hashlib
import zlib

import corpus as B
import numpy as np
import pytest

from foliant.llm import decontaminate, licenses, lines, media, ngram_join, packing, rindex, segments, substring


@pytest.fixture(scope="module")
def docs(spark):
    return B.frame(spark).cache()


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def pairs():
    return [(r[0], r[1]) for r in B.rows()]


def test_ngram_join(docs, monkeypatch):
    for cell in (2 << 20, 3000):  # the second deals cells out in blocks
        monkeypatch.setattr(ngram_join, "CELL", cell)
        out = ngram_join.ngram_components(docs).collect()
        assert len(out) == len(B.rows())
        last = 1 << 40
        expected = B.component_of({(last if i is None else i): t for i, t in B.texts().items()})
        for r in out:
            i = last if r.doc_id is None else r.doc_id
            assert (last if r.component_id is None else r.component_id) == expected[i], i
        sizes = {i: len(B.shingles(t)) for i, t in B.texts().items()}
        assert all(r.n_shingles == sizes[r.doc_id] for r in out)


def test_keep_one(docs):
    out = ngram_join.keep_one(docs)
    assert out.columns == docs.columns
    last = 1 << 40
    part = B.component_of({(last if i is None else i): t for i, t in B.texts().items()})
    assert sorted(last if r.doc_id is None else r.doc_id for r in out.collect()) == sorted(set(part.values()))


@pytest.mark.parametrize("crowd", [1000, 3])
@pytest.mark.parametrize(("window", "anchor"), [(35, 10), (12, 4)])
def test_substring(docs, monkeypatch, window, anchor, crowd):
    monkeypatch.setattr(segments, "CROWD", crowd)
    out = substring.substring_dedup(docs, window=window, anchor=anchor, with_text=True).collect()
    expected = B.groups((i, v) for (i, _), v in B.kept_words(pairs(), window).items())
    assert len(out) == len(B.rows())
    for r in out:
        ((n, removed, kept),) = expected[r.doc_id]
        assert (r.n_words, r.n_removed, r.text, r.kept_sha256) == (n, removed, kept, sha(kept)), r.doc_id
        assert all(f.words >= window and f.start + f.words <= n for f in r.factors)


def test_factors():
    a = np.array
    # windows 3..6 continue one stretch, then the reference changes at window 5, so a factor starts there
    got = substring.parse(a([3, 4, 5, 6]), a([1, 1, 1, 1]), a([9, 9, 8, 8]), a([10, 11, 0, 1]), 35)
    assert got == [(3, 36, 9, 10), (5, 36, 8, 0)]


@pytest.mark.parametrize("crowd", [1000, 3])
@pytest.mark.parametrize(("length", "anchor"), [(100, 48), (30, 12)])
def test_suffix(docs, monkeypatch, length, anchor, crowd):
    monkeypatch.setattr(segments, "CROWD", crowd)
    out = rindex.suffix_dedup(docs, length=length, anchor=anchor).collect()
    expected = B.groups((i, v) for (i, _), v in B.kept_bytes(set(pairs()), length).items())
    assert len(out) == len(B.rows())
    for r in out:
        ((n, removed, spans, kept),) = expected[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, spans, sha(kept)), r.doc_id
        assert sum(s.bytes for s in r.spans) == removed and len(r.spans) == spans


def test_run_index_random():
    rng = np.random.default_rng(4)
    for _ in range(60):
        length, alphabet = int(rng.integers(3, 9)), b"ab\0c"
        base = bytes(rng.choice(list(alphabet), 60).astype(np.uint8))
        parts = []
        for _ in range(int(rng.integers(1, 12))):
            a = int(rng.integers(0, 40))
            x = bytearray(base[a : a + int(rng.integers(length, 20))])
            x[int(rng.integers(len(x)))] = 97
            parts.append(bytes(x))
        doc, off = rng.integers(0, 5, len(parts)), np.arange(len(parts)) * 1000
        first = {}
        for p, d, o in zip(parts, doc.tolist(), off.tolist(), strict=True):
            for k in range(len(p) - length + 1):
                w = p[k : k + length]
                first[w] = min(first.get(w, (9, 0)), (d, o + k))
        expected = [(i, k) for i, p in enumerate(parts) for k in range(len(p) - length + 1) if first[p[k : k + length]] < (doc[i], off[i] + k)]
        which, at = rindex.earlier_windows(parts, doc, off, length, length - 1)
        assert list(zip(which.tolist(), at.tolist(), strict=True)) == expected


def test_lines(docs):
    out = lines.line_dedup(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    expected = B.groups((i, v) for (i, _), v in B.kept_lines(set(pairs())).items())
    got = out.collect()
    assert len(got) == len(B.rows())
    for r in got:
        assert (r.n_lines, r.n_removed, r.text) == expected[r.doc_id][0], r.doc_id
    assert any(r.n_removed for r in got)


def test_media(docs):
    out = media.media_columns(docs).collect()
    by = B.texts()
    assert len(out) == len(B.rows())
    for r in out:
        b = (by[r.doc_id] or "").encode()
        p = b + b"\xff" * (-len(b) % 576 if b else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), sha(p), zlib.crc32(p[-32:]))
        stored, declared = media.store(p)
        assert (r.media_bytes, r.media_sha256, r.media_type) == (len(stored), sha(stored), media.sniff_type(stored)) and r.corrected == (declared != r.media_type)


def test_sniffing():
    x = media.pad(b"abc")
    wav, bmp, png = media.write_wav(x), media.write_bmp(x), media.write_png(x)
    for b, kind in ((wav, "audio/wav"), (bmp, "image/bmp"), (png, "image/png")):
        assert media.sniff(b) == [(0, len(b), kind)] and media.read_payload(b, kind) == x
        assert media.sniff(b[:-1]) == [] and media.sniff_type(b"BM" + b) == media.UNKNOWN
    gif = b"GIF89a\x01\0\x01\0\x80\0\0" + b"\0" * 6 + b"!\xf9\x04\0\0\0\0\0,\0\0\0\0\x01\0\x01\0\0\x02\x02L\x01\0;"
    pgm, djvu = b"P5\n2 2\n255\nabcd", b"AT&TFORM\0\0\0\x04DJVU"
    mixed = b"junk" + png + b"BM??" + gif + pgm + b"RIFF" + djvu + b"\0\0\0\0"
    assert [(f.kind, f.length) for f in media.sniff(mixed)] == [("image/png", len(png)), ("image/gif", len(gif)), ("image/x-portable-graymap", len(pgm)), ("image/vnd.djvu", 16)]
    bad = bytearray(png)
    bad[40] ^= 1
    assert media.sniff(bytes(bad)) == []
    inside = media.write_wav(media.pad(pgm + gif))
    assert len(media.sniff(inside)) == 1 and len(media.sniff(media.read_payload(inside, "audio/wav"))) == 2


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    by = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], np.uint32) for i, t in B.texts().items()}
    out = packing.pack(docs.coalesce(1), path).collect()
    repeats = B.groups((r[0], 1) for r in B.rows())
    seen = B.groups(((r.doc_id, r.start, r.length), r) for r in out)
    for i, ids in by.items():
        own = sorted({k[1:] for k in seen if k[0] == i})
        pieces = sum(len(seen[(i, *k)]) * k[1] for k in own)
        assert pieces == len(ids) * len(repeats[i])
    for r in out:
        ids = by[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(by[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids.astype("<u4").tobytes()) and bytes(r.ids) == ids.astype("<u4").tobytes()
    padding = 0
    for rows in B.groups((r.sequence_id, r) for r in out).values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == np.cumsum([0, *(r.length for r in rows)])[:-1].tolist()
        n = sum(r.length for r in rows)
        assert n <= 2048
        padding += 2048 - n if n & (n - 1) else 0
    assert padding < 0.03 * sum(r.length for r in out)


def test_cuts_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n, window = int(rng.integers(1, 60)), 16
        sentences, documents = np.unique(rng.integers(1, n + 1, 8)), np.unique(rng.integers(1, n + 1, 3))
        cost = {p: packing.MID_SENTENCE for p in range(packing.GRID, n, packing.GRID)} | {p: packing.MID_SENTENCE for p in range(window, n, window)}
        cost |= {int(p): packing.MID_DOCUMENT for p in sentences} | {int(p): 0 for p in documents} | {n: 0}
        best = {0: 0}
        for p in sorted(cost):
            best[p] = min((best[q] + window - (p - q) for q in best if p - window <= q < p), default=10**9) + cost[p]
        ends = packing.choose_cuts(n, sentences, documents, window)
        assert ends[-1] == n and ends == sorted(set(ends))
        total = sum(window - (b - a) + cost.get(b, packing.MID_SENTENCE) for a, b in zip([0, *ends], ends, strict=False) if (b - a) & (b - a - 1))
        total += sum(cost.get(b, packing.MID_SENTENCE) for a, b in zip([0, *ends], ends, strict=False) if not (b - a) & (b - a - 1))
        assert total <= best[n]


def test_licenses(spark):
    t = licenses.TEMPLATES
    long = t["MIT"][2]
    words = long.split()
    edited = " ".join("other" if i % 40 == 17 else w for i, w in enumerate(words))
    data = [(1, f"x y z.\n{t['Apache-2.0'][0]}"), (2, None), (3, ""), (4, B.prose(300)), (5, f"{B.prose(40)} {long} {B.prose(40)}"), (6, f"{B.prose(40)} {edited} {B.prose(9)}"), (7, t["MIT"][0].upper()), (7, t["MIT"][0].upper()), (None, t["CC-BY-NC-4.0"][0]), (9, " ".join(words[: len(words) // 2]))]
    out = licenses.license_scan(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.license) for r in out) == [(0, "CC-BY-NC-4.0"), (1, "Apache-2.0"), (5, "MIT"), (6, "MIT"), (7, "MIT"), (7, "MIT")]
    assert next(r for r in out if r.doc_id == 1).start_word == 3
    six = next(r for r in out if r.doc_id == 6)
    own = [w.lower().strip('.,()"') for w in words]
    assert 0.8 <= six.containment < 1 and len(own)


def test_license_recall():
    """Edited notices that keep 0.8 of their shingles are found, wherever they are."""
    rng, lib, found, total = np.random.default_rng(1), licenses.Library(licenses.TEMPLATES), 0, 0
    notices = [(n, bytes(licenses.PLAIN[np.frombuffer(t.encode(), np.uint8)]).decode().split()) for n, ts in licenses.TEMPLATES.items() for t in ts]
    for _ in range(300):
        name, plain = notices[rng.integers(len(notices))]
        words = list(plain)
        for _ in range(rng.integers(0, 1 + len(words) // 25)):
            words[rng.integers(len(words))] = "other"
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (plain, words))
        if len(a & b) >= 0.8 * len(a):
            data = np.frombuffer(f"{B.prose(30)} {' '.join(words)} {B.prose(30)}".encode(), np.uint8)
            total += 1
            found += any(lib.names[t] == name for _, t, *_ in licenses.find(data, np.array([0, len(data)]), lib))
    assert total > 200 and found >= 0.97 * total


def test_license_lines_of_documents(spark):
    """Every document with a bare license line has a match of that license, also where the notice is under five words."""
    kinds = {"All rights reserved.": "All rights reserved", "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    lines = {(r.doc_id, kinds[x]) for r in docs.collect() for x in r.text.split("\n") if x in kinds}
    found = {(r.doc_id, r.license) for r in licenses.license_scan(docs).collect()}
    assert {x for _, x in lines} == set(kinds.values()) and lines <= found


def test_short_licenses(spark):
    long = licenses.TEMPLATES["All rights reserved"][0]
    data = [(1, "all RIGHTS reserved"), (2, "all rights"), (3, "reserved"), (4, f"a {long} b"), (5, f"a {long.replace('reproduced', 'sold')} b"), (6, "(c) X. All rights reserved. MIT License. all rights reserved"), (7, "Released under the MIT License.")]
    out = licenses.license_scan(spark.createDataFrame(data, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r.doc_id, r.license, r.start_word, r.n_words) for r in out) == [(1, "All rights reserved", 0, 3), (4, "All rights reserved", 1, 11), (5, "All rights reserved", 1, 10), (6, "All rights reserved", 2, 3), (6, "All rights reserved", 7, 3), (6, "MIT", 5, 2), (7, "MIT", 0, 5)]
    own = licenses.license_scan(spark.createDataFrame(data, "doc_id long, text string"), {"own": ("all rights",)}).collect()
    assert {r.doc_id for r in own} == {1, 2, 4, 5, 6}
    with pytest.raises(ValueError):
        licenses.Library({"none": ("...",)})


def test_decontamination(spark):
    item = "Tom has 5 apples and Ann gives Tom 3 more apples each day for 2 weeks so how many apples does Tom have in the end of it all"
    other = item.replace("Tom", "Max").replace("Ann", "Eve").replace(" 5 ", " 7 ").replace(" 3 ", " 4 ")
    twisted = "Tom has 5 apples and Ann gives Bob 3 more apples each day for 2 weeks so how many apples does Ann have in the end of it all"
    bench = spark.createDataFrame([(1, item), (1, item), (2, "too short"), (3, None), (4, ""), (5, "alpha beta gamma delta epsilon zeta eta theta")], "item_id long, text string")
    data = [(10, f"Intro words here. {item}. And more."), (11, f"Well then, {other}."), (12, f"Well then, {twisted}."), (13, None), (14, ""), (15, B.prose(400)), (16, "is it too short"), (None, item), (18, item), (18, item), (19, "alpha beta gamma delta epsilon zeta eta kappa"), (20, "alpha beta gamma delta epsilon")]
    docs = spark.createDataFrame([(*r, "x", 1, "k") for r in data], "doc_id long, text string, item string, key int, total string")
    out = decontaminate.contaminated(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in out) == [(0, 1), (10, 1), (11, 1), (18, 1)]
    assert {r.doc_id: r.exact for r in out}[10] and not {r.doc_id: r.exact for r in out}[11]
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [12, 13, 14, 15, 16, 19, 20]


@pytest.mark.parametrize("make", [ngram_join.ngram_components, ngram_join.keep_one, substring.substring_dedup, rindex.suffix_dedup, lines.line_dedup, media.media_columns, licenses.license_scan])
def test_empty_table(spark, make):
    assert make(B.frame(spark, [])).collect() == []


def test_empty_tables_of_two(spark):
    import public_tokenizers

    none = B.frame(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.decontaminate(B.frame(spark), bench).count() == len(B.rows())
    assert packing.pack(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
