"""Table functions end to end: pages that render, files that are broken, repartitioning, sources and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import iw44, jb2, raster
from foliant.operators import inventory, tables, verify
from foliant.operators import relational as R
from foliant.plans import fixtures as X

DOT = np.ones((2, 3), np.uint8)
BACK = bytes([0, 0, 1, 2, 0, 20, 0, 15, 0x80])  # a grey ground of 20 x 15, no slices


def page(*chunks, flags=1, w=40, h=30):
    return X.form("DJVU", X.info(w, h, flags=flags), *chunks)


def files(spark, *named):
    return spark.createDataFrame([(n, len(d), bytearray(d)) for n, d in named], "path string, length long, content binary")


def image(row):
    shape = (row.height, row.width) if row.format == "GRAY8" else (row.height, row.width, 3)
    return np.frombuffer(row.data, np.uint8).reshape(shape)


@pytest.fixture(scope="module")
def book(spark):
    marks = [(DOT, 5, 6), (DOT, 10, 6), (DOT, 38, 29)]
    mask = X.chunk("Sjbz", jb2.encode(40, 30, marks))
    base = jb2.encode(0, 0, [(DOT, 0, 0)])
    inherited = jb2.encode(40, 30, marks, jb2.decode(base, is_image=False))
    palette = X.chunk("FGbz", b"\x80\0\x02\xff\0\0\0\xff\0\0\0\x03" + X.compress(b"\0\0\0\x01\0\x07"))
    parts = [
        ("dict", None, 0, X.form("DJVI", X.chunk("Djbz", base))),
        ("bitonal", "Bitonal", 1, page(mask)),
        ("shared", None, 1, page(X.chunk("INCL", b"dict"), X.chunk("Sjbz", inherited))),
        ("photo", None, 1, page(X.chunk("BG44", BACK))),
        ("compound", None, 1, page(mask, X.chunk("BG44", BACK), palette)),
        ("blank", None, 1, page(flags=6)),
        ("front only", None, 1, page(X.chunk("FG44", BACK))),
        ("odd ground", None, 1, page(mask, X.chunk("BG44", bytes([0, 0, 1, 2, 0, 33, 0, 15, 0x80])))),
        ("broken mask", None, 1, page(X.chunk("Sjbz", b"\x99" * 30))),
    ]
    return files(spark, ("book", X.bundle(parts, X.outline(2, X.bookmark("top", "#photo", X.bookmark("two", "#2"))))), ("bad", b"x" * 50), ("none", b""))


def test_documents(book):
    d = {r.path: r for r in tables.documents(book).collect()}
    assert d["book"].n_pages == 8 and d["book"].n_components == 9 and d["bad"].error and d["none"].error
    kinds = {r.path: r.kind for r in R.container_kind(tables.documents(book)).collect()}
    assert kinds == {"book": "bundled", "bad": "unknown", "none": "unknown"}


def test_pages(book):
    p = tables.pages(book).orderBy("page_no").collect()
    assert [r.page_type for r in p] == ["bitonal", "bitonal", "photo", "compound", "unknown", "photo", "compound", "bitonal"]
    assert p[0].title == "Bitonal" and p[4].rotation == 90
    assert [(r.title, r.page_no) for r in tables.outline(book).orderBy("node_id").collect()] == [("top", 2), ("two", 1)]


def test_renders(book):
    by = {r.page_no: r for r in tables.renders(tables.page_units(book)).collect()}
    expected = np.full((30, 40), 255, np.uint8)
    for x, y in ((5, 6), (10, 6), (38, 29)):
        expected[::-1][y : y + 2, x : x + 3] = 0
    assert (image(by[0]) == expected).all() and (image(by[1]) == expected).all()
    assert by[2].format == "RGB24" and set(image(by[2]).ravel()) == {128}
    compound = image(by[3])[::-1]
    assert compound[6, 5].tolist() == [0, 0, 255] and compound[6, 10].tolist() == [0, 255, 0] and compound[29, 39].tolist() == [0, 0, 0] and compound[0, 0].tolist() == [128] * 3
    assert (by[4].width, by[4].height) == (30, 40) and set(image(by[4]).ravel()) == {255}
    assert by[5].error == "nothing to render"
    assert by[6].format == "GRAY8"  # the ground has no usable ratio, so the mask stands alone
    assert by[7].error


@pytest.mark.parametrize("sub", [1, 2, 3, 4])
def test_plans(book, sub):
    images = tables.renders(tables.page_units(book), sub).select("page_no", "width", "height", "format")
    both = R.render_plan(tables.pages(book), sub).drop("width", "height").join(images, "page_no").where("page_no not in (5, 6, 7)").collect()
    assert len(both) == 5 and all((r.width, r.height, r.format) == (r.plan_width, r.plan_height, r.plan_format) for r in both)


def test_subsampled_blend(book):
    p = image(next(r for r in tables.renders(tables.page_units(book), 4).collect() if r.page_no == 3))[::-1]
    # cell (1, 1) holds 2 x 2 ink pixels at x 5..7, y 6..7: three columns, two rows of 16
    alpha = 6 * 255 // 16
    assert p[1, 1].tolist() == [(128 * (255 - alpha) + c * alpha + 127) // 255 for c in (0, 0, 255)]


def test_front_layer(spark):
    """Marks without a palette take the nearest sample of the front layer, at any reduction."""
    front = bytes([0, 0, 1, 2, 0, 10, 0, 8, 0x80])
    data = X.single(X.info(40, 30), X.chunk("Sjbz", jb2.encode(40, 30, [(DOT, 5, 6)])), X.chunk("BG44", bytes([0, 0, 0x81, 2, 0, 20, 0, 15, 0])), X.chunk("FG44", front))
    units = tables.page_units(files(spark, ("f", data)))
    full = image(tables.renders(units).first())[::-1]
    assert full[6, 5].tolist() == [128] * 3 and full[0, 0].tolist() == [127] * 3
    half = image(tables.renders(units, 2).first())[::-1]
    assert half[3, 3].tolist() == [128] * 3 and half[0, 0].tolist() == [127] * 3


def test_options(book):
    units = tables.page_units(book)
    plain = {r.page_no: r for r in tables.renders(units, compose=False).collect()}
    assert plain[3].format == "GRAY8" and plain[2].error
    swapped = next(r for r in tables.renders(units, bgr=True).collect() if r.page_no == 3)
    assert image(swapped)[::-1][6, 5].tolist() == [255, 0, 0]


def test_parts(book):
    units = tables.page_units(book)
    assert tables.jb2_blits(units).where("page_no = 0").count() == 3
    shapes = tables.jb2_shapes(units).where("page_no = 1").collect()
    assert [(s.w, s.h, s.inherited) for s in shapes] == [(3, 2, True)] and (raster.unpack(bytes(shapes[0].rle), 3, 2) == DOT).all()
    assert tables.ink_runs(units).where("page_no = 0").select("y", "x0", "x1").orderBy("blit_no", "y").first() == (6, 5, 8)
    assert {(r.color_no, r.r, r.g, r.b) for r in tables.palettes(units).collect()} == {(0, 0, 0, 255), (1, 0, 255, 0)}
    painted = R.palette_lookup(tables.jb2_blits(units).where("page_no = 3"), tables.blit_colors(units), tables.palettes(units), ["path", "page_no"])
    assert [(r.r, r.g, r.b) for r in painted.orderBy("blit_no").collect()] == [(0, 0, 255), (0, 255, 0), (0, 0, 0)]
    assert {(r.page_no, r.layer, r.width, r.slices) for r in tables.layers(units).where("error is null").collect()} >= {(2, "background", 20, 0), (5, "foreground", 20, 0)}
    assert {r.record_type: r.n for r in tables.jb2_records(units).where("page_no = 0").collect()} == {"start": 1, "new mark": 1, "copy": 2, "end": 1}
    assert R.blit_shapes(tables.jb2_blits(units), tables.jb2_shapes(units)).count() == tables.jb2_blits(units).count()


def test_layer_planes_and_files(book):
    units = tables.page_units(book)
    for plane, value in (("rgb", 128), ("y", 128), ("cb", 128), ("gray", 128)):
        assert set(image(tables.layer_images(units, plane=plane).where("page_no = 2").first()).ravel()) == {value}
    raw = tables.layer_file(tables.chunks(book, ["BG44"])).where("page_no = 2").first().file
    doc = tables.pages(book.sparkSession.createDataFrame([("x", len(raw), raw)], "path string, length long, content binary")).first()
    assert (doc.width, doc.height, doc.page_type, doc.dpi) == (20, 15, "photo", 100)


def test_same_with_more_partitions(book):
    def digest(df):
        return {(r.page_no, r.width, bytes(r.data or b"")) for r in tables.renders(tables.page_units(df)).collect()}

    assert digest(book.coalesce(1)) == digest(book.repartition(8))


def test_pnm_and_verify(book):
    images = tables.renders(tables.page_units(book)).where("error is null")
    again = tables.from_pnm(tables.pnm(images))
    verified = verify.verify_renders(images, again.where("page_no <> 1"))
    status = {r.page_no: r.status for r in verified.collect()}
    assert status[1] == "missing in oracle" and {v for k, v in status.items() if k != 1} == {"match"}
    t = verify.verify_totals(verified).first()
    assert (t.pages, t.match, t.skip, t.mismatch) == (6, 5, 1, 0) and verify.failures(verified).count() == 0
    assert raster.read_pnm(b"P5\n# note\n2 1\n255\nab").tolist() == [[97, 98]]
    with pytest.raises(ValueError):
        raster.read_pnm(b"P4\n1 1\n")


def test_inventory(book):
    row = next(r for r in inventory.document_inventory(book).collect() if r.path == "book")
    assert {"djvm-bundled", "multi-page", "shared-dict", "outline", "jb2", "incl", "bg44-color", "fgbz-palette", "fgbz-shapetable", "fg44", "rotated", "page-compound", "page-blank"} <= set(row.features)
    assert row.features == sorted(row.features) and row.shared_dicts == 1 and row.pages == 8
    assert inventory.any_page(tables.pages(book)).first().any_palette


def test_includes(book):
    incl = tables.chunks(book, ["INCL"]).withColumn("incl_id", F.decode("payload", "UTF-8"))
    comps = tables.components(book)
    found = R.resolve_includes(incl.select("path", "page_no", "chunk_no", "incl_id"), comps).first()
    assert found.offset == comps.where("comp_id = 'dict'").first().offset
    assert [(r.id, r.ordinal) for r in R.shared_ids(incl, comps).collect()] == [("dict", 0)]


def test_data_source_and_stream(spark, tmp_path):
    from foliant.sources.datasource import register
    from foliant.streaming.landing import ingest

    register(spark)
    (tmp_path / "in").mkdir()
    for n in range(3):
        (tmp_path / "in" / f"{n}.djvu").write_bytes(X.single(X.info(10 + n, 5), X.chunk("TXTa", X.text_payload(b"hi"))))
    (tmp_path / "in" / "note.txt").write_text("no")
    source = spark.read.format("layereddoc").option("table", "pages").load(str(tmp_path / "in"))
    assert {r.width for r in source.collect()} == {10, 11, 12}
    assert spark.read.format("layereddoc").option("table", "chunks").option("chunkIds", "TXTa").load(str(tmp_path / "in")).count() == 3
    assert tables.read_files(spark, str(tmp_path / "in")).count() == 3
    q = ingest(spark, str(tmp_path / "in"), tables.page_text, str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_helpers(spark):
    one = spark.createDataFrame([("p3 10 ERROR",), ("layer p4 1.5 2",), ("noise",)], "line string")
    assert [(r.page, r.before_ms, r.after_ms, r.is_layer) for r in R.parse_timings(one).orderBy("page").collect()] == [(3, 10.0, None, False), (4, 1.5, 2.0, True)]
    sizes = spark.createDataFrame([(5,), (2048,), (5 << 20,), (3 << 30,)], "n long").select(R.readable_bytes(F.col("n")).alias("s")).collect()
    assert [r.s for r in sizes] == ["5 B", "2.0 KB", "5.0 MB", "3.00 GB"]
    names = spark.createDataFrame([("/a/é.djvu",), ("/b/ü.djvu",), ("/b/x.djvu",)], "path string")
    assert [r.ascii_name for r in R.ascii_names(names).orderBy("path").collect()] == ["_.djvu", "x.djvu", "_-2.djvu"]
    assert R.sample_files(names, 2).count() == 2
    ids = spark.createDataFrame([("d", "#99999999999"), ("d", "#"), ("d", "#1"), ("d", None)], "path string, url string")
    pages = spark.createDataFrame([("d", 0, "one")], "path string, page_no int, page_id string")
    assert sorted(r.page_no for r in R.resolve_destinations(ids, pages).collect()) == [-1, -1, -1, 0]


def test_size_limits(spark):
    huge = X.single(X.info(65000, 65000))
    (row,) = tables.renders(tables.page_units(files(spark, ("h", huge)))).collect()
    assert row.error == "page size" and row.data is None
    with pytest.raises(iw44.Broken):
        tables.render_unit(huge[4:], None)


def test_tsv_and_sql_functions(spark, tmp_path):
    table = spark.createDataFrame([("a", 1, None), ("b\tc", 2, "x y")], "path string, n int, note string")
    inventory.write_tsv(table, str(tmp_path / "dump"))
    back = spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "dump"))
    assert back.columns == ["path", "n", "note"] and sorted((r.path, r.n, r.note) for r in back.collect()) == [("a", "1", None), ("b\tc", "2", "x y")]
    tables.register_functions(spark)
    some = files(spark, ("x", X.single(X.info(10, 5))), ("broken", b"no container"))
    for name in tables.SQL_FUNCTIONS:
        assert spark.sql(f"SELECT path FROM {{f}}, LATERAL {name}(content)", f=some).count() == 0
        assert spark.sql(f"SELECT * FROM {name}(CAST(NULL AS binary))").count() == 0


def test_blobs_that_end_early(spark):
    blobs = spark.createDataFrame([("a", b"\0\0\0\2hi\0\0\0\0\0\0\0\x09cut", 4), ("b", b"", 1), ("c", b"\0\0", 2)], "path string, blob binary, n_pages int")
    got = {(r.path, r.page_no): r.text for r in tables.blob_texts(blobs).collect()}
    assert got == {("a", 0): "hi", ("a", 1): "", ("a", 2): "", ("a", 3): "", ("b", 0): "", ("c", 0): "", ("c", 1): ""}
