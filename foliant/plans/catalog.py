"""All registered queries of the document engine, with the SQL that must give the same rows.

Two kinds. Some pack table rows into containers with the fixture writer and decode them with the
engine, so the SQL over the source column is an independent answer. The others run the engine's
relational kernels on table columns against the same formula in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import jb2, raster
from foliant.functions.coder import compress
from foliant.operators import inventory, tables, verify
from foliant.operators import relational as R
from foliant.plans import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


def key(name: str, column: str = "path"):
    return F.col(column).cast("long").alias(name)


# --- packed and decoded -------------------------------------------------------------------------


def document_files(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    def make(doc_id, text, *rest):
        return "/".join(map(str, (*rest, doc_id))), X.single(X.info(100, 50), X.chunk("TXTa", X.text_payload(text.encode())))

    return X.pack(table(spark, sf_dir, "documents").select("doc_id", "text", *columns), make)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = document_files(spark, sf_dir)
    text = tables.page_text(files).select("path", "page_no", F.octet_length("text_bytes").alias("n"))
    return tables.pages(files).join(text, ["path", "page_no"]).groupBy("page_type").agg(F.count("*").alias("pages"), F.sum("n").alias("text_bytes"))


@query("SELECT 'unknown' AS page_type, count(*)::BIGINT AS pages, sum(octet_length(encode(text)))::BIGINT AS text_bytes FROM documents")
def text_by_page_type(spark, sf_dir):
    return flagship(spark, sf_dir)


@query("SELECT doc_id, text FROM documents")
def page_text_roundtrip(spark, sf_dir):
    return tables.page_text(document_files(spark, sf_dir)).select(key("doc_id"), "text")


@query("SELECT lang, sum(octet_length(encode(text)))::BIGINT AS bytes, count(*)::BIGINT AS n FROM documents GROUP BY lang")
def text_bytes_by_lang(spark, sf_dir):
    text = tables.page_text(document_files(spark, sf_dir, "lang"))
    return text.groupBy(F.split("path", "/")[0].alias("lang")).agg(F.sum(F.octet_length("text_bytes")).alias("bytes"), F.count("*").alias("n"))


@query("SELECT doc_id, 'INFO' AS chunk_id, 10::BIGINT AS size FROM documents UNION ALL SELECT doc_id, 'TXTa', (octet_length(encode(text)) + 4)::BIGINT FROM documents")
def chunk_inventory(spark, sf_dir):
    return tables.chunks(document_files(spark, sf_dir), payloads=False).select(key("doc_id"), "chunk_id", "size")


def part_files(spark: SparkSession, sf_dir: str, flags: str = "1", width: str = "p_size * 10 + 1", height: str = "p_partkey % 1000 + 1", bits: str = "0") -> DataFrame:
    source = table(spark, sf_dir, "part").selectExpr("p_partkey", f"cast({width} as int) as w", f"cast({height} as int) as h", "p_size + 100 as dpi", f"cast({flags} as int) as flags", f"cast({bits} as int) as bits")

    def make(p_partkey, w, h, dpi, flags, bits):
        return str(p_partkey), X.single(X.info(w, h, dpi=dpi, flags=flags), *[X.chunk(c, b"") for k, c in enumerate(("Sjbz", "BG44", "FG44", "FGbz")) if bits >> k & 1])

    return X.pack(source, make)


@query("SELECT p_partkey, (p_size * 10 + 1)::BIGINT AS width, (p_partkey % 1000 + 1)::BIGINT AS height, (p_size + 100)::BIGINT AS dpi, 26::BIGINT AS version FROM part")
def page_info_decode(spark, sf_dir):
    return tables.pages(part_files(spark, sf_dir)).select(key("p_partkey"), *long("width", "height", "dpi", "version"))


@query("SELECT p_partkey, (CASE p_partkey % 8 WHEN 6 THEN 90 WHEN 2 THEN 180 WHEN 5 THEN 270 ELSE 0 END)::BIGINT AS rotation FROM part")
def page_rotation(spark, sf_dir):
    return tables.pages(part_files(spark, sf_dir, "p_partkey % 8")).select(key("p_partkey"), *long("rotation"))


def order_files(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> DataFrame:
    def make(o_orderkey):
        return str(o_orderkey), X.single(X.info(100, 50), *[X.chunk(c, b"\x00") for k, c in enumerate(names) if o_orderkey >> k & 1])

    return X.pack(table(spark, sf_dir, "orders").select("o_orderkey"), make)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey & 1 = 1 AND o_orderkey & 14 > 0 THEN 'compound' WHEN o_orderkey & 1 = 1 THEN 'bitonal' WHEN o_orderkey & 14 > 0 THEN 'photo' ELSE 'unknown' END AS page_type FROM orders""")
def page_type_classify(spark, sf_dir):
    return tables.pages(order_files(spark, sf_dir, ("Sjbz", "BG44", "FG44", "FGbz"))).select(key("o_orderkey"), "page_type")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey & 3 > 0 AND o_orderkey & 12 > 0 THEN 'compound' WHEN o_orderkey & 3 > 0 THEN 'bitonal' WHEN o_orderkey & 4 > 0 THEN 'photo' ELSE 'blank' END AS kind FROM orders""")
def inventory_kind(spark, sf_dir):
    return inventory.page_inventory(order_files(spark, sf_dir, ("Sjbz", "Smmr", "BGjp", "FG44"))).select(key("o_orderkey"), "kind")


@query("""
WITH k AS (SELECT o_orderkey AS o, CASE WHEN o_orderkey & 3 > 0 AND o_orderkey & 12 > 0 THEN 'compound' WHEN o_orderkey & 3 > 0 THEN 'bitonal' WHEN o_orderkey & 4 > 0 THEN 'photo' ELSE 'blank' END AS kind FROM orders)
SELECT o AS o_orderkey, 'single-page' AS feature FROM k UNION ALL SELECT o, 'page-' || kind FROM k UNION ALL SELECT o, 'jb2' FROM k WHERE o & 1 > 0 UNION ALL SELECT o, 'smmr' FROM k WHERE o & 2 > 0
UNION ALL SELECT o, 'jpeg-layers' FROM k WHERE o & 4 > 0 UNION ALL SELECT o, 'fg44' FROM k WHERE o & 8 > 0""")
def features_by_doc(spark, sf_dir):
    return inventory.document_features(order_files(spark, sf_dir, ("Sjbz", "Smmr", "BGjp", "FG44"))).select(key("o_orderkey"), "feature")


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bundle per conversation, a page for each turn with its text, and an outline of the turns."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def make(conv_id, turns):
        parts = [(f"p{t['turn']}.djvu", t["role"], 1, X.form("DJVU", X.info(100, 50), X.chunk("TXTa", X.text_payload(t["text"].encode())))) for t in turns]
        nodes = [X.bookmark(t["role"], f"#{t['turn'] + 1}" if t["turn"] % 2 else f"#p{t['turn']}.djvu") for t in turns]
        return str(conv_id), X.bundle(parts, X.outline(len(nodes) + 1, X.bookmark(f"c{conv_id}", "", *nodes)))

    return X.pack(turns, make)


@query("SELECT conv_id, turn AS comp_no, 'p' || turn || '.djvu' AS comp_id, role AS title, 1::BIGINT AS type FROM conversations")
def component_directory(spark, sf_dir):
    return tables.components(conversation_files(spark, sf_dir)).select(key("conv_id"), *long("comp_no"), "comp_id", "title", *long("type"))


@query("SELECT conv_id, turn AS page_no, text FROM conversations")
def bundle_page_text(spark, sf_dir):
    return tables.page_text(conversation_files(spark, sf_dir)).select(key("conv_id"), *long("page_no"), "text")


@query("""SELECT conv_id, 0::BIGINT AS node_id, NULL::BIGINT AS parent_id, 0::BIGINT AS depth, 'c' || conv_id AS title, -1::BIGINT AS page_no FROM (SELECT DISTINCT conv_id FROM conversations)
UNION ALL SELECT conv_id, turn + 1, 0, 1, role, turn FROM conversations""")
def outline_preorder(spark, sf_dir):
    return tables.outline(conversation_files(spark, sf_dir)).select(key("conv_id"), *long("node_id", "parent_id", "depth"), "title", *long("page_no"))


@query("""SELECT page_id, url, 'c' || page_id AS comment, 'rect' AS shape, 1::BIGINT AS x, (44 - page_id % 20)::BIGINT AS y, 30::BIGINT AS w, 4::BIGINT AS h FROM pages""")
def link_extract(spark, sf_dir):
    def make(page_id, url):
        source = f"(maparea {X.quoted(url)} {X.quoted(f'c{page_id}')} (rect 1 {2 + page_id % 20} 30 4) (xor))"
        return str(page_id), X.single(X.info(100, 50), X.chunk("ANTa", source.encode()))

    return tables.links(X.pack(table(spark, sf_dir, "pages").select("page_id", "url"), make)).select(key("page_id"), "url", "comment", "shape", *long("x", "y", "w", "h"))


def benchmark_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as pages with zones: lines below each other, words beside each other, 8 wide a character and 4 apart."""

    def make(item_id, text):
        lines, at, top = [], 0, 0
        for n, line in enumerate(text.split("\n")):
            words, gap = [], 0
            for k, w in enumerate(line.split(" ")):
                # beside the elder sibling 4 apart; the first from its line's corner
                words.append(X.zone(6, 4 if k else 0, 0, 8 * len(w), 10, 1 if k else 0, len(w.encode())))
                gap += 8 * len(w) + 4
            width = gap - 4
            lines.append(X.zone(5, 0, 0 if n == 0 else 2, width, 10, 0 if n == 0 else 1, len(line.encode()), *words))
            at += len(line.encode()) + 1
            top += 12
        raw = text.encode()
        return str(item_id), X.single(X.info(4000, 1000), X.chunk("TXTz", compress(X.text_payload(raw, X.zone(1, 0, 0, 4000, 1000, 0, len(raw), *lines)))))

    return X.pack(table(spark, sf_dir, "benchmark").select("item_id", "text"), make)


@query("""
WITH l AS (SELECT item_id, line, row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS n FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM benchmark)),
w AS (SELECT item_id, n, unnest(string_split(line, ' ')) AS word, generate_subscripts(string_split(line, ' '), 1) - 1 AS k FROM l)
SELECT item_id, n AS line, k AS ordinal, word AS text, coalesce(sum(8 * length(word) + 4) OVER (PARTITION BY item_id, n ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS x, (8 * length(word))::BIGINT AS w FROM w""")
def zone_words(spark, sf_dir):
    z = tables.zones(benchmark_files(spark, sf_dir))
    lines = z.where("type = 5").select("path", F.col("zone_id").alias("parent_id"), F.col("ordinal").alias("line"))
    return z.where("type = 6").join(lines, ["path", "parent_id"]).select(key("item_id"), *long("line", "ordinal"), "text", *long("x", "w"))


@query("""
WITH l AS (SELECT item_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM benchmark)
SELECT item_id, n AS line, 0::BIGINT AS xmin, (8 * length(line) - 4 * (length(line) - length(replace(line, ' ', ''))))::BIGINT AS xmax, (12 * n)::BIGINT AS ymin, (12 * n + 10)::BIGINT AS ymax, (1 + length(line) - length(replace(line, ' ', '')))::BIGINT AS words FROM l""")
def zone_line_boxes(spark, sf_dir):
    z = tables.zones(benchmark_files(spark, sf_dir))
    words = z.where("type = 6").groupBy("path", F.col("parent_id").alias("zone_id")).agg(F.min("x").alias("xmin"), F.max(F.col("x") + F.col("w")).alias("xmax"), F.min("y").alias("ymin"), F.max(F.col("y") + F.col("h")).alias("ymax"), F.count("*").alias("words"))
    return z.where("type = 5").select("path", "zone_id", F.col("ordinal").alias("line")).join(words, ["path", "zone_id"]).select(key("item_id"), *long("line", "xmin", "xmax", "ymin", "ymax", "words"))


@query("SELECT item_id, text FROM benchmark")
def bzz_roundtrip(spark, sf_dir):
    packed = X.pack(table(spark, sf_dir, "benchmark").select("item_id", "text"), lambda item_id, text: (str(item_id), compress(text.encode())))
    return tables.unpack_stream(packed, "content").select(key("item_id"), F.decode("raw", "UTF-8").alias("text"))


def mark_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bitonal page for each part size, with a one-pixel mark for each part."""
    marks = table(spark, sf_dir, "part").groupBy("p_size").agg(F.array_sort(F.collect_list("p_partkey")).alias("parts"))

    def make(p_size, parts):
        dot = np.ones((1, 1), np.uint8)
        return str(p_size), X.single(X.info(40, 30), X.chunk("Sjbz", jb2.encode(40, 30, [(dot, p % 40, p // 40 % 30) for p in parts])))

    return X.pack(marks, make)


@query("SELECT p_size, (p_partkey % 40)::BIGINT AS x, (p_partkey // 40 % 30)::BIGINT AS y, 0::BIGINT AS shape_no FROM part")
def jb2_placements(spark, sf_dir):
    return tables.jb2_blits(tables.page_units(mark_files(spark, sf_dir))).select(F.col("path").cast("int").alias("p_size"), *[F.col(a).cast("long").alias(b) for a, b in (("left", "x"), ("bottom", "y"), ("shape_no", "shape_no"))])


@query("""
WITH c AS (SELECT p_size, (p_partkey % 40) // 4 AS cx, (p_partkey // 40 % 30) // 4 AS cy, least(count(*), 255) AS k FROM part GROUP BY ALL),
g AS (SELECT s.p_size, x.i AS cx, y.i AS cy FROM (SELECT DISTINCT p_size FROM part) s, range(0, 10) x(i), range(0, 8) y(i))
SELECT g.p_size, g.cx::BIGINT AS cx, g.cy::BIGINT AS cy, (255 - (least(coalesce(k, 0), 16) * 255) // 16)::BIGINT AS gray FROM g LEFT JOIN c ON c.p_size = g.p_size AND c.cx = g.cx AND c.cy = g.cy""")
def bitonal_subsample(spark, sf_dir):
    images = tables.renders(tables.page_units(mark_files(spark, sf_dir)), subsample=4)
    cells = images.select(F.col("path").cast("int").alias("p_size"), "width", "height", "data", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("i"))
    gray = F.conv(F.hex(F.expr("substring(data, i + 1, 1)")), 16, 10).cast("long")
    return cells.select("p_size", (F.col("i") % F.col("width")).cast("long").alias("cx"), (F.col("height") - 1 - F.floor(F.col("i") / F.col("width"))).cast("long").alias("cy"), gray.alias("gray"))


@query("""SELECT p_partkey, (CASE WHEN p_partkey % 8 IN (5, 6) THEN (p_partkey % 1000 + 3) // 3 ELSE (p_size * 10 + 3) // 3 END)::BIGINT AS width,
(CASE WHEN p_partkey % 8 IN (5, 6) THEN (p_size * 10 + 3) // 3 ELSE (p_partkey % 1000 + 3) // 3 END)::BIGINT AS height,
CASE WHEN p_partkey & 2 > 0 THEN 'RGB24' WHEN p_partkey & 1 > 0 OR p_partkey & 15 = 0 THEN 'GRAY8' END AS format
FROM part WHERE p_partkey & 2 > 0 OR p_partkey & 1 > 0 OR p_partkey & 15 = 0""")
def render_plan(spark, sf_dir):
    pages = tables.pages(part_files(spark, sf_dir, "p_partkey % 8", bits="p_partkey % 16"))
    plan = R.render_plan(pages, 3).where("plan_format is not null")
    return plan.select(key("p_partkey"), F.col("plan_width").cast("long").alias("width"), F.col("plan_height").cast("long").alias("height"), F.col("plan_format").alias("format"))


@query("SELECT p_partkey, ((p_size + 2) // 2)::BIGINT AS width, ((p_partkey % 30 + 2) // 2)::BIGINT AS height, (((p_size + 2) // 2) * ((p_partkey % 30 + 2) // 2))::BIGINT AS n, true AS white FROM part")
def blank_page_render(spark, sf_dir):
    files = part_files(spark, sf_dir, width="p_size + 1", height="p_partkey % 30 + 1")
    by_column = R.blank_pages(tables.pages(files), 2).select("path", F.col("data").alias("expected"))
    images = tables.renders(tables.page_units(files), 2).join(by_column, "path")
    return images.select(key("p_partkey"), *long("width", "height"), F.octet_length("data").cast("long").alias("n"), (F.col("data") == F.col("expected")).alias("white"))


@query("SELECT conv_id, count(*)::BIGINT AS pages, true AS planned FROM conversations GROUP BY conv_id")
def plan_matches_render(spark, sf_dir):
    files = conversation_files(spark, sf_dir)
    images = tables.renders(tables.page_units(files), 3).select("path", "page_no", "width", "height", "format")
    both = R.render_plan(tables.pages(files), 3).join(images.withColumnsRenamed({"width": "w", "height": "h", "format": "f"}), ["path", "page_no"])
    return both.groupBy(key("conv_id")).agg(F.count("*").alias("pages"), F.bool_and((F.col("w") == F.col("plan_width")) & (F.col("h") == F.col("plan_height")) & (F.col("f") == F.col("plan_format"))).alias("planned"))


@query("SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::BIGINT AS pos, (value > 20)::BIGINT AS ink FROM events")
def rle_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", (F.col("value") > 20).cast("int").alias("ink")))).alias("samples"))

    def make(user_id, samples):
        row = np.array([[s["ink"] for s in samples]], np.uint8)
        for pos, ink in enumerate(raster.unpack(raster.pack(row), row.shape[1], 1)[0].tolist()):
            yield user_id, pos, ink

    return tables.rows(rows, "user_id long, pos long, ink long", make)


@query("SELECT conv_id, count(*)::BIGINT AS pages, count(*)::BIGINT AS match, 0::BIGINT AS mismatch, 0::BIGINT AS skip, 0::BIGINT AS both_empty FROM conversations GROUP BY conv_id")
def verify_summary(spark, sf_dir):
    images = tables.renders(tables.page_units(conversation_files(spark, sf_dir)))
    again = tables.from_pnm(tables.pnm(images))
    return verify.verify_totals(verify.verify_renders(images, again)).select(key("conv_id"), "pages", "match", "mismatch", "skip", "both_empty")


@query("""SELECT CASE o_orderkey % 5 WHEN 0 THEN 'single' WHEN 1 THEN 'bundled' WHEN 2 THEN 'unknown' WHEN 3 THEN 'indirect' ELSE 'unknown' END AS kind, o_orderkey % 5 IN (2, 4) AS broken, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2""")
def container_kinds(spark, sf_dir):
    single = X.single(X.info(10, 10))
    data = (single, X.bundle([("p", None, 1, single[4:])]), b"no container at all", X.single(X.chunk("DIRM", b"\x01\0\x01" + compress(b"\0\0\0\x01a\0")), kind="DJVM"), X.single(kind="DJVM") + b"\0" * 8)

    def make(o_orderkey):
        return str(o_orderkey), data[o_orderkey % 5]

    kinds = R.container_kind(tables.documents(X.pack(table(spark, sf_dir, "orders").select("o_orderkey"), make)))
    return kinds.groupBy("kind", F.col("error").isNotNull().alias("broken")).agg(F.count("*").alias("n"))


def ground(w: int, h: int, slices: int = 0) -> bytes:
    """A background chunk of an even grey, 128 in each channel."""
    return bytes([0, slices, 1, 2, w >> 8, w & 255, h >> 8, h & 255, 0x80])


@query("""SELECT p_partkey, ((p_size + 21) // 2)::BIGINT AS width, ((p_partkey % 30 + 21) // 2)::BIGINT AS height, (((p_size + 21) // 2) * ((p_partkey % 30 + 21) // 2) * 3)::BIGINT AS n,
(CASE p_partkey % 3 WHEN 0 THEN 128 ELSE floor(255 * pow(128 / 255.0::DOUBLE, 1 / (2.2::DOUBLE / (CASE p_partkey % 3 WHEN 1 THEN 1.8::DOUBLE ELSE 1.0::DOUBLE END))) + 0.5) END)::BIGINT AS value FROM part""")
def photo_render(spark, sf_dir):
    """A background at a third of the page's size, scaled to half of it, through the gamma table."""
    source = table(spark, sf_dir, "part").selectExpr("p_partkey", "cast(p_size + 20 as int) as w", "cast(p_partkey % 30 + 20 as int) as h")

    def make(p_partkey, w, h):
        return str(p_partkey), X.single(X.info(w, h, gamma=(22, 18, 10)[p_partkey % 3]), X.chunk("BG44", ground(-(-w // 3), -(-h // 3))))

    images = tables.renders(tables.page_units(X.pack(source, make)), 2)
    even = F.hex("data") == F.repeat(F.hex(F.expr("substring(data, 1, 1)")), F.octet_length("data"))
    return images.where(even).select(key("p_partkey"), *long("width", "height"), F.octet_length("data").cast("long").alias("n"), F.conv(F.hex(F.expr("substring(data, 1, 1)")), 16, 10).cast("long").alias("value"))


def palette_chunk(colours: list[tuple[int, int, int]], indices: list[int]) -> bytes:
    body = b"\x80" + len(colours).to_bytes(2, "big") + b"".join(bytes(c[::-1]) for c in colours)
    return X.chunk("FGbz", body + X.u24(len(indices)) + compress(b"".join(i.to_bytes(2, "big") for i in indices)))


@query("""SELECT p_size, (p_partkey % 40)::BIGINT AS x, (p_partkey // 40 % 30)::BIGINT AS y, (max(p_partkey) % 5 * 50)::BIGINT AS r, (255 - max(p_partkey) % 5)::BIGINT AS g, (max(p_partkey) % 5)::BIGINT AS b FROM part GROUP BY 1, 2, 3""")
def compound_render(spark, sf_dir):
    """Coloured marks on a ground; where marks meet, the later one shows."""
    marks = table(spark, sf_dir, "part").groupBy("p_size").agg(F.array_sort(F.collect_list("p_partkey")).alias("parts"))

    def make(p_size, parts):
        dot = np.ones((1, 1), np.uint8)
        mask = jb2.encode(40, 30, [(dot, p % 40, p // 40 % 30) for p in parts])
        colours = [(50 * k, 255 - k, k) for k in range(5)]
        return str(p_size), X.single(X.info(40, 30), X.chunk("Sjbz", mask), X.chunk("BG44", ground(20, 15)), palette_chunk(colours, [p % 5 for p in parts]))

    images = tables.renders(tables.page_units(X.pack(marks, make)))
    spots = table(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("path"), (F.col("p_partkey") % 40).alias("x"), F.floor(F.col("p_partkey") / 40 % 30).alias("y")).distinct()
    at = "cast(((29 - y) * 40 + x) * 3 as int)"
    channel = lambda k: F.expr(f"cast(conv(hex(substring(data, {at} + {k + 1}, 1)), 16, 10) as long)")
    return images.select("path", "data").join(spots, "path").select(F.col("path").cast("int").alias("p_size"), *long("x", "y"), *[channel(k).alias(c) for k, c in enumerate("rgb")])


@query("SELECT DISTINCT p_size, (29 - p_partkey // 40 % 30)::BIGINT AS x, (39 - p_partkey % 40)::BIGINT AS y FROM part")
def rotated_marks(spark, sf_dir):
    """Ink of pages turned counter-clockwise, from the top left of the turned page."""
    marks = table(spark, sf_dir, "part").groupBy("p_size").agg(F.array_sort(F.collect_list("p_partkey")).alias("parts"))

    def make(p_size, parts):
        dot = np.ones((1, 1), np.uint8)
        return str(p_size), X.single(X.info(40, 30, flags=6), X.chunk("Sjbz", jb2.encode(40, 30, [(dot, p % 40, p // 40 % 30) for p in parts])))

    def ink(path, width, height, data):
        for y, x in zip(*np.nonzero(np.frombuffer(data, np.uint8).reshape(height, width) == 0), strict=True):
            yield int(path), int(x), int(y)

    return tables.rows(tables.renders(tables.page_units(X.pack(marks, make))), "p_size int, x long, y long", ink)


@query("SELECT conv_id, turn AS page_no, (turn % 90)::BIGINT AS x, true AS inherited, 'https://example.org/' || conv_id AS url FROM conversations")
def shared_components(spark, sf_dir):
    """Pages whose shapes and links come from one included component."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))

    def make(conv_id, turns):
        dot = np.ones((2, 2), np.uint8)
        base = jb2.encode(0, 0, [(dot, 0, 0)])
        note = f"(maparea {X.quoted(f'https://example.org/{conv_id}')} {X.quoted('')} (rect 0 0 9 9))"
        shared = X.form("DJVI", X.chunk("Djbz", base), X.chunk("ANTa", note.encode()))
        dictionary = jb2.decode(base, is_image=False)
        pages = [(f"p{t}", None, 1, X.form("DJVU", X.info(100, 50), X.chunk("INCL", b"shared"), X.chunk("Sjbz", jb2.encode(100, 50, [(dot, t % 90, 3)], dictionary)))) for t in turns]
        return str(conv_id), X.bundle([("shared", None, 0, shared), *pages])

    files = X.pack(turns, make)
    units = tables.page_units(files)
    placed = R.blit_shapes(tables.jb2_blits(units), tables.jb2_shapes(units))
    return placed.join(tables.links(files).select("path", "page_no", "url"), ["path", "page_no"]).select(key("conv_id"), *long("page_no"), F.col("left").cast("long").alias("x"), "inherited", "url")


@query("SELECT p_partkey, 'background' AS layer, (p_size + 1)::BIGINT AS width, (p_partkey % 40 + 1)::BIGINT AS height, (p_partkey % 3 + 1)::BIGINT AS chunks, ((p_partkey % 3 + 1) * (p_size % 3))::BIGINT AS slices FROM part")
def layer_headers(spark, sf_dir):
    source = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size")

    def make(p_partkey, p_size):
        first = ground(p_size + 1, p_partkey % 40 + 1, p_size % 3)
        return str(p_partkey), X.single(X.info(100, 100), *[X.chunk("BG44", first if n == 0 else bytes([n, p_size % 3])) for n in range(p_partkey % 3 + 1)])

    return tables.layers(tables.page_units(X.pack(source, make))).select(key("p_partkey"), "layer", *long("width", "height", "chunks", "slices"))


# --- kernels on columns ---------------------------------------------------------------------------


@query("SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS page_no FROM conversations")
def page_numbering(spark, sf_dir):
    return R.number_pages(table(spark, sf_dir, "conversations"), ["conv_id"], "turn").select("conv_id", "turn", *long("page_no"))


@query("""SELECT o_orderkey, l_partkey AS first_part FROM orders LEFT JOIN (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem) ON l_orderkey = o_orderkey AND n = 1""")
def include_resolve(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    return R.first_match(orders, lines, ["o_orderkey"], ["l_linenumber", "l_partkey"], ["l_partkey"]).select("o_orderkey", F.col("l_partkey").alias("first_part"))


@query("SELECT octet_length(encode(text))::BIGINT AS size, min(doc_id) AS first_doc, count(*)::BIGINT AS copies FROM documents GROUP BY text")
def inline_dedupe(spark, sf_dir):
    payloads = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.lit(0).alias("offset"), F.encode("text", "UTF-8").alias("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    return R.distinct_payloads(payloads).select("size", F.col("first.path").alias("first_doc"), "copies")


@query("""SELECT page_id, (CASE page_id % 3 WHEN 0 THEN (CASE WHEN page_id >= 1 AND page_id <= (SELECT count(*) FROM pages) THEN page_id - 1 ELSE -1 END) WHEN 1 THEN page_id ELSE -1 END)::BIGINT AS page_no FROM pages""")
def named_destination(spark, sf_dir):
    source = table(spark, sf_dir, "pages").withColumn("path", F.lit("book"))
    nodes = source.select("path", "page_id", F.expr("CASE page_id % 3 WHEN 0 THEN '#' || page_id WHEN 1 THEN '#p' || page_id ELSE url END").alias("url"))
    targets = source.select("path", F.col("page_id").cast("int").alias("page_no"), F.expr("'p' || page_id").alias("page_id"))
    return R.resolve_destinations(nodes, targets).select("page_id", *long("page_no"))


@query("SELECT doc_id, md5(rtrim(text, ' ' || chr(9) || chr(10))) AS digest FROM documents")
def text_normalize(spark, sf_dir):
    noisy = F.concat(F.lit("\f"), F.regexp_replace("text", "\n", "\r\n"), F.lit(" \t\r\n "))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(R.normalized_text(noisy)).alias("digest"))


@query("""SELECT CASE WHEN doc_id % 4 = 2 THEN 'both empty' WHEN doc_id % 4 = 1 THEN 'mismatch' ELSE 'match' END AS status, count(*)::BIGINT AS n FROM documents GROUP BY 1""")
def text_verify(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    left = docs.select("doc_id", F.expr("if(doc_id % 4 = 2, '', text)").alias("text"))
    right = docs.select("doc_id", F.expr("CASE doc_id % 4 WHEN 0 THEN text || ' \\n' WHEN 1 THEN text || 'x' WHEN 2 THEN '  ' ELSE text END").alias("text"))
    return R.verify_text(left, right, ["doc_id"]).groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT (l_partkey % 64 // 3)::BIGINT AS cx, (l_suppkey % 64 // 3)::BIGINT AS cy, least(count(*), 255)::BIGINT AS ink, (255 - least(least(count(*), 255), 9) * 255 // 9)::BIGINT AS gray FROM lineitem GROUP BY 1, 2""")
def ink_coverage_grid(spark, sf_dir):
    pixels = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 64).alias("x"), (F.col("l_suppkey") % 64).alias("y"))
    return R.ink_coverage(pixels, [], "x", "y", 3).select(*long("cx", "cy", "ink", "gray"))


@query("""
WITH r AS (SELECT l_partkey % 50 - 5 AS a, l_partkey % 50 - 5 + l_suppkey % 9 + 1 AS b, l_suppkey % 40 - 2 AS y FROM lineitem),
c AS (SELECT greatest(a, 0) AS a, least(b, 40) AS b, y FROM r WHERE y >= 0 AND y < 30 AND greatest(a, 0) < least(b, 40)),
p AS (SELECT unnest(range(a, b)) AS x, y FROM c),
g AS (SELECT x // 4 AS cx, y // 4 AS cy, count(*) AS ink FROM p GROUP BY 1, 2)
SELECT cx::BIGINT AS cx, cy::BIGINT AS cy, ink::BIGINT AS ink, (CASE WHEN ink >= least(4, 40 - cx * 4) * least(4, 30 - cy * 4) THEN 255 ELSE ink * 255 // (least(4, 40 - cx * 4) * least(4, 30 - cy * 4)) END)::BIGINT AS alpha FROM g""")
def run_coverage_alpha(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem").selectExpr("l_partkey % 50 - 5 as x0", "l_partkey % 50 - 5 + l_suppkey % 9 + 1 as x1", "l_suppkey % 40 - 2 as y")
    return R.run_coverage(runs, 40, 30, 4).select(*long("cx", "cy", "ink", "alpha"))


@query("""
WITH s AS (SELECT user_id, value > 20 AS ink, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events),
g AS (SELECT user_id, pos, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS grp FROM s WHERE ink)
SELECT user_id, min(pos)::BIGINT AS x0, (max(pos) + 1)::BIGINT AS x1 FROM g GROUP BY user_id, grp""")
def ink_runs(spark, sf_dir):
    return R.runs_of_flags(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", F.col("value") > 20).select("user_id", "x0", "x1")


@query("SELECT l_returnflag, min(l_partkey) AS xmin, min(l_suppkey) AS ymin, max(l_partkey) AS xmax, max(l_suppkey) AS ymax FROM lineitem GROUP BY l_returnflag")
def ink_bbox(spark, sf_dir):
    return R.ink_box(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_partkey", "l_suppkey")


@query("SELECT l_partkey, count(*)::BIGINT AS uses FROM lineitem GROUP BY l_partkey HAVING count(*) > 1")
def shape_use_counts(spark, sf_dir):
    return R.shape_uses(table(spark, sf_dir, "lineitem"), [], "l_partkey").where("uses > 1")


@query("""
WITH e AS (SELECT user_id, event_id, floor(value * 100)::BIGINT AS v FROM events),
l AS (SELECT user_id, event_id, v AS a, coalesce(lag(v, 1) OVER w, first(v) OVER w) AS b, coalesce(lag(v, 2) OVER w, first(v) OVER w) AS c FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, (a + b + c - least(a, b, c) - greatest(a, b, c))::BIGINT AS baseline FROM l""")
def median3_baseline(spark, sf_dir):
    marks = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.col("value") * 100).alias("v"))
    return R.median_baseline(marks, ["user_id"], "event_id", "v").select("event_id", *long("baseline"))


@query("""
SELECT o_orderkey, coalesce(p_size, 0)::BIGINT AS r, coalesce(p_partkey % 256, 0)::BIGINT AS g, coalesce(p_partkey * 7 % 256, 0)::BIGINT AS b
FROM orders LEFT JOIN part ON o_orderkey % 5 <> 0 AND p_partkey = o_custkey % 250 AND p_partkey < 200""")
def palette_lookup(spark, sf_dir):
    page = F.lit("page").alias("path")
    orders = table(spark, sf_dir, "orders")
    blits = orders.select(page, F.col("o_orderkey").alias("blit_no"))
    indices = orders.where("o_orderkey % 5 <> 0").select(page, F.col("o_orderkey").alias("blit_no"), (F.col("o_custkey") % 250).alias("color_no"))
    colours = table(spark, sf_dir, "part").where("p_partkey < 200").select(page, F.col("p_partkey").alias("color_no"), F.col("p_size").cast("long").alias("r"), (F.col("p_partkey") % 256).alias("g"), (F.col("p_partkey") * 7 % 256).alias("b"))
    return R.palette_lookup(blits, indices, colours, ["path"]).select(F.col("blit_no").alias("o_orderkey"), *long("r", "g", "b"))


@query("""
WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, floor(value)::BIGINT % 256 AS c, event_id % 256 AS a FROM events),
p AS (SELECT user_id, max(c) FILTER (n = 1) AS c1, max(a) FILTER (n = 1) AS a1, coalesce(max(c) FILTER (n = 2), 0) AS c2, coalesce(max(a) FILTER (n = 2), 0) AS a2, coalesce(max(c) FILTER (n = 3), 0) AS c3, coalesce(max(a) FILTER (n = 3), 0) AS a3, coalesce(max(c) FILTER (n = 4), 0) AS c4, coalesce(max(a) FILTER (n = 4), 0) AS a4 FROM e WHERE n <= 4 GROUP BY user_id),
q AS (SELECT *, (255 * (255 - a1) + c1 * a1 + 127) // 255 AS d1 FROM p), r AS (SELECT *, (d1 * (255 - a2) + c2 * a2 + 127) // 255 AS d2 FROM q), s AS (SELECT *, (d2 * (255 - a3) + c3 * a3 + 127) // 255 AS d3 FROM r)
SELECT user_id, ((d3 * (255 - a4) + c4 * a4 + 127) // 255)::BIGINT AS painted FROM s""")
def alpha_blend_fold(spark, sf_dir):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    paints = table(spark, sf_dir, "events").withColumn("n", n).where("n <= 4").select("user_id", "event_id", (F.floor("value") % 256).alias("c"), (F.col("event_id") % 256).alias("a"))
    return R.blend_fold(paints, ["user_id"], "event_id", "c", "a")


@query("""
WITH p AS (SELECT user_id, list({'c': floor(value)::BIGINT % 256, 'a': event_id % 256} ORDER BY event_id) AS paints FROM events GROUP BY user_id)
SELECT user_id, (list_reduce(list_prepend({'c': 255::BIGINT, 'a': 0::BIGINT}, paints), lambda d, x: {'c': (d.c * (255 - x.a) + x.c * x.a + 127) // 255, 'a': 0::BIGINT})).c::BIGINT AS painted FROM p""")
def alpha_blend_fold_all(spark, sf_dir):
    paints = table(spark, sf_dir, "events").select("user_id", "event_id", (F.floor("value") % 256).alias("c"), (F.col("event_id") % 256).alias("a"))
    return R.blend_fold(paints, ["user_id"], "event_id", "c", "a")


@query("""
SELECT g::BIGINT AS gamma10, i::BIGINT AS i, (CASE WHEN i IN (0, 255) OR abs(22.0 / g - 1) < 0.001 THEN i ELSE least(255, greatest(0, floor(255 * pow(i / 255.0::DOUBLE, 1 / greatest(0.1, least(10.0, 2.2::DOUBLE / (g / 10.0::DOUBLE)))) + 0.5))) END)::BIGINT AS value
FROM (VALUES (10), (18), (22), (25), (40)) t(g), range(0, 256) r(i)""")
def gamma_lut(spark, sf_dir):
    grid = spark.range(256).select(F.col("id").alias("i"), F.explode(F.array(*map(F.lit, (10, 18, 22, 25, 40)))).alias("gamma10"))
    return grid.select(*long("gamma10"), "i", R.gamma_column(F.col("i"), F.col("gamma10") / 10).alias("value"))


@query("""
WITH s AS (SELECT l_partkey % 256 - 128 AS y, l_suppkey % 256 - 128 AS cb, l_orderkey % 256 - 128 AS cr FROM lineitem),
t AS (SELECT *, y + 128 - (cb >> 2) AS light, cr + (cr >> 1) AS red FROM s)
SELECT y, cb, cr, greatest(0, least(255, y + 128 + red))::BIGINT AS r, greatest(0, least(255, light - (red >> 1)))::BIGINT AS g, greatest(0, least(255, light + cb * 2))::BIGINT AS b FROM t""")
def ycbcr_to_rgb(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 256 - 128).alias("y"), (F.col("l_suppkey") % 256 - 128).alias("cb"), (F.col("l_orderkey") % 256 - 128).alias("cr"))
    return s.withColumns(R.rgb_columns(F.col("y"), F.col("cb"), F.col("cr")))


@query("""
WITH s AS (SELECT user_id, event_id, floor(value * 10)::BIGINT AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events),
n AS (SELECT *, coalesce(lag(v, 1) OVER w, 0) + coalesce(lead(v, 1) OVER w, 0) AS near, coalesce(lag(v, 3) OVER w, 0) + coalesce(lead(v, 3) OVER w, 0) AS far FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, (CASE WHEN pos % 2 = 0 THEN v - ((9 * near - far + 16) >> 5) ELSE v END)::BIGINT AS lifted FROM n""")
def iw44_lift_step(spark, sf_dir):
    s = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.col("value") * 10).alias("v"))
    return R.lift_step(s, ["user_id"], "event_id", "v").select("event_id", *long("lifted"))


@query("""
SELECT n::BIGINT AS n, t::BIGINT AS t, x::BIGINT AS x, least((16 * 1 + t) // (2 * t) - 8 + (t // 2 + 16 * x) // t, (n - 1) * 16)::BIGINT AS place
FROM (VALUES (3), (4), (25)) a(n), (VALUES (2), (3), (4), (12)) b(t), range(0, 300) r(x) WHERE x < n * t""")
def scale_coords(spark, sf_dir):
    each = lambda *v: F.explode(F.array(*map(F.lit, v)))
    grid = spark.range(300).select(F.col("id").alias("x"), each(3, 4, 25).alias("n")).select("*", each(2, 3, 4, 12).alias("t")).where("x < n * t")
    return grid.select(*long("n", "t"), "x", R.scale_coordinate(F.col("x"), F.col("n"), F.lit(1), F.col("t")).alias("place"))


@query("""
WITH p AS (SELECT p_partkey, p_partkey % 500 + 1 AS w, p_size * 7 AS h, p_size % 17 + 1 AS r FROM part), q AS (SELECT *, (w + r - 1) // r AS lw, (h + r - 1) // r AS lh FROM p)
SELECT p_partkey, coalesce(min(i), 0)::BIGINT AS factor FROM q LEFT JOIN range(1, 16) t(i) ON (w + i - 1) // i = lw AND (h + i - 1) // i = lh GROUP BY p_partkey""")
def compute_reduction(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_partkey % 500 + 1 as w", "p_size * 7 as h", "p_size % 17 + 1 as r")
    q = p.withColumns({"lw": R.ceil_div(F.col("w"), F.col("r")), "lh": R.ceil_div(F.col("h"), F.col("r"))})
    return q.select("p_partkey", R.reduction_column(F.col("w"), F.col("h"), F.col("lw"), F.col("lh")).cast("long").alias("factor"))


@query("""
WITH p AS (SELECT p_partkey, p_size * 100 AS w, p_partkey % 3000 + 200 AS h, CASE WHEN p_size % 10 = 0 THEN 9000 ELSE p_size * 20 END AS dpi FROM part),
q AS (SELECT *, CASE WHEN dpi BETWEEN 25 AND 6000 THEN dpi ELSE 300 END AS d FROM p), t AS (SELECT *, floor(w * 300 / d + 0.5)::BIGINT AS a, floor(h * 300 / d + 0.5)::BIGINT AS b FROM q)
SELECT p_partkey, greatest(1, least(coalesce(CASE WHEN a >= 2 THEN (w - 1) // (a - 1) END, w), coalesce(CASE WHEN b >= 2 THEN (h - 1) // (b - 1) END, h), w, h))::BIGINT AS subsample FROM t""")
def pick_subsample(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size * 100 as w", "p_partkey % 3000 + 200 as h", "CASE WHEN p_size % 10 = 0 THEN 9000 ELSE p_size * 20 END as dpi")
    return p.select("p_partkey", R.pick_subsample(F.col("w"), F.col("h"), F.col("dpi")).cast("long").alias("subsample"))


@query("""
WITH b AS (SELECT user_id, event_type, min(floor(value * 1000))::BIGINT AS best FROM events GROUP BY ALL)
SELECT user_id, sum(best)::BIGINT AS total_ms, count(*)::BIGINT AS ops FROM b GROUP BY user_id ORDER BY total_ms DESC, user_id LIMIT 10""")
def bench_totals_topn(spark, sf_dir):
    timings = table(spark, sf_dir, "events").select("user_id", "event_type", F.floor(F.col("value") * 1000).alias("ms"))
    return R.bench_totals(timings, "user_id", "event_type", "ms").orderBy(F.desc("total_ms"), "user_id").limit(10)


@query("""
WITH a AS (SELECT user_id, sum(floor(value * 1000))::BIGINT AS before_ms FROM events WHERE event_type IN ('click', 'view') GROUP BY 1), b AS (SELECT user_id, sum(floor(value * 1000))::BIGINT AS after_ms FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, before_ms, after_ms, after_ms - before_ms AS diff_ms, CASE WHEN before_ms IS NULL THEN 'missing in before' WHEN after_ms IS NULL THEN 'missing in after' ELSE 'both' END AS status FROM a FULL JOIN b ON a.user_id = b.user_id""")
def timing_compare(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", F.floor(F.col("value") * 1000).alias("ms"))
    side = lambda *kinds: events.where(F.col("event_type").isin(*kinds)).groupBy("user_id").agg(F.sum("ms").alias("ms"))
    return R.timing_compare(side("click", "view"), side("purchase"), "user_id", "ms")


@query("""SELECT name, url FROM (SELECT lower(regexp_extract(url, '([^/]*)$', 1)) AS name, url, row_number() OVER (PARTITION BY lower(regexp_extract(url, '([^/]*)$', 1)) ORDER BY url) AS n FROM pages) WHERE n = 1""")
def corpus_dedupe(spark, sf_dir):
    return R.corpus_dedupe(table(spark, sf_dir, "pages").select(F.col("url").alias("path"))).select("name", F.col("path").alias("url"))


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x * 127)::BIGINT) AS v FROM embeddings),
d AS (SELECT a.vec_id, unnest(a.v) AS x, unnest(b.v) AS y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, avg(abs(x - y)) AS mean_diff, max(abs(x - y))::BIGINT AS max_diff, count(*) FILTER (x <> y)::BIGINT AS n_diff, count(*)::BIGINT AS n, (count(*) FILTER (x <> y) <= 2000 AND count(*) FILTER (x <> y) * 1000000 <= count(*) * 100) AS tolerated FROM d GROUP BY vec_id""")
def image_diff_stats(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x * 127)).alias("a"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return R.image_difference(pairs, "a", "b", ["vec_id"])


@query("""SELECT doc_id, CASE WHEN n >= 1024 THEN printf('%.1f KB', floor(n * 10 / 1024 + 0.5) / 10) ELSE n || ' B' END AS size FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents)""")
def readable_sizes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", R.readable_bytes(F.octet_length("text")).alias("size"))


# further queries register themselves in the same tables
from foliant.plans import images, structure  # noqa: E402, F401
