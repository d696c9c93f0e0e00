"""Queries on container structure, look-ups, inventory, reports and formats, each against plain SQL."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import functions as F

from foliant.functions import jb2
from foliant.functions.coder import compress
from foliant.operators import inventory, tables, verify
from foliant.operators import relational as R
from foliant.plans import fixtures as X
from foliant.plans.catalog import benchmark_files, conversation_files, document_files, ground, key, long, part_files, query, table

# --- includes and parts ---------------------------------------------------------------------------


def included_files(spark, sf_dir):
    """A bundle for each conversation: pages that include a component, one that is missing, or none of them; and components that no page includes."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))

    def make(conv_id, turns):
        names = (b"shared", b"shared \r\n", b"missing\x1a", b"other")
        pages = [(f"p{t}", None, 1, X.form("DJVU", X.info(100, 50), X.chunk("INCL", names[(t + conv_id) % 4]))) for t in turns]
        extra = [(f"spare{k}", None, 0, X.form("DJVI", X.chunk("Djbz", b"x" * (5 + k)))) for k in range(conv_id % 3)]
        shared = [("shared", None, 0, X.form("DJVI", X.chunk("ANTa", b"(a)" * 5))), ("other", "t", 3, X.form("DJVI", X.chunk("ANTa", b"(b)"), X.chunk("Djbz", b"yy")))]
        thumbs = [(f"t{k}", None, 2, X.form("THUM", X.chunk("TH44", b"z"))) for k in range(conv_id % 2)]
        return str(conv_id), X.bundle([*pages[:1], *extra, *shared, *thumbs, *pages[1:]], *([X.outline(1, X.bookmark("x", ""))] if conv_id % 5 == 0 else []))

    return X.pack(turns, make)


def includes(files):
    own = tables.chunks(files, ["INCL"])
    return own.select("path", "page_no", "chunk_no", F.decode("payload", "ISO-8859-1").alias("incl_id"))


#: The include of each turn, as the fixture has it.
INCLUDED = "CASE (turn + conv_id) % 4 WHEN 2 THEN 'missing' WHEN 3 THEN 'other' ELSE 'shared' END"


@query(f"SELECT conv_id, turn AS page_no, {INCLUDED} AS incl_id, CASE WHEN (turn + conv_id) % 4 <> 2 THEN {INCLUDED} END AS comp_id FROM conversations")
def include_offsets(spark, sf_dir):
    """Where each page's include points: blanks and ends behind an id don't count, a missing one gives 0."""
    files = included_files(spark, sf_dir)
    components = tables.components(files)
    found = R.resolve_includes(includes(files), components)
    at = components.select("path", "offset", "comp_id")
    return found.join(at, ["path", "offset"], "left").select(key("conv_id"), *long("page_no"), "incl_id", "comp_id")


@query(f"""
WITH seen AS (SELECT conv_id, {INCLUDED} AS id, 0 AS rank, min(turn) AS a FROM conversations GROUP BY 1, 2),
listed AS (SELECT conv_id, 'shared' AS id, 1 AS rank, 99 AS a FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT conv_id, 'spare' || k, 1, k FROM (SELECT DISTINCT conv_id FROM conversations), range(0, 3) t(k) WHERE k < conv_id % 3),
f AS (SELECT conv_id, id, min((rank, a)) AS seen_at FROM (SELECT * FROM seen UNION ALL SELECT * FROM listed) GROUP BY 1, 2)
SELECT conv_id, id, (row_number() OVER (PARTITION BY conv_id ORDER BY seen_at) - 1)::BIGINT AS ordinal FROM f""")
def include_ids(spark, sf_dir):
    """Each document's include ids, in order of first sight, then those that only its directory lists."""
    files = included_files(spark, sf_dir)
    own = includes(files).withColumn("incl_id", R.trimmed_id(F.col("incl_id")))
    return R.shared_ids(own, tables.components(files)).select(key("conv_id"), "id", *long("ordinal"))


@query("""SELECT conv_id, (conv_id % 3 + 1)::BIGINT AS shared_dicts, (2 + CASE conv_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 5 ELSE 11 END)::BIGINT AS shared_dict_bytes, 18::BIGINT AS shared_annot_bytes, (conv_id % 2)::BIGINT AS thumbnails, conv_id % 5 = 0 AS outline FROM (SELECT DISTINCT conv_id FROM conversations)""")
def shared_totals(spark, sf_dir):
    """Shared dictionaries and annotations, thumbnails and outlines of each document."""
    parts = inventory.shared_parts(included_files(spark, sf_dir))
    return parts.select(key("conv_id"), *long("shared_dicts", "shared_dict_bytes", "shared_annot_bytes", "thumbnails"), (F.col("navm_bytes") > 0).alias("outline"))


# --- old directories, geometry, headers -----------------------------------------------------------


@query("""SELECT p_size, (row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1)::BIGINT AS comp_no, (p_partkey % 2)::BIGINT AS type, CASE WHEN p_partkey % 8 >= 4 THEN 'T' || p_partkey END AS title, 'c' || p_partkey AS comp_id FROM part""")
def old_directory(spark, sf_dir):
    """Directories of version 0: other bits for types, names and titles."""
    parts = table(spark, sf_dir, "part").groupBy("p_size").agg(F.array_sort(F.collect_list("p_partkey")).alias("parts"))

    def make(p_size, parts):
        form = X.form("DJVU", X.info(10, 10))
        flags = bytes((p % 2) | (2 if p % 4 >= 2 else 0) | (4 if p % 8 >= 4 else 0) for p in parts)
        names = b"".join(f"c{p}".encode() + b"\0" + (b"file\0" if p % 4 >= 2 else b"") + (f"T{p}".encode() + b"\0" if p % 8 >= 4 else b"") for p in parts)
        packed = compress(b"".join(X.u24(len(form)) for _ in parts) + flags + names)
        size = 3 + 4 * len(parts) + len(packed)
        first = 16 + 8 + size + (size & 1)
        step = len(form) + (len(form) & 1)
        head = X.chunk("DIRM", struct.pack(">BH", 0x80, len(parts)) + b"".join(struct.pack(">I", first + step * k) for k in range(len(parts))) + packed)
        return str(p_size), X.single(head, *[form + b"\0" * (len(form) & 1) for _ in parts], kind="DJVM")

    return tables.components(X.pack(parts, make)).select(F.col("path").cast("int").alias("p_size"), *long("comp_no", "type"), "title", "comp_id")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE p_size + 1 END::BIGINT AS width, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE p_partkey % 40 + 1 END::BIGINT AS height, CASE p_partkey % 4 WHEN 3 THEN NULL WHEN 2 THEN 400 ELSE 100 END::BIGINT AS dpi, CASE p_partkey % 4 WHEN 3 THEN NULL WHEN 2 THEN 26 ELSE 258 END::BIGINT AS version,
CASE p_partkey % 4 WHEN 0 THEN 'BG44' WHEN 1 THEN CASE WHEN p_partkey % 8 = 1 THEN 'PM44' ELSE 'BM44' END ELSE 'BG44' END AS bg_chunk FROM part""")
def page_geometry(spark, sf_dir):
    """Geometry from a layer's header where there is no INFO; the first INFO decides, even a bad one; and which of several backgrounds counts."""
    source = table(spark, sf_dir, "part").select("p_partkey", "p_size")

    def make(p_partkey, p_size):
        w, h, kind = p_size + 1, p_partkey % 40 + 1, p_partkey % 4
        own = ground(w, h)
        if kind == 0:
            chunks = [X.chunk("BM44", ground(9, 9)), X.chunk("PM44", ground(8, 8)), X.chunk("BG44", own)]
        elif kind == 1:
            chunks = [X.chunk("BM44", own if p_partkey % 8 != 1 else ground(7, 7)), *([X.chunk("PM44", own)] if p_partkey % 8 == 1 else [])]
        elif kind == 2:
            chunks = [X.info(w, h, dpi=400), X.info(5, 5), X.chunk("BG44", ground(3, 3))]
        else:
            chunks = [X.chunk("INFO", b"\0\1"), X.info(w, h), X.chunk("BG44", own)]
        return str(p_partkey), X.single(*chunks, kind="PM44" if kind == 1 else "DJVU")

    return tables.pages(X.pack(source, make)).select(key("p_partkey"), *long("width", "height", "dpi", "version"), "bg_chunk")


@query("""SELECT p_partkey, p_partkey % 2 = 0 AS bg_color, (p_size + 1)::BIGINT AS bg_width, (p_partkey % 40 + 1)::BIGINT AS bg_height, (p_partkey % 3 + 1)::BIGINT AS bg_chunks, ((p_partkey % 3 + 1) * (p_size % 3))::BIGINT AS bg_slices,
(p_partkey % 7)::BIGINT AS fgbz_colors, p_partkey % 5 = 0 AS fgbz_shape_table, ((p_partkey % 5) * 5)::BIGINT AS gamma10, (9 * (p_partkey % 3 + 1) - 7 * (p_partkey % 3))::BIGINT AS bg_bytes, CASE WHEN p_partkey % 5 * 5 = 0 THEN 22 ELSE p_partkey % 5 * 5 END::BIGINT AS page_gamma10 FROM part""")
def header_inventory(spark, sf_dir):
    """Layer, palette and gamma headers as the inventory reads them, and gamma as the decoder does."""
    source = table(spark, sf_dir, "part").select("p_partkey", "p_size")

    def make(p_partkey, p_size):
        first = ground(p_size + 1, p_partkey % 40 + 1, p_size % 3)
        first = first[:2] + bytes([1 if p_partkey % 2 == 0 else 0x81]) + first[3:]
        colours = p_partkey % 7
        palette = b"\0" + colours.to_bytes(2, "big") + b"abc" * colours + (b"more" if p_partkey % 5 == 0 else b"")
        layers = [X.chunk("BG44", first if n == 0 else bytes([n, p_size % 3])) for n in range(p_partkey % 3 + 1)]
        return str(p_partkey), X.single(X.info(100, 100, gamma=p_partkey % 5 * 5), *layers, X.chunk("FGbz", palette))

    files = X.pack(source, make)
    tenths = lambda c: F.round(F.col(c) * 10).cast("long")
    decoded = tables.pages(files).select("path", tenths("gamma").alias("page_gamma10"))
    own = inventory.page_inventory(files).join(decoded, "path")
    return own.select(key("p_partkey"), "bg_color", *long("bg_width", "bg_height", "bg_chunks", "bg_slices", "fgbz_colors"), "fgbz_shape_table", tenths("gamma").alias("gamma10"), *long("bg_bytes"), "page_gamma10")


@query("""SELECT p_size, bool_or(p_partkey & 1 > 0) AS any_mask, bool_or(p_partkey & 2 > 0) AS any_bg, bool_or(p_partkey & 4 > 0) AS any_fg44, bool_or(p_partkey & 8 > 0) AS any_palette, bool_or(p_partkey % 8 IN (2, 5, 6)) AS any_rotated, max(p_partkey % 100 + 100)::BIGINT AS max_dpi FROM part GROUP BY p_size""")
def any_page_has(spark, sf_dir):
    """What any page of a document has."""
    parts = table(spark, sf_dir, "part").groupBy("p_size").agg(F.array_sort(F.collect_list("p_partkey")).alias("parts"))

    def make(p_size, parts):
        chunks = ("Sjbz", "BG44", "FG44", "FGbz")
        return str(p_size), X.bundle([(f"p{p}", None, 1, X.form("DJVU", X.info(10, 10, dpi=p % 100 + 100, flags=p % 8), *[X.chunk(c, b"") for k, c in enumerate(chunks) if p >> k & 1])) for p in parts])

    return inventory.any_page(tables.pages(X.pack(parts, make))).select(F.col("path").cast("int").alias("p_size"), "any_mask", "any_bg", "any_fg44", "any_palette", "any_rotated", *long("max_dpi"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey & 2 > 0 THEN 'bg' WHEN o_orderkey & 1 > 0 THEN 'mask' ELSE 'other' END AS kind FROM orders")
def verify_kind(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    bit = lambda n: F.col("o_orderkey").bitwiseAND(F.lit(n)) > 0
    return orders.select("o_orderkey", R.verify_kind_column(bit(1), bit(2)).alias("kind"))


# --- bytes out ------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(unhex(printf('%06X', octet_length(encode(text)))) || encode(text) || '\\x01'::BLOB) AS digest FROM documents")
def chunk_payloads(spark, sf_dir):
    """The text chunk's bytes as they stand in the file."""
    return tables.chunks(document_files(spark, sf_dir), ["TXTa"]).select(key("doc_id"), F.md5("payload").alias("digest"))


@query("SELECT doc_id, text FROM documents")
def text_streams(spark, sf_dir):
    """Whole documents through the block-sorting compressor and back; empty texts stay empty, null stays null."""
    packed = X.pack_streams(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return tables.unpack_stream(packed, "content", empty=b"").select(key("doc_id"), F.decode("raw", "UTF-8").alias("text"))


@query("""SELECT p_partkey, md5(encode('P5' || chr(10) || (p_size + 2) // 2 || ' ' || (p_partkey % 30 + 2) // 2 || chr(10) || '255' || chr(10)) || unhex(repeat('FF', ((p_size + 2) // 2 * ((p_partkey % 30 + 2) // 2))::INTEGER))) AS digest FROM part""")
def blank_page_maps(spark, sf_dir):
    """Pages without layers at half size, as grey maps: every byte of them."""
    files = part_files(spark, sf_dir, width="p_size + 1", height="p_partkey % 30 + 1")
    return tables.pnm(tables.renders(tables.page_units(files), 2)).select(key("p_partkey"), F.md5("pnm").alias("digest"))


@query("SELECT p_partkey, (p_size % 9 + 1)::BIGINT AS width, 2::BIGINT AS height, md5(list_reduce(list_transform(range(0, (p_size % 9 + 1) * 6), lambda i: unhex(printf('%02X', (p_partkey + i * 7) % 256))), lambda a, b: a || b)) AS digest FROM part")
def colour_maps_read(spark, sf_dir):
    """Colour maps with comments and odd blanks in their headers, read from bytes that no writer of ours made."""
    source = table(spark, sf_dir, "part").select("p_partkey", "p_size")

    def make(p_partkey, p_size):
        w = p_size % 9 + 1
        return str(p_partkey), b"P6 # a note\n%d\t2\n#more\n255 " % w + bytes((p_partkey + i * 7) % 256 for i in range(w * 6))

    maps = X.pack(source, make).select("path", F.lit(0).alias("page_no"), F.col("content").alias("pnm"))
    return tables.from_pnm(maps).select(key("p_partkey"), *long("width", "height"), F.md5("data").alias("digest"))


@query("""
WITH c AS (SELECT p_partkey, 'PM44' || chr(0) || chr(0) || chr(0) AS t, CASE WHEN n = 0 THEN '09' || '00' || printf('%02X', p_size % 3) || '0102' || printf('%04X', p_size + 1) || printf('%04X', p_partkey % 40 + 1) || '80' || '00' ELSE '02' || printf('%02X', n) || printf('%02X', p_size % 3) END AS body, n FROM part, range(0, 3) r(n) WHERE n < p_partkey % 3 + 1),
f AS (SELECT p_partkey, string_agg('504D3434000000' || body, '' ORDER BY n) AS body FROM c GROUP BY 1)
SELECT p_partkey, md5(unhex('41542654464F524D' || printf('%08X', length(body) // 2 + 4) || '504D3434' || body)) AS digest FROM f""")
def layer_files(spark, sf_dir):
    """A page's background as a file of its own."""
    source = table(spark, sf_dir, "part").select("p_partkey", "p_size")

    def make(p_partkey, p_size):
        first = ground(p_size + 1, p_partkey % 40 + 1, p_size % 3)
        return str(p_partkey), X.single(X.info(100, 100), *[X.chunk("BG44", first if n == 0 else bytes([n, p_size % 3])) for n in range(p_partkey % 3 + 1)])

    return tables.layer_file(tables.chunks(X.pack(source, make), ["BG44"])).select(key("p_partkey"), F.md5("file").alias("digest"))


@query("SELECT conv_id, turn AS page_no, text FROM conversations UNION ALL SELECT conv_id, max(turn) + 1, '' FROM conversations GROUP BY conv_id")
def blob_texts(spark, sf_dir):
    """Texts of pages packed with their lengths in front; pages that a blob lacks are empty."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))

    def make(conv_id, turns):
        return str(conv_id), b"".join(struct.pack(">I", len(t["text"].encode())) + t["text"].encode() for t in turns)

    packed = X.pack(turns, make).join(turns.select(F.col("conv_id").cast("string").alias("path"), (F.size("turns") + 1).alias("n_pages")), "path")
    return tables.blob_texts(packed.withColumnRenamed("content", "blob")).select(key("conv_id"), *long("page_no"), "text")


# --- comparing renders ----------------------------------------------------------------------------

#: What the fixture does with a page by its turn and conversation: same, other pixels, other size, missing in the oracle, missing here, nothing on either side.
PLANTED = "(conv_id + turn) % 6"


def planted_renders(spark, sf_dir):
    images = tables.renders(tables.page_units(conversation_files(spark, sf_dir))).withColumn("k", F.expr("(cast(path as long) + page_no) % 6"))
    none = lambda when: {c: F.when(~when, F.col(c)) for c in ("width", "height", "format", "data")}
    own = images.where("k <> 4").withColumns(none(F.col("k") == 5)).drop("k")
    other = images.where("k <> 3").withColumns(none(F.col("k") == 5)).withColumn("height", F.expr("if(k = 2, 49, height)"))
    other = other.withColumn("data", F.expr("CASE k WHEN 1 THEN concat(X'00', substring(data, 2)) WHEN 2 THEN substring(data, 1, 4900) ELSE data END")).drop("k")
    return verify.verify_renders(own, other)


@query(f"SELECT conv_id, count(*)::BIGINT AS pages, count(*) FILTER ({PLANTED} = 0)::BIGINT AS match, count(*) FILTER ({PLANTED} IN (1, 2))::BIGINT AS mismatch, count(*) FILTER ({PLANTED} IN (3, 4))::BIGINT AS skip, count(*) FILTER ({PLANTED} = 5)::BIGINT AS both_empty FROM conversations GROUP BY conv_id")
def verify_planted(spark, sf_dir):
    """Totals of a comparison with differences, missing pages and empty ones planted."""
    return verify.verify_totals(planted_renders(spark, sf_dir)).select(key("conv_id"), "pages", "match", "mismatch", "skip", "both_empty")


@query(f"SELECT conv_id, turn AS page_no, CASE {PLANTED} WHEN 1 THEN 1::BIGINT END AS diff_pixels FROM conversations WHERE {PLANTED} IN (1, 2) ORDER BY conv_id::VARCHAR, turn LIMIT 50")
def failure_list(spark, sf_dir):
    """The first mismatches; a top-n report."""
    return verify.failures(planted_renders(spark, sf_dir)).select(key("conv_id"), *long("page_no", "diff_pixels"))


# --- reports and formats --------------------------------------------------------------------------


@query("""
WITH a AS (SELECT user_id, sum(floor(value * 1000))::BIGINT AS before_ms FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, sum(floor(value * 1000))::BIGINT AS after_ms FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT user_id, before_ms, after_ms, after_ms - before_ms AS diff_ms FROM a JOIN b USING (user_id) ORDER BY diff_ms DESC, diff_ms / before_ms DESC LIMIT 10""")
def slowest_report(spark, sf_dir):
    """Those that lost most between two runs; a top-n report."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.col("value") * 1000).alias("ms"))
    side = lambda k: events.where(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.sum("ms").alias("ms"))
    compared = R.timing_compare(side(0), side(1), "user_id", "ms").where("status = 'both'")
    return R.slowest(compared).select("user_id", "before_ms", "after_ms", "diff_ms")


@query("""
WITH n AS (SELECT l_orderkey, l_linenumber, l_orderkey * l_partkey * 997 AS b, (l_orderkey * 7919 + l_suppkey) * l_linenumber % 9000000 AS ms, l_partkey % 400 - 200 AS q FROM lineitem),
m AS (SELECT *, (b * 10 + 512) // 1024 AS kb, (b * 10 + 524288) // 1048576 AS mb, (b * 100 + 536870912) // 1073741824 AS gb, (abs(q) * 10 + 2) // 4 AS pct, ms // 1000 AS s, (ms + 5) // 10 AS cs FROM n)
SELECT l_orderkey, l_linenumber, CASE WHEN b >= 1073741824 THEN printf('%d.%02d GB', gb // 100, gb % 100) WHEN b >= 1048576 THEN printf('%d.%d MB', mb // 10, mb % 10) WHEN b >= 1024 THEN printf('%d.%d KB', kb // 10, kb % 10) ELSE b || ' B' END AS size,
CASE WHEN s >= 3600 THEN printf('%dh %dm %ds', s // 3600, s // 60 % 60, s % 60) WHEN s >= 60 THEN printf('%dm %ds', s // 60, s % 60) WHEN s >= 1 THEN printf('%d.%02ds', cs // 100, cs % 100) ELSE ms || 'ms' END AS duration, printf('%s%d.%d%%', CASE WHEN q < 0 THEN '-' ELSE '+' END, pct // 10, pct % 10) AS share FROM m""")
def readable_values(spark, sf_dir):
    """Sizes up to gigabytes, durations up to hours, and shares."""
    n = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_orderkey * l_partkey * 997 as b", "(l_orderkey * 7919 + l_suppkey) * l_linenumber % 9000000 as ms", "(l_partkey % 400 - 200) / 4 as q")
    return n.select("l_orderkey", "l_linenumber", R.readable_bytes(F.col("b")).alias("size"), R.readable_duration(F.col("ms")).alias("duration"), R.readable_percent(F.col("q")).alias("share"))


@query("""SELECT o_orderkey, o_orderkey % 3 = 1 AS is_layer, (o_orderkey % 500)::BIGINT AS page, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey / 4 END AS before_ms, CASE WHEN o_custkey % 5 <> 0 THEN (o_custkey + 3) / 8 END AS after_ms FROM orders WHERE o_orderkey % 3 < 2""")
def timing_log(spark, sf_dir):
    """Lines of a timing log: pages, layers, failures, and lines that are neither."""
    value = lambda when, number: f"if({when}, 'ERROR', cast({number} as string))"
    line = f"concat(if(o_orderkey % 3 = 1, '  layer ', if(o_orderkey % 3 = 2, 'total ', '')), 'p', o_orderkey % 500, '  ', {value('o_custkey % 7 = 0', 'o_custkey / 4')}, ' ', {value('o_custkey % 5 = 0', '(o_custkey + 3) / 8')}, ' rest')"
    log = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(line).alias("line"))
    return R.parse_timings(log).select("o_orderkey", "is_layer", F.col("page").cast("long").alias("page"), "before_ms", "after_ms")


@query("""SELECT user_id, event_id AS page, floor(value * 4) / 4 AS own, (floor(value * 4) + event_id % 9) / 4 AS other, (event_id % 9 - 4) / 4 AS diff, (event_id % 9 - 4) * 12.5 AS share FROM events WHERE event_id % 11 <> 0 AND event_id > 10 * (user_id % 4 + 1)""")
def comparison_table(spark, sf_dir):
    """Rows of the table in a comparison's log: only those behind its heading, only whole ones."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.col("value") * 4).alias("v"))
    row = "concat(event_id, '  ', v / 4, ' ', (v + event_id % 9) / 4, ' ', if(event_id % 9 >= 4, '+', ''), (event_id % 9 - 4) / 4, '  ', if(event_id % 9 >= 4, '+', ''), (event_id % 9 - 4) * 12.5, if(event_id % 11 = 0, '', '%'))"
    lines = events.select("user_id", F.col("event_id").alias("line_no"), F.expr(row).alias("line"))
    heads = events.select("user_id").distinct().select("user_id", (F.lit(10) * (F.col("user_id") % 4 + 1) + 0.5).cast("double").alias("line_no"), F.lit("pages (best of 3), 12 slower").alias("line"))
    log = lines.withColumn("line_no", F.col("line_no").cast("double")).union(heads)
    return R.parse_comparison(log, ["user_id"], "line_no").select("user_id", F.col("page").cast("long").alias("page"), "own", "other", "diff", "share")


@query("""
WITH p AS (SELECT conv_id, turn, 'page ' || turn + 1 || ': 100x50 dpi=300 ver=26 rot=0 id=p' || turn || '.djvu title=' || role AS line FROM conversations)
SELECT conv_id, 'info' AS part, turn::BIGINT AS n, line FROM p UNION ALL SELECT conv_id, 'outline', 0, 'c' || conv_id || ' ->  (page -1)' FROM (SELECT DISTINCT conv_id FROM conversations)
UNION ALL SELECT conv_id, 'outline', turn + 1, '  ' || role || ' -> ' || CASE WHEN turn % 2 = 1 THEN '#' || turn + 1 ELSE '#p' || turn || '.djvu' END || ' (page ' || turn || ')' FROM conversations""")
def printed_books(spark, sf_dir):
    """Page information and outlines as lines to print."""
    files = conversation_files(spark, sf_dir)
    info = R.pretty_info(tables.pages(files)).select("path", F.lit("info").alias("part"), F.col("page_no").alias("n"), "line")
    outline = R.pretty_outline(tables.outline(files)).select("path", F.lit("outline").alias("part"), F.col("node_id").alias("n"), "line")
    return info.union(outline).select(key("conv_id"), "part", *long("n"), "line")


@query("""
WITH l AS (SELECT item_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM benchmark),
w AS (SELECT item_id, n, unnest(string_split(line, ' ')) AS word, generate_subscripts(string_split(line, ' '), 1) AS k FROM l),
x AS (SELECT *, coalesce(sum(8 * length(word) + 4) OVER (PARTITION BY item_id, n ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS x FROM w),
t AS (SELECT item_id, n, k, '    word [' || x || ',' || 12 * n || ' ' || 8 * length(word) || 'x10]' || CASE WHEN word <> '' THEN ' "' || word || '"' ELSE '' END AS line FROM x
UNION ALL SELECT item_id, n, 0, '  line [0,' || 12 * n || ' ' || 8 * length(line) - 4 * (length(line) - length(replace(line, ' ', ''))) || 'x10]' FROM l UNION ALL SELECT DISTINCT item_id, -1, 0, 'page [0,0 4000x1000]' FROM l)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY n, k) - 1)::BIGINT AS n, line FROM t""")
def printed_zones(spark, sf_dir):
    """Zone trees as lines to print, in preorder."""
    return R.pretty_zones(tables.zones(benchmark_files(spark, sf_dir))).select(key("item_id"), F.col("zone_id").cast("long").alias("n"), "line")


@query("""SELECT page_id, 'link 0: [1,' || 44 - page_id % 20 || ' 30x4] shape=' || page_id % 3 || ' -> ' || url || CASE WHEN page_id % 2 = 0 THEN ' ; c' || page_id ELSE '' END AS line FROM pages""")
def printed_links(spark, sf_dir):
    """Links of three shapes as lines to print; a comment may be missing."""

    def make(page_id, url):
        shape = ("rect", "oval", "text")[page_id % 3]
        note = X.quoted(f"c{page_id}") if page_id % 2 == 0 else ""
        return str(page_id), X.single(X.info(100, 50), X.chunk("ANTa", f"(maparea {X.quoted(url)} {note} ({shape} 1 {2 + page_id % 20} 30 4) (xor))".encode()))

    return R.pretty_links(tables.links(X.pack(table(spark, sf_dir, "pages").select("page_id", "url"), make))).select(key("page_id"), "line")


@query("""
WITH s AS (SELECT user_id, event_id, floor(value * 10)::BIGINT AS v, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
e AS (SELECT * REPLACE (CASE WHEN pos % 2 = 0 THEN v - ((9 * (coalesce(lag(v, 1) OVER w, 0) + coalesce(lead(v, 1) OVER w, 0)) - coalesce(lag(v, 3) OVER w, 0) - coalesce(lead(v, 3) OVER w, 0) + 16) >> 5) ELSE v END AS v) FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, (CASE WHEN pos % 2 = 0 THEN v WHEN pos >= 3 AND pos + 3 < n THEN v + ((9 * (lag(v, 1) OVER w + lead(v, 1) OVER w) - lag(v, 3) OVER w - lead(v, 3) OVER w + 8) >> 4) ELSE v + ((lag(v, 1) OVER w + coalesce(lead(v, 1) OVER w, lag(v, 1) OVER w) + 1) >> 1) END)::BIGINT AS restored FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def iw44_both_steps(spark, sf_dir):
    """Both inverse wavelet steps: lifting, then interpolation."""
    s = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.col("value") * 10).alias("v"))
    lifted = R.lift_step(s, ["user_id"], "event_id", "v")
    return R.interpolate_step(lifted, ["user_id"], "event_id", "lifted").select("event_id", F.col("restored").cast("long"))


@query("""SELECT conv_id, turn AS page_no, (turn % 90)::BIGINT AS x0, 3::BIGINT AS y0, (turn % 90 + 1)::BIGINT AS x1, 4::BIGINT AS y1, 4::BIGINT AS ink FROM conversations""")
def mask_runs(spark, sf_dir):
    """Ink of decoded pages from their runs: box and amount."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))

    def make(conv_id, turns):
        dot = np.ones((2, 2), np.uint8)
        return str(conv_id), X.bundle([(f"p{t}", None, 1, X.form("DJVU", X.info(100, 50), X.chunk("Sjbz", jb2.encode(100, 50, [(dot, t % 90, 3)])))) for t in turns])

    runs = tables.ink_runs(tables.page_units(X.pack(turns, make)))
    total = runs.groupBy("path", "page_no").agg(F.min("x0").alias("x0"), F.min("y").alias("y0"), (F.max("x1") - 1).alias("x1"), F.max("y").alias("y1"), F.sum(F.col("x1") - F.col("x0")).alias("ink"))
    return total.select(key("conv_id"), *long("page_no", "x0", "y0", "x1", "y1", "ink"))


# --- SQL table functions --------------------------------------------------------------------------


def in_sql(spark, files, sql: str):
    """A query in Spark's SQL over a frame named {files}, with the table functions registered."""
    tables.register_functions(spark)
    return spark.sql(sql, files=files)


@query("SELECT item_id, sum(len(string_split(line, ' ')))::BIGINT AS words, count(*)::BIGINT AS lines FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark) GROUP BY item_id")
def zones_in_sql(spark, sf_dir):
    return in_sql(spark, benchmark_files(spark, sf_dir), "SELECT cast(path AS bigint) AS item_id, count_if(z.type = 6) AS words, count_if(z.type = 5) AS lines FROM {files}, LATERAL doc_zones(content) z GROUP BY path")


@query("SELECT conv_id, turn + 1 AS node_id, role AS title FROM conversations")
def outline_in_sql(spark, sf_dir):
    return in_sql(spark, conversation_files(spark, sf_dir), "SELECT cast(path AS bigint) AS conv_id, cast(o.node_id AS bigint) AS node_id, o.title FROM {files}, LATERAL doc_outline(content) o WHERE o.depth = 1")


@query("SELECT p_size, 4::BIGINT AS ink, 2::BIGINT AS records, 'https://example.org/' || p_size AS url FROM (SELECT DISTINCT p_size FROM part)")
def marks_in_sql(spark, sf_dir):
    """Links, records and ink of a page, each by its table function."""

    def make(p_size):
        mask = jb2.encode(20, 20, [(np.ones((2, 2), np.uint8), 3, 4)])
        note = f"(maparea {X.quoted(f'https://example.org/{p_size}')} {X.quoted('')} (rect 0 0 9 9))"
        return str(p_size), X.single(X.info(20, 20), X.chunk("Sjbz", mask), X.chunk("ANTa", note.encode()))

    files = X.pack(table(spark, sf_dir, "part").select("p_size").distinct(), make)
    return in_sql(spark, files, """SELECT cast(a.path AS int) AS p_size, a.ink, b.records, c.url FROM (SELECT path, sum(r.x1 - r.x0) AS ink FROM {files}, LATERAL doc_ink_runs(content) r GROUP BY path) a
    JOIN (SELECT path, sum(n) AS records FROM {files}, LATERAL doc_jb2_records(content) WHERE record_type IN ('start', 'new mark') GROUP BY path) b ON a.path = b.path JOIN (SELECT path, l.url FROM {files}, LATERAL doc_links(content) l) c ON a.path = c.path""")


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'djvm' WHEN 1 THEN 'bundled' ELSE 'single' END AS kind, (o_orderkey % 3 = 1)::BIGINT + (o_orderkey % 3 = 2)::BIGINT AS pages FROM orders")
def pageless_bundles(spark, sf_dir):
    """Bundles without a page are of a kind of their own."""
    page = X.form("DJVU", X.info(10, 10))
    data = (X.bundle([("s", None, 0, X.form("DJVI", X.chunk("ANTa", b"(a)")))]), X.bundle([("p", None, 1, page)]), b"AT&T" + page)
    kinds = R.container_kind(tables.documents(X.pack(table(spark, sf_dir, "orders").select("o_orderkey"), lambda o_orderkey: (str(o_orderkey), data[o_orderkey % 3]))))
    return kinds.select(key("o_orderkey"), "kind", F.col("n_pages").cast("long").alias("pages"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 2 THEN 10 WHEN 4 THEN 15 ELSE 20 END::BIGINT AS width, CASE p_partkey % 5 WHEN 2 THEN 5 WHEN 4 THEN 20 ELSE 15 END::BIGINT AS height, CASE p_partkey % 5 WHEN 0 THEN 'RGB24' ELSE 'GRAY8' END AS format, CASE WHEN p_partkey % 5 IN (1, 2) THEN 'not as planned' END AS error FROM part""")
def exact_renders(spark, sf_dir):
    """Pages at half size, and which of them an exact rendering refuses: a background that can't be used, a mask of another size."""

    def make(p_partkey):
        kind = p_partkey % 5
        mask = X.chunk("Sjbz", jb2.encode(20, 10, [(np.ones((2, 2), np.uint8), 3, 4)]) if kind == 2 else jb2.encode(40, 30, [(np.ones((2, 2), np.uint8), 3, 4)]))
        layers = {0: [X.chunk("BG44", ground(20, 15))], 1: [mask, X.chunk("BG44", b"\0\0\2\0")], 2: [mask], 3: [mask], 4: [mask]}
        return str(p_partkey), X.single(X.info(40, 30, flags=6 if kind == 4 else 1), *layers[kind])

    units = tables.page_units(X.pack(table(spark, sf_dir, "part").select("p_partkey"), make))
    exact = tables.renders(units, 2, exact=True).select("path", "error")
    return tables.renders(units, 2).drop("error").join(exact, "path").select(key("p_partkey"), *long("width", "height"), "format", "error")


@query("SELECT least(25, count(*))::BIGINT AS n, least(25, count(*))::BIGINT AS known, true AS again, count(*) <= 25 AS everything FROM (SELECT DISTINCT url FROM pages)")
def sample_of_files(spark, sf_dir):
    """A sample of the files: as many as asked for, each once, the same again for the same seed, others for another."""
    paths = table(spark, sf_dir, "pages").select(F.col("url").alias("path")).distinct()
    drawn = [R.sample_files(paths, 25, seed).select("path", F.lit(k).alias("k")) for k, seed in enumerate((1, 1, 2))]
    known = drawn[0].join(paths, "path", "left_semi").select("path", F.lit(3).alias("k"))
    sets = drawn[0].union(drawn[1]).union(drawn[2]).union(known).agg(*[F.array_sort(F.collect_list(F.when(F.col("k") == k, F.col("path")))).alias(name) for k, name in enumerate(("one", "two", "other", "known"))])
    return sets.select(F.size("one").cast("long").alias("n"), F.size("known").cast("long").alias("known"), (F.col("one") == F.col("two")).alias("again"), (F.col("one") == F.col("other")).alias("everything"))
