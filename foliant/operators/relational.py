"""The engine's relational kernels: look-ups, totals and recurrences as DataFrame functions.

All are plain columns, joins, aggregates and windows, so Catalyst plans them: small look-up sides
are broadcast by its own size check, large ones shuffle. Column names are parameters where a
kernel may serve several tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# --- predicates and projections ---------------------------------------------------------------


def page_type_column(mask: Column, background: Column, foreground: Column) -> Column:
    layer = background | foreground
    return F.when(mask & layer, "compound").when(mask, "bitonal").when(layer, "photo").otherwise("unknown")


def inventory_kind_column(mask: Column, background: Column, foreground: Column, width: Column) -> Column:
    """The inventory's own classes, which count formats that aren't decoded: compound, bitonal, photo (background only), blank, unknown."""
    return F.when(mask & (background | foreground), "compound").when(mask, "bitonal").when(background, "photo").when(width > 0, "blank").otherwise("unknown")


def verify_kind_column(mask: Column, colour: Column) -> Column:
    return F.when(colour, "bg").when(mask, "mask").otherwise("other")


def container_kind(documents: DataFrame) -> DataFrame:
    bundle = F.col("form_type") == "DJVM"
    kind = F.when(F.col("error").isNotNull(), "unknown").when(bundle & F.col("bundled") & (F.col("n_pages") > 0), "bundled").when(bundle & ~F.col("bundled"), "indirect").when(bundle, "djvm").when(F.col("form_type").isin("DJVU", "PM44", "BM44"), "single").otherwise("unknown")
    return documents.withColumn("kind", kind)


def rotation_column(flags: Column) -> Column:
    low = flags.bitwiseAND(F.lit(7))
    return F.when(low == 6, 90).when(low == 2, 180).when(low == 5, 270).otherwise(0)


def ceil_div(a: Column, b: Column) -> Column:
    return F.floor((a + b - 1) / b).cast("int")


def render_plan(pages: DataFrame, subsample: int = 1, compose: bool = True) -> DataFrame:
    """Size and format that rendering will give, from page metadata alone; nulls where it gives nothing."""
    sub = F.lit(max(subsample, 1))
    colour = F.lit(compose) & F.col("page_type").isin("compound", "photo") & F.col("has_bg")
    ok = (F.col("width") > 0) & (F.col("height") > 0) & (colour | (F.col("page_type") == "unknown") | F.col("has_mask"))
    w, h = ceil_div(F.col("width"), sub), ceil_div(F.col("height"), sub)
    turned = F.col("rotation").isin(90, 270)
    return pages.withColumns({"plan_width": F.when(ok, F.when(turned, h).otherwise(w)), "plan_height": F.when(ok, F.when(turned, w).otherwise(h)), "plan_format": F.when(ok, F.when(colour, "RGB24").otherwise("GRAY8"))})


def pick_subsample(width: Column, height: Column, dpi: Column, target_dpi: int = 300) -> Column:
    """The largest reduction that keeps a page's size at `target_dpi` or more."""
    fair = F.when(dpi.between(25, 6000), dpi).otherwise(300)
    target = lambda n: F.floor(n * target_dpi / fair + 0.5).cast("int")
    limit = lambda n, t: F.when(t >= 2, F.floor((n - 1) / F.greatest(t - 1, F.lit(1)))).cast("int")
    a, b = target(width), target(height)
    return F.greatest(F.lit(1), F.least(limit(width, a), limit(height, b), width, height))


def reduction_column(width: Column, height: Column, layer_width: Column, layer_height: Column) -> Column:
    """The least factor up to 15 from page to layer, rounded up; 0 if there is none."""
    fits = F.filter(F.sequence(F.lit(1), F.lit(15)), lambda r: (ceil_div(width, r) == layer_width) & (ceil_div(height, r) == layer_height))
    return F.coalesce(F.array_min(fits), F.lit(0))


#: Hardening of our own: pixels that a blank page may have.
BLANK_PIXELS = 1 << 27


def blank_pages(pages: DataFrame, subsample: int = 1) -> DataFrame:
    """White grey pixels for pages without layers; null where a page declares too many."""
    w, h = ceil_div(F.col("width"), F.lit(subsample)), ceil_div(F.col("height"), F.lit(subsample))
    n = w.cast("long") * h
    return pages.withColumns({"out_width": w, "out_height": h, "data": F.when(n <= BLANK_PIXELS, F.unhex(F.repeat(F.lit("FF"), n.cast("int"))))})


def readable_bytes(n: Column) -> Column:
    """1024-based: gigabytes to two places, mega- and kilobytes to one."""
    unit = lambda k, form: F.format_string(form, n / F.lit(1024**k))
    return F.when(n >= 1024**3, unit(3, "%.2f GB")).when(n >= 1024**2, unit(2, "%.1f MB")).when(n >= 1024, unit(1, "%.1f KB")).otherwise(F.format_string("%d B", n))


def readable_duration(ms: Column) -> Column:
    whole = F.floor(ms / 1000)
    h, m, s = F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60
    return F.when(whole >= 3600, F.format_string("%dh %dm %ds", h, m, s)).when(whole >= 60, F.format_string("%dm %ds", m, s)).when(whole >= 1, F.format_string("%.2fs", ms / 1000)).otherwise(F.format_string("%dms", F.floor(ms)))


def readable_percent(x: Column) -> Column:
    return F.format_string("%+.1f%%", x)


# --- look-ups -----------------------------------------------------------------------------------


def trimmed_id(raw: Column) -> Column:
    return F.regexp_replace(F.substring(raw, 1, 63), "[\\n\\r \\t\\x1a]+$", "")


def resolve_includes(includes: DataFrame, components: DataFrame) -> DataFrame:
    """Includes (path, page_no, chunk_no, incl_id) with the offset of the first component of that id, 0 if none."""
    first = components.where("comp_id is not null").groupBy("path", F.col("comp_id").alias("incl_id")).agg(F.min_by("offset", "comp_no").alias("offset"))
    own = includes.withColumn("incl_id", trimmed_id(F.col("incl_id")))
    return own.join(first, ["path", "incl_id"], "left").withColumn("offset", F.coalesce("offset", F.lit(0)))


def first_match(left: DataFrame, right: DataFrame, on: list[str], order: list[str], take: list[str]) -> DataFrame:
    """Each left row with columns of the right rows' first, in `order`, of its key; null without one."""
    first = right.groupBy(*on).agg(F.min_by(F.struct(*take), F.struct(*order)).alias("_first"))
    return left.join(first, on, "left").select(*left.columns, *[F.col(f"_first.{c}").alias(c) for c in take])


def distinct_payloads(chunks: DataFrame) -> DataFrame:
    """One row per distinct (size, content), its first place, and how many share it."""
    return chunks.groupBy("size", F.sha2("payload", 256).alias("digest")).agg(F.min(F.struct("path", "offset")).alias("first"), F.count("*").alias("copies"))


def shared_ids(includes: DataFrame, components: DataFrame) -> DataFrame:
    """Include ids and the directory's type-0 ids of each document, once each, in order of first sight."""
    seen = includes.select("path", F.lit(0).alias("rank"), F.col("page_no").alias("a"), F.col("chunk_no").alias("b"), F.col("incl_id").alias("id"))
    listed = components.where("type = 0 and comp_id is not null").select("path", F.lit(1).alias("rank"), F.lit(0).alias("a"), F.col("comp_no").alias("b"), F.col("comp_id").alias("id"))
    first = seen.unionByName(listed).groupBy("path", "id").agg(F.min(F.struct("rank", "a", "b")).alias("at"))
    return first.withColumn("ordinal", F.row_number().over(W.partitionBy("path").orderBy("at")) - 1).drop("at")


def resolve_destinations(nodes: DataFrame, pages: DataFrame, url: str = "url", numbers: bool = True) -> DataFrame:
    """page_no of each url: after one leading #, a number from 1 (if allowed), else a page's id; -1 if there is none."""
    name = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "^#", "")
    count = pages.groupBy("path").agg(F.count("*").alias("_pages"))
    ids = pages.where("page_id is not null").groupBy("path", F.col("page_id").alias("_name")).agg(F.min("page_no").alias("_by_id"))
    out = nodes.withColumn("_name", name).join(count, "path", "left").join(ids, ["path", "_name"], "left")
    n = F.expr("try_cast(_name as int)") - 1
    by_number = F.when((n >= 0) & (n < F.coalesce("_pages", F.lit(0))), n).otherwise(-1)
    is_number = F.col("_name").rlike("^[0-9]+$") if numbers else F.lit(False)
    page = F.when(F.col("_name") == "", -1).when(is_number, F.coalesce(by_number, F.lit(-1))).otherwise(F.coalesce("_by_id", F.lit(-1)))
    return out.withColumn("page_no", page.cast("int")).select(*[c for c in nodes.columns if c != "page_no"], "page_no")


def blit_shapes(blits: DataFrame, shapes: DataFrame) -> DataFrame:
    """Placements with their shape's size; those of an unknown shape go."""
    return blits.join(shapes.select("path", "page_no", "shape_no", "w", "h", "inherited"), ["path", "page_no", "shape_no"])


def palette_lookup(blits: DataFrame, blit_colors: DataFrame, palette: DataFrame, on: list[str]) -> DataFrame:
    """Placements with their colour; black where the index or the palette lacks it."""
    out = blits.join(blit_colors, [*on, "blit_no"], "left").join(palette, [*on, "color_no"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("r", "g", "b")})


def timing_compare(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Both sides' timings by key; what one side lacks is named."""
    a, b = before.select(key, F.col(value).alias("before_ms")), after.select(key, F.col(value).alias("after_ms"))
    out = a.join(b, key, "full")
    status = F.when(F.col("before_ms").isNull(), "missing in before").when(F.col("after_ms").isNull(), "missing in after").otherwise("both")
    return out.withColumns({"diff_ms": F.col("after_ms") - F.col("before_ms"), "status": status})


# --- totals ---------------------------------------------------------------------------------------


def ink_coverage(pixels: DataFrame, keys: list[str], x: str, y: str, sub: int) -> DataFrame:
    """Ink per sub x sub cell, saturating at 255, and its grey."""
    full = min(sub * sub, 255)
    cells = pixels.groupBy(*keys, F.floor(F.col(x) / sub).cast("long").alias("cx"), F.floor(F.col(y) / sub).cast("long").alias("cy")).agg(F.least(F.count("*"), F.lit(255)).alias("ink"))
    return cells.withColumn("gray", (255 - F.floor(F.least("ink", F.lit(full)) * 255 / full)).cast("long"))


def run_coverage(runs: DataFrame, width: int, height: int, sub: int, keys: list[str] | None = None) -> DataFrame:
    """Ink of runs per cell against the cell's true area on the page, as alpha."""
    keys = keys or []
    inside = runs.where((F.col("y") >= 0) & (F.col("y") < height)).withColumns({"x0": F.greatest("x0", F.lit(0)), "x1": F.least("x1", F.lit(width))}).where("x0 < x1")
    cell = inside.withColumn("cx", F.explode(F.sequence(F.floor(F.col("x0") / sub), F.floor((F.col("x1") - 1) / sub)))).withColumn("cy", F.floor(F.col("y") / sub))
    part = F.least(F.col("x1").cast("long"), (F.col("cx") + 1) * sub) - F.greatest(F.col("x0").cast("long"), F.col("cx") * sub)
    area = F.least(F.lit(sub), width - F.col("cx") * sub) * F.least(F.lit(sub), height - F.col("cy") * sub)
    out = cell.groupBy(*keys, "cx", "cy").agg(F.sum(part).alias("ink"))
    return out.withColumn("alpha", F.when(F.col("ink") >= area, 255).otherwise(F.floor(F.col("ink") * 255 / area)).cast("long"))


def ink_box(pixels: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return pixels.groupBy(*keys).agg(F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax"))


def shape_uses(blits: DataFrame, keys: list[str], shape: str = "shape_no") -> DataFrame:
    return blits.groupBy(*keys, shape).agg(F.count("*").alias("uses"))


#: Samples, and samples in a million, by which a colour page may differ.
TOLERATED, PER_MILLION = 2000, 100


def image_difference(pairs: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Of each row's arrays of samples: mean and largest difference, how many differ, and whether that is within the tolerance for colour pages. One pass within the row."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("most"), F.lit(0).cast("long").alias("n"))
    d = F.expr("aggregate(_d, _zero, (s, x) -> struct(s.sum + x as sum, greatest(s.most, x) as most, s.n + if(x > 0, 1L, 0L) as n))")
    own = pairs.withColumns({"_d": F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("long")), "_zero": start}).withColumn("_t", d)
    n = F.size("_d").cast("long")
    out = own.select(*keys, (F.col("_t.sum") / n).alias("mean_diff"), F.col("_t.most").alias("max_diff"), F.col("_t.n").alias("n_diff"), n.alias("n"))
    return out.withColumn("tolerated", (F.col("n_diff") <= TOLERATED) & (F.col("n_diff") * 1000000 <= F.col("n") * PER_MILLION))


def bench_totals(timings: DataFrame, file: str, op: str, value: str) -> DataFrame:
    """Best time of each operation, summed by file; failed rows (null) don't count."""
    best = timings.where(F.col(value).isNotNull()).groupBy(file, op).agg(F.min(value).alias("best"))
    return best.groupBy(file).agg(F.sum("best").alias("total_ms"), F.count("*").alias("ops"))


def slowest(compared: DataFrame, n: int = 10) -> DataFrame:
    """The rows that lost most, by difference, then by share; a top-n report."""
    return compared.orderBy(F.desc("diff_ms"), F.desc(F.col("diff_ms") / F.col("before_ms"))).limit(n)


# --- recurrences ------------------------------------------------------------------------------------


def number_pages(components: DataFrame, keys: list[str], order: str) -> DataFrame:
    return components.withColumn("page_no", (F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1).cast("int"))


def runs_of_flags(samples: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """Runs of equal neighbours where the flag holds: start and end (half open) by rank within the key."""
    w = W.partitionBy(*keys).orderBy(order)
    ranked = samples.withColumns({"pos": F.row_number().over(w) - 1, "ink": flag})
    edge = ranked.withColumn("edge", F.coalesce((F.col("ink") != F.lag("ink").over(w)).cast("int"), F.lit(0)))
    isle = edge.withColumn("run", F.sum("edge").over(w)).where("ink")
    return isle.groupBy(*keys, "run").agg(F.min("pos").cast("long").alias("x0"), (F.max("pos") + 1).cast("long").alias("x1")).drop("run")


def median_baseline(marks: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Median of the last three values; the first value stands for those before it."""
    w = W.partitionBy(*keys).orderBy(order)
    first = F.first(value).over(w)
    a, b, c = F.col(value), F.coalesce(F.lag(value, 1).over(w), first), F.coalesce(F.lag(value, 2).over(w), first)
    return marks.withColumn("baseline", a + b + c - F.least(a, b, c) - F.greatest(a, b, c))


def lift_step(samples: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The first inverse wavelet step: even samples lose a prediction from odd neighbours, zero beyond the edges."""
    w = W.partitionBy(*keys).orderBy(order)
    at = lambda k: F.coalesce((F.lag(value, k) if k > 0 else F.lead(value, -k)).over(w), F.lit(0))
    near, far = at(1) + at(-1), at(3) + at(-3)
    lifted = F.col(value) - F.shiftright(near * 9 - far + 16, 5)
    return samples.withColumn("pos", F.row_number().over(w) - 1).withColumn("lifted", F.when(F.col("pos") % 2 == 0, lifted).otherwise(F.col(value)))


def interpolate_step(samples: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The second inverse wavelet step: odd samples gain a prediction from even neighbours, of four inside and of two at the edges."""
    w = W.partitionBy(*keys).orderBy(order)
    at = lambda k: (F.lag(value, k) if k > 0 else F.lead(value, -k)).over(w)
    smooth = F.shiftright((at(1) + at(-1)) * 9 - at(3) - at(-3) + 8, 4)
    edge = F.shiftright(at(1) + F.coalesce(at(-1), at(1)) + 1, 1)
    odd = (F.row_number().over(w) - 1) % 2 == 1
    return samples.withColumn("restored", F.when(odd, F.col(value) + F.coalesce(smooth, edge)).otherwise(F.col(value)))


def blend_fold(paints: DataFrame, keys: list[str], order: str, colour: str, alpha: str, ground: int = 255) -> DataFrame:
    """Paint layers over a ground, one after the other: (d (255 - a) + c a + 127) div 255."""
    layers = F.array_sort(F.collect_list(F.struct(order, colour, alpha)))
    step = lambda d, x: F.floor((d * (255 - x[alpha]) + x[colour] * x[alpha] + 127) / 255).cast("long")
    return paints.groupBy(*keys).agg(layers.alias("_layers")).select(*keys, F.aggregate("_layers", F.lit(ground).cast("long"), step).alias("painted"))


# --- formulas ---------------------------------------------------------------------------------------


def gamma_column(i: Column, gamma: Column) -> Column:
    power = F.greatest(F.lit(0.1), F.least(F.lit(10.0), 2.2 / gamma))
    value = F.floor(255 * F.pow(i / 255, 1 / power) + 0.5).cast("long")
    return F.when((power > 0.999) & (power < 1.001) | i.isin(0, 255), i.cast("long")).otherwise(F.greatest(F.lit(0), F.least(F.lit(255), value)))


def rgb_columns(y: Column, cb: Column, cr: Column) -> dict[str, Column]:
    light, red = y + 128 - F.shiftright(cb, 2), cr + F.shiftright(cr, 1)
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), c)).cast("long")
    return {"r": clamp(y + 128 + red), "g": clamp(light - F.shiftright(red, 1)), "b": clamp(light + cb * 2)}


def scale_coordinate(x: Column, limit: Column, source: Column, target: Column) -> Column:
    """Source place, in sixteenths, of target sample x (closed form of the running remainder)."""
    step = source * 16
    quotient = lambda a, b: F.floor(a / b).cast("long")
    first = quotient(step + target, target * 2) - 8
    return F.least(first + quotient(quotient(target, F.lit(2)) + step * x, target), (limit - 1) * 16).cast("long")


# --- text -------------------------------------------------------------------------------------------


def normalized_text(text: Column) -> Column:
    """For comparison: no carriage returns and form feeds, no blanks behind."""
    return F.regexp_replace(F.translate(text, "\r\f", ""), "[ \\t\\n]+$", "")


def verify_text(left: DataFrame, right: DataFrame, on: list[str], text: str = "text") -> DataFrame:
    """status of each pair: both empty, match or mismatch, after normalisation."""
    a, b = left.select(*on, normalized_text(F.coalesce(text, F.lit(""))).alias("a")), right.select(*on, normalized_text(F.coalesce(text, F.lit(""))).alias("b"))
    return a.join(b, on).withColumn("status", F.when((F.col("a") == "") & (F.col("b") == ""), "both empty").when(F.col("a") == F.col("b"), "match").otherwise("mismatch")).drop("a", "b")


def pretty_zones(zones: DataFrame) -> DataFrame:
    """line: a zone's kind and box, its text if it is a word, indented by depth."""
    kind = F.coalesce(F.when(F.col("type_name") == "column", "col").otherwise(F.col("type_name")), F.lit("?"))
    word = F.when((F.col("type_name") == "word") & (F.length("text") > 0), F.concat(F.lit(' "'), F.col("text"), F.lit('"'))).otherwise("")
    return zones.withColumn("line", F.concat(F.repeat(F.lit("  "), F.col("depth")), kind, F.format_string(" [%d,%d %dx%d]", "x", "y", "w", "h"), word))


def pretty_outline(nodes: DataFrame) -> DataFrame:
    """line: a bookmark's title, url and page (-1: none), indented by depth."""
    return nodes.withColumn("line", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.coalesce("title", F.lit("")), F.lit(" -> "), F.coalesce("url", F.lit("")), F.format_string(" (page %d)", F.coalesce("page_no", F.lit(-1)))))


def pretty_info(pages: DataFrame) -> DataFrame:
    """line: a page's number, geometry, id and title."""
    geometry = F.when(F.col("width").isNull(), "<no info>").otherwise(F.format_string("%dx%d dpi=%d ver=%d rot=%d", "width", "height", "dpi", "version", "rotation"))
    name = lambda c: F.coalesce(c, F.lit(""))
    return pages.withColumn("line", F.concat(F.format_string("page %d: ", F.col("page_no") + 1), geometry, F.lit(" id="), name("page_id"), F.lit(" title="), name("title")))


#: Numbers of a link's shapes.
SHAPE_NUMBERS = {"rect": 0, "oval": 1, "text": 2}


def pretty_links(links: DataFrame) -> DataFrame:
    """line: a link's number, box, shape, url and comment."""
    shape = F.coalesce(*[F.when(F.col("shape") == k, n) for k, n in SHAPE_NUMBERS.items()])
    note = F.when(F.length(F.coalesce("comment", F.lit(""))) > 0, F.concat(F.lit(" ; "), "comment")).otherwise("")
    return links.withColumn("line", F.concat(F.format_string("link %d: [%d,%d %dx%d] shape=%d -> ", "ordinal", "x", "y", "w", "h", shape), "url", note))


def parse_timings(lines: DataFrame, line: str = "line") -> DataFrame:
    """Rows of a timing log: `pN before after` and `layer pN name value ...`; ERROR is null; other lines go."""
    pattern = r"^\s*(layer\s+)?p(\d+)\s+(\S+)\s+(\S+)"
    part = lambda k: F.regexp_extract(line, pattern, k)
    number = lambda c: F.expr(f"try_cast(nullif({c}, 'ERROR') as double)")
    rows = lines.where(F.col(line).rlike(pattern)).withColumns({"is_layer": part(1) != "", "page": part(2).cast("int"), "_a": part(3), "_b": part(4)})
    return rows.withColumns({"before_ms": number("_a"), "after_ms": number("_b")}).drop("_a", "_b")


def parse_comparison(lines: DataFrame, keys: list[str], order: str, line: str = "line") -> DataFrame:
    """Rows page, own, other, diff, share (in percent) of the table of each log: whole rows behind its heading; other lines go."""
    pattern = r"^(\d+)\s+([\d.]+)\s+([\d.]+)\s+([+-][\d.]+)\s+([+-][\d.]+)%\s*$"
    heading = F.col(line).contains("(best of") & F.col(line).contains(" slower")
    seen = lines.withColumn("_seen", F.bool_or(heading).over(W.partitionBy(*keys).orderBy(order)))
    part = lambda k, kind: F.expr(f"try_cast(regexp_extract(`{line}`, r'{pattern}', {k}) as {kind})")
    rows = seen.where(F.col("_seen") & F.col(line).rlike(pattern)).drop("_seen")
    return rows.withColumns({"page": part(1, "int"), "own": part(2, "double"), "other": part(3, "double"), "diff": part(4, "double"), "share": part(5, "double")})


def corpus_dedupe(files: DataFrame, path: str = "path") -> DataFrame:
    """Of files with the same name, case aside, the first by path: an aggregate with partial minima, so a common name is no hot group."""
    name = F.lower(F.regexp_extract(path, "([^/]*)$", 1))
    first = files.withColumn("name", name).groupBy("name").agg(F.min_by(F.struct(*files.columns), path).alias("_first"))
    return first.select(*[F.col("_first")[c].alias(c) for c in files.columns], "name")


def sample_files(files: DataFrame, n: int, seed: int = 0, path: str = "path") -> DataFrame:
    """n files, chosen by a seeded hash of the path; a sampling operator."""
    return files.orderBy(F.xxhash64(F.lit(seed), path), path).limit(n)


def ascii_names(files: DataFrame, path: str = "path") -> DataFrame:
    """ascii_name: the file's name in plain ASCII, others as _, numbered where names collide."""
    name = F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"[^\x20-\x7e]", "_")
    rank = F.row_number().over(W.partitionBy("_name").orderBy(path))
    numbered = F.regexp_replace("_name", r"(\.[^.]*)?$", "")
    suffix = F.regexp_extract("_name", r"(\.[^.]*)$", 1)
    return files.withColumn("_name", name).withColumn("_rank", rank).withColumn("ascii_name", F.when(F.col("_rank") == 1, F.col("_name")).otherwise(F.concat(numbered, F.lit("-"), F.col("_rank").cast("string"), suffix))).drop("_name", "_rank")
