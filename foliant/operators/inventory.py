"""Corpus inventory from structure alone: which codecs, how many bytes, which features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.tables import rows
from foliant.sources import container as C

PAGE_INVENTORY = (
    "path string, page_no int, width int, height int, dpi int, rotation int, gamma double, kind string, mask_bytes long, jb2_bytes long, g4_bytes long, dict_bytes long, includes int, "
    "bg_bytes long, bg_chunks int, bg_slices int, bg_color boolean, bg_width int, bg_height int, fg44_bytes long, fgbz_bytes long, fgbz_colors int, fgbz_shape_table boolean, jpeg_bytes long, txtz_bytes long, txta_bytes long, antz_bytes long, anta_bytes long"
)


def page_inventory(files: DataFrame) -> DataFrame:
    """One row per page form, by headers only; nothing is decompressed. Kinds also count formats that the engine doesn't decode."""

    def make(path, content):
        d = C.open_document(content)
        if d.error:
            return
        forms = [c.offset for c in d.components if content[c.offset + 8 : c.offset + 12] == b"DJVU"] if d.form == "DJVM" else [d.root]
        for n, form in enumerate(forms if d.bundled or d.form != "DJVM" else ()):
            own = list(C.chunks(content, form))
            size: dict[str, int] = {}
            for c in own:
                size[c.id] = size.get(c.id, 0) + c.size
            first = {c.id: C.payload(content, c)[:16] for c in reversed(own)}
            i = C.info(first["INFO"]) if "INFO" in first else None
            back = next((b for b in C.BACKGROUNDS if b in size), None)
            head = C.wavelet_info(first[back]) if back else None
            if i is None and head:
                i = head
            layers = [C.payload(content, c) for c in own if c.id == back]
            fgbz = first.get("FGbz", b"")
            colours = int.from_bytes(fgbz[1:3], "big") if len(fgbz) >= 3 else 0
            mask, background = size.get("Sjbz", 0) + size.get("Smmr", 0) > 0, back is not None or size.get("BGjp", 0) > 0
            foreground = "FG44" in size or "FGbz" in size or size.get("FGjp", 0) > 0
            kind = "compound" if mask and (background or foreground) else "bitonal" if mask else "photo" if background else "blank" if i and i.width else "unknown"
            gamma = None if i is None else i.gamma_byte / 10 if i.gamma_byte is not None else 2.2
            yield (
                path, n, i.width if i else 0, i.height if i else 0, i.dpi if i else 0, i.rotation if i else 0, gamma, kind,
                size.get("Sjbz", 0) + size.get("Smmr", 0), size.get("Sjbz", 0), size.get("Smmr", 0), size.get("Djbz", 0), sum(c.id == "INCL" for c in own),
                size.get(back, 0) if back else 0, len(layers), sum(x[1] for x in layers if len(x) > 1), None if head is None else not first[back][2] & 0x80, head.width if head else None, head.height if head else None,
                size.get("FG44", 0), size.get("FGbz", 0), colours, "FGbz" in size and size["FGbz"] > 3 + 3 * colours, size.get("BGjp", 0) + size.get("FGjp", 0),
                size.get("TXTz", 0), size.get("TXTa", 0), size.get("ANTz", 0), size.get("ANTa", 0),
            )

    return rows(files, PAGE_INVENTORY, make)


def shared_parts(files: DataFrame) -> DataFrame:
    """Per document: shared dictionaries and annotations, thumbnails and the outline, in components and root."""

    def make(path, content):
        d = C.open_document(content)
        if d.error:
            return
        dicts = dict_bytes = notes = thumbs = 0
        for c in d.components if d.bundled else ():
            kind = content[c.offset + 8 : c.offset + 12]
            thumbs += kind == b"THUM"
            for x in C.chunks(content, c.offset) if kind == b"DJVI" else ():
                if x.id == "Djbz":
                    dicts, dict_bytes = dicts + 1, dict_bytes + x.size
                elif x.id in ("ANTa", "ANTz"):
                    notes += x.size
        yield path, d.form, d.bundled, dicts, dict_bytes, notes, thumbs, sum(c.size for c in C.chunks(content, d.root) if c.id == "NAVM")

    return rows(files, "path string, form_type string, bundled boolean, shared_dicts int, shared_dict_bytes long, shared_annot_bytes long, thumbnails int, navm_bytes long", make)


def page_features() -> Column:
    """The features that a page's inventory shows, as an array."""
    when = lambda c, name: F.when(c, F.lit(name))
    col = F.col
    names = F.array(
        F.concat(F.lit("page-"), col("kind")), when(col("jb2_bytes") > 0, "jb2"), when(col("g4_bytes") > 0, "smmr"), when(col("dict_bytes") > 0, "inline-dict"), when(col("includes") > 0, "incl"),
        F.when(col("bg_color"), "bg44-color").when(~col("bg_color"), "bg44-gray"), when(col("bg_color").isNotNull() & (col("bg_chunks") > 1), "iw44-progressive"), when(col("fg44_bytes") > 0, "fg44"),
        when(col("fgbz_bytes") > 0, "fgbz-palette"), when(col("fgbz_shape_table"), "fgbz-shapetable"), when(col("jpeg_bytes") > 0, "jpeg-layers"), when(col("txtz_bytes") > 0, "text-txtz"), when(col("txta_bytes") > 0, "text-txta"),
        when(col("antz_bytes") + col("anta_bytes") > 0, "anno"), when(col("rotation") != 0, "rotated"), when(col("gamma") != 2.2, "nonstandard-gamma"),
    )
    return F.filter(names, lambda x: x.isNotNull())


def document_features(files: DataFrame) -> DataFrame:
    """One row per document and feature, each once."""
    pages, parts = page_inventory(files), shared_parts(files)
    when = lambda c, name: F.when(c, F.lit(name))
    bundle = F.col("form_type") == "DJVM"
    kind = F.when(bundle & F.col("bundled"), "djvm-bundled").when(bundle, "djvm-indirect").when(F.col("form_type").isin("PM44", "BM44"), "standalone-iw44").otherwise("single-page")
    names = F.array(kind, when(F.col("shared_dicts") > 0, "shared-dict"), when(F.col("thumbnails") > 0, "thumbnails"), when(F.col("navm_bytes") > 0, "outline"), when(F.col("shared_annot_bytes") > 0, "shared-anno"))
    whole = parts.select("path", F.explode(F.filter(names, lambda x: x.isNotNull())).alias("feature"))
    # one parse of the pages: their features are gathered as sets, which are small, before any row is made of them
    by = pages.withColumn("_page", page_features()).groupBy("path").agg(F.array_distinct(F.flatten(F.collect_set("_page"))).alias("own"), F.count("*").alias("n"))
    own = by.select("path", F.explode(F.when(F.col("n") > 1, F.array_append("own", F.lit("multi-page"))).otherwise(F.col("own"))).alias("feature"))
    return whole.union(own)


def document_inventory(files: DataFrame) -> DataFrame:
    """One row per document: pages by kind, bytes by codec, sorted features."""
    pages = page_inventory(files)
    totals = pages.groupBy("path").agg(F.count("*").alias("pages"), *[F.count_if(F.col("kind") == k).alias(f"{k}_pages") for k in ("bitonal", "compound", "photo", "blank")], *[F.sum(c).alias(c) for c in ("mask_bytes", "dict_bytes", "bg_bytes", "fg44_bytes", "fgbz_bytes", "txtz_bytes", "txta_bytes")])
    features = document_features(files).groupBy("path").agg(F.array_sort(F.collect_set("feature")).alias("features"))
    return shared_parts(files).join(totals, "path", "left").join(features, "path", "left")


def any_page(pages: DataFrame) -> DataFrame:
    """Per file, whether any page has each thing; for a one-line summary of a corpus."""
    return pages.groupBy("path").agg(F.bool_or(F.col("has_mask")).alias("any_mask"), F.bool_or(F.col("has_bg")).alias("any_bg"), F.bool_or(F.col("has_fg44")).alias("any_fg44"), F.bool_or(F.col("has_fgbz")).alias("any_palette"), F.bool_or(F.col("rotation") != 0).alias("any_rotated"), F.max("dpi").alias("max_dpi"))


def write_tsv(table: DataFrame, path: str) -> None:
    """A tab-separated dump with a header."""
    table.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)
