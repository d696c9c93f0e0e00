"""Schemas of all tables that decoding gives."""

from __future__ import annotations

FILES = "path string, length long, content binary"
DOCUMENTS = "path string, length long, form_type string, root_off long, bundled boolean, dirm_version int, n_components int, n_pages int, error string"
COMPONENTS = "path string, comp_no int, offset long, size long, comp_id string, title string, type int"
PAGES = "path string, page_no int, form_off long, page_id string, title string, width int, height int, version int, dpi int, rotation int, gamma double, has_mask boolean, has_bg boolean, has_fg44 boolean, has_fgbz boolean, has_dict boolean, bg_chunk string, page_type string, type_code int"
CHUNKS = "path string, page_no int, form_off long, chunk_no int, chunk_id string, offset long, size long, payload binary"
TEXT = "path string, page_no int, text string, text_bytes binary"
ZONES = "path string, page_no int, zone_id int, parent_id int, depth int, ordinal int, type int, type_name string, x int, y int, w int, h int, text string"
OUTLINE = "path string, node_id int, parent_id int, depth int, ordinal int, title string, url string, page_no int"
LINKS = "path string, page_no int, ordinal int, url string, comment string, shape string, x int, y int, w int, h int"
SHAPES = "path string, page_no int, shape_no int, parent int, w int, h int, inherited boolean, rle binary"
BLITS = "path string, page_no int, blit_no int, shape_no int, left int, bottom int"
INK_RUNS = "path string, page_no int, blit_no int, y int, x0 int, x1 int"
RECORDS = "path string, page_no int, record_type string, n int"
PALETTE = "path string, page_no int, color_no int, r int, g int, b int"
BLIT_COLORS = "path string, page_no int, blit_no int, color_no int"
LAYERS = "path string, page_no int, layer string, width int, height int, chunks int, slices int, color boolean, delay int, half boolean, error string"
RENDERS = "path string, page_no int, subsample int, width int, height int, format string, stride int, data binary, error string"
#: One page with all that its decoding needs.
UNITS = "path string, page_no int, form_off long, weight long, own binary, dictionary binary"
