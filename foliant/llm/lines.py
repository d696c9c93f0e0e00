"""Line dedup over overlapping three-line windows, in DataFrame operations only.

Each three consecutive lines of a document are hashed (two 64-bit lanes). Windows that occur more
than once in the corpus are found by one aggregate with partial sums; all but the first
occurrence (least id, then position) go, and the covered positions are merged to line spans.

Defined results: null text has no lines and stays null; "" is one empty line. Documents under
three lines keep all. Windows of three blank lines are never duplicates. Rows equal in id and
text count as one document. Rows equal in id alone rank by a hash of their text; a null id ranks
last. Extra columns are kept, whatever their names; ones named n_lines or n_removed, in any case
of letters, are replaced. Time and memory grow in proportion to a text, also a very long one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, LAST_ID, cut, discard, join_keyed, packed_rows

LINES = 3


def removed_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lines: int = LINES) -> tuple[DataFrame, int]:
    """_id, _th, spans (sorted disjoint structs of first line and end line), cut; and their weight in rows."""
    split = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("_id"), F.xxhash64(F.col(text)).alias("_th"), F.split(F.col(text), "\n").alias("ls")).where(F.size("ls") >= lines)
    of = [f"ls[i + {k}]" for k in range(lines)]
    # ls as a lambda's variable: split once a text
    windows = split.select("_id", "_th", F.expr(f"inline(flatten(transform(array(ls), ls -> transform(sequence(0, size(ls) - {lines}), i -> named_struct('pos', i, 'k1', xxhash64({', '.join(of)}), 'k2', xxhash64(7, {', '.join(reversed(of))}), 'ink', length(trim(concat({', '.join(of)}))) > 0)))))")).where("ink").drop("ink")
    first = cut(windows.groupBy("k1", "k2").agg(F.min(F.struct("_id", "_th", "pos")).alias("first"), F.max(F.struct("_id", "_th", "pos")).alias("last")).where("first <> last").select("k1", "k2", "first"))
    later = join_keyed(windows, first, ["k1", "k2"], "inner").where("struct(_id, _th, pos) <> first")
    # covered positions that touch make one span: a span begins where the last position is too far back
    own = Window.partitionBy("_id", "_th").orderBy("pos")
    begun = later.select("_id", "_th", "pos", (F.col("pos") > F.lag("pos").over(own) + lines).alias("new"))
    island = begun.select("_id", "_th", "pos", F.count_if("new").over(own).alias("island"))
    each = island.groupBy("_id", "_th", "island").agg(F.min("pos").alias("a"), (F.max("pos") + lines).alias("b"))
    spans = cut(each.groupBy("_id", "_th").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans")))
    discard(first)
    weigh = spans.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("n"), F.count("*").alias("k")).first()
    return spans, weigh.n + weigh.k


def deduped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lines: int = LINES) -> DataFrame:
    """r (the whole input row), kept (its text without later occurrences), n_lines, n_removed. Work is in proportion to the text: kept stretches are slices between spans."""
    spans, weight = removed_spans(docs, doc_id, text, lines)
    joined = join_keyed(packed_rows(docs, doc_id, text), spans, ["_id", "_th"], "left", rows=weight if weight <= BROADCAST_ROWS else BROADCAST_ROWS + 1)
    split = joined.select("r", "spans", F.col("r")[text].alias("t"), F.split(F.col("r")[text], "\n").alias("ls"))
    between = "transform(sequence(0, size(spans)), k -> slice(ls, if(k = 0, 0, spans[k - 1].b) + 1, if(k = size(spans), size(ls), spans[k].a) - if(k = 0, 0, spans[k - 1].b)))"
    kept = F.expr(f"if(spans is null, t, array_join(flatten(transform(array(ls), ls -> flatten({between}))), '\n'))")
    gone = F.coalesce(F.aggregate("spans", F.lit(0), lambda n, s: n + s.b - s.a), F.lit(0))
    return split.select("r", kept.alias("kept"), F.coalesce(F.size("ls"), F.lit(0)).cast("long").alias("n_lines"), gone.cast("long").alias("n_removed"))


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lines: int = LINES) -> DataFrame:
    """The input's rows and columns with the kept text, and n_lines, n_removed."""
    added = ("n_lines", "n_removed")
    return deduped(docs, doc_id, text, lines).select(*[(F.col("kept") if c == text else F.col("r")[c]).alias(c) for c in docs.columns if c.lower() not in added], *added)


#: The same rows in DuckDB's SQL: doc_id, n_lines, n_removed, kept_md5.
SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d),
w AS (SELECT doc_id, i, ls[i] AS a, ls[i + 1] AS b, ls[i + 2] AS c FROM l WHERE i + 2 <= len(ls)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS n FROM w WHERE length(trim(a || b || c)) > 0),
g AS (SELECT DISTINCT doc_id, i + k AS i FROM r, (VALUES (0), (1), (2)) t(k) WHERE n > 1),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(l.ls[l.i], chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS kept
      FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed, md5(k.kept) AS kept_md5 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
