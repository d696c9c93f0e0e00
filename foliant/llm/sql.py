"""The same rows as five of the queries in DuckDB's SQL, by plain comparison of all windows or pairs."""

from __future__ import annotations

from . import decontaminate as D
from . import lines

SUBSTRING = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
w AS (SELECT doc_id, i, word, string_agg(word, ' ') OVER v AS k, count(*) OVER v AS c FROM l WINDOW v AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
r AS (SELECT k FROM w WHERE c = 35 GROUP BY k HAVING count(*) > 1),
h AS (SELECT w.doc_id, i, word, r.k IS NOT NULL AND c = 35 AS hit FROM w LEFT JOIN r ON r.k = w.k),
g AS (SELECT doc_id, i, word, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM h),
k AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

NGRAM_JOIN = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM d),
w AS (SELECT doc_id, i, n, string_agg(word, ' ') OVER v AS k, count(*) OVER v AS c FROM l WINDOW v AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
s AS (SELECT DISTINCT doc_id, k FROM w WHERE c = 4 OR (n < 4 AND i = 1)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN z y ON y.doc_id = a JOIN z o ON o.doc_id = b WHERE 100 * x >= 85 * (y.n + o.n - x)),
t AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT c.a, t.b FROM c JOIN t ON t.a = c.b),
m AS (SELECT a, min(b) AS b FROM c GROUP BY a)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, m.b AS component_id FROM d JOIN m ON m.a = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id
"""


def _words(table: str, key: str) -> str:
    """(key, i, word, template) rows of a table's texts, typed as the operator types them."""
    marked = f"lower(regexp_replace(coalesce(text, ''), '{D.NAME}', '\\1' || chr(1) || '\\2', 'g'))"
    split = f"list_filter(string_split_regex(regexp_replace({marked}, '{D.UNIT}', '\\1 ' || chr(2) || '\\2', 'g'), '{D.GAP}'), lambda x: x <> '')"
    return f"""(SELECT {key}, i, word, CASE WHEN ascii(word) BETWEEN 48 AND 57 THEN '<number>' WHEN ascii(word) = 1 THEN '<name>' WHEN ascii(word) = 2 THEN '<unit>' ELSE word END AS template
    FROM (SELECT {key}, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT {key}, {split} AS ws FROM {table})))"""


def _windows(words: str, key: str) -> str:
    v = f"OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN CURRENT ROW AND {D.WORDS - 1} FOLLOWING)"
    return f"SELECT {key}, i, string_agg(template, ' ') {v} AS k, list(word) {v} AS ws, count(*) {v} AS c, count(*) FILTER (template NOT IN ('<number>', '<name>', '<unit>')) {v} AS plain FROM {words}"


DECONTAMINATION = f"""
WITH b AS ({_windows(_words("(SELECT DISTINCT item_id, text FROM benchmark)", "item_id"), "item_id")}),
q AS (SELECT *, plain >= {D.LITERALS} AS ok FROM b WHERE c = {D.WORDS}),
iw AS (SELECT item_id, i, k, ws FROM (SELECT *, bool_or(ok) OVER (PARTITION BY item_id) AS any_ok FROM q) WHERE ok OR NOT any_ok),
n AS (SELECT item_id, count(DISTINCT k) AS total FROM iw GROUP BY item_id),
dw AS (SELECT doc_id, i, k, ws FROM ({_windows(_words("documents", "doc_id"), "doc_id")}) WHERE c = {D.WORDS} AND k IN (SELECT k FROM iw)),
j AS (SELECT doc_id, iw.item_id, iw.k, iw.i AS pos, dw.i AS dp, iw.ws AS a, dw.ws AS b FROM dw JOIN iw ON iw.k = dw.k),
m AS (SELECT j.*, total, dp - pos AS shift FROM j JOIN n ON n.item_id = j.item_id JOIN (SELECT doc_id, j.item_id FROM j JOIN n ON n.item_id = j.item_id GROUP BY 1, 2 HAVING count(DISTINCT k) >= {D.CONTAINMENT} * max(total)) y ON y.doc_id = j.doc_id AND y.item_id = j.item_id),
s AS (SELECT doc_id, item_id, shift, k, pos, unnest(a) AS x, unnest(b) AS y FROM m),
t AS (SELECT * FROM s WHERE ascii(x) BETWEEN 48 AND 57 OR ascii(x) IN (1, 2)),
o AS (SELECT doc_id, item_id, shift, x FROM t GROUP BY ALL HAVING count(DISTINCT y) > 1),
u AS (SELECT doc_id, item_id, shift, y FROM t GROUP BY ALL HAVING count(DISTINCT x) > 1),
bad AS (SELECT doc_id, item_id, shift, pos FROM t SEMI JOIN o USING (doc_id, item_id, shift, x) UNION SELECT doc_id, item_id, shift, pos FROM t SEMI JOIN u USING (doc_id, item_id, shift, y))
SELECT doc_id, item_id, max(total)::BIGINT AS item_windows, count(DISTINCT k)::BIGINT AS matched, bool_and(a = b) AS exact FROM m ANTI JOIN bad USING (doc_id, item_id, shift, pos)
GROUP BY doc_id, item_id HAVING count(DISTINCT k) >= {D.CONTAINMENT} * max(total)
"""

SUFFIX = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, j, substr(h, 2 * j + 1, 2) AS byte, CASE WHEN 2 * j + {2 * 100} <= length(h) THEN md5_number(substr(h, 2 * j + 1, {2 * 100})) END AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS j FROM d)),
f AS (SELECT k, min(doc_id::HUGEINT * 4294967296 + j) AS place FROM b WHERE k IS NOT NULL GROUP BY k),
l AS (SELECT doc_id, j, byte, coalesce(f.place < doc_id::HUGEINT * 4294967296 + j, false) AS late FROM b LEFT JOIN f ON f.k = b.k),
g AS (SELECT doc_id, j, byte, bool_or(late) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM l),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY j), false) AS head FROM g),
t AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS removed, count(*) FILTER (head) AS spans, string_agg(byte, '' ORDER BY j) FILTER (NOT gone) AS kept FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN t ON t.doc_id = d.doc_id
"""

ORACLE_SQL = {"op7_suffix_dedup": SUFFIX, "op3_substring_dedup": SUBSTRING, "op4_line_dedup": lines.SQL, "op6_decontamination": DECONTAMINATION, "op10_ngram_join": NGRAM_JOIN}
