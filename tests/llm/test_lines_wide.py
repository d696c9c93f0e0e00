"""Line dedup and its pipeline stage on very long texts and on columns of awkward names."""

import time

import corpus as B

import corpus_pipeline as P
from conftest import SF
from foliant.llm import lines


def test_long_texts_are_linear(spark):
    """Twice the lines, not four times the time; and the later one of two copies loses all its windows."""
    took = {}
    for n in (2_000, 30_000, 120_000):
        t = "\n".join(f"common {k % 30}" if k % 3 else f"own {k}" for k in range(n))
        docs = spark.createDataFrame([(1, t), (2, f"{t}\nlast")], "doc_id long, text string")
        began = time.perf_counter()
        assert [(r.n_lines, r.n_removed) for r in lines.line_dedup(docs).orderBy("doc_id").collect()] == [(n, 0), (n + 1, n)]
        took[n] = time.perf_counter() - began
    assert took[120_000] < 8 * took[30_000] + 2


def test_columns_of_any_name(spark):
    t = "a\nb\nc\nd"
    docs = spark.createDataFrame([(1, t, 7, "x", 9, 3), (2, t, 8, "y", 9, 3)], "doc_id long, text string, N_LINES int, `a``b.c` string, n_chars int, spans int")
    assert lines.line_dedup(docs).columns == ["doc_id", "text", "a`b.c", "n_chars", "spans", "n_lines", "n_removed"]
    out = P.dedup_lines(spark, docs, SF)
    assert out.dtypes == docs.dtypes
    assert [tuple(r) for r in out.collect()] == [(1, t, 7, "x", 7, 3)]  # the second is emptied, so it goes


def test_emptied_texts_go_and_others_stay(spark):
    docs = B.frame(spark)
    out = P.dedup_lines(spark, docs, SF)
    expected = B.kept_lines({(r[0], r[1]) for r in B.rows()})
    stays = [r for r in B.rows() if not (expected[r[0], r[1]][1] and not expected[r[0], r[1]][2].strip())]
    assert sorted(r.doc_id or -1 for r in out.collect()) == sorted(r[0] or -1 for r in stays)
