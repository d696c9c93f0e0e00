"""Crowded anchors and full tables: results stay exact, no group grows with the input, and it is the matching that decides."""

import random

import corpus as B
import pytest
from pyspark.sql import functions as F

from foliant.llm import ngram_join, rindex, segments, shared, substring

LINE = "a line of some ninety-five bytes that stands in every one of the documents, always the same one!"[:95]
PASSAGE = " ".join(f"passage{k}" for k in range(32))


def texts(n: int, common: str, words: int = 14) -> list[tuple]:
    r = random.Random(5)
    side = lambda: " ".join(f"{r.choice(B.VOCABULARY)}{r.randrange(50)}" for _ in range(words))
    return [(i, f"{side()} {common} {side()}") for i in range(n)]


def settled(docs, symbols, length, anchors, all_go):
    source = segments.keyed(docs, "doc_id", "text")
    return segments.settle(source, segments.cutter(source, symbols, length, anchors), all_go)


@pytest.mark.parametrize(("common", "symbols", "length", "anchors", "all_go"), [(LINE, rindex.byte_symbols, 100, (48, 88), False), (PASSAGE, substring.word_symbols, 35, (10, 30), True)])
def test_no_group_grows_with_the_input(spark, common, symbols, length, anchors, all_go):
    """20,000 differing texts around one passage just under a window's length: no block holds more stretches than CROWD, a twentieth of the documents."""
    docs = spark.createDataFrame(texts(20_000, common), "doc_id long, text string").repartition(6)
    open_ = settled(docs, symbols, length, anchors, all_go).where("block is not null")
    largest = open_.groupBy("block").count().agg(F.max("count")).first()[0] or 0
    assert largest <= segments.CROWD


def expected_bytes(data):
    return {i: v[1] for (i, _), v in B.kept_bytes(set(data), 100).items()}


@pytest.mark.parametrize("crowd", [1000, 50])
def test_crowded_lines_are_exact(spark, monkeypatch, crowd):
    monkeypatch.setattr(segments, "CROWD", crowd)
    data = texts(2_500, LINE)
    data += [(10_000 + i, data[i][1][30:] + " tail") for i in range(200)]
    out = rindex.suffix_dedup(spark.createDataFrame(data, "doc_id long, text string").repartition(6)).collect()
    expected = expected_bytes(data)
    assert {r.doc_id: r.n_removed for r in out} == expected and sum(expected.values()) > 0


@pytest.mark.parametrize("crowd", [1000, 50])
def test_crowded_passages_are_exact(spark, monkeypatch, crowd):
    monkeypatch.setattr(segments, "CROWD", crowd)
    data = texts(2_500, PASSAGE, 9)
    data += [(10_000 + i, f"one two {data[i][1][20:]} tail") for i in range(200)]
    out = substring.substring_dedup(spark.createDataFrame(data, "doc_id long, text string").repartition(6)).collect()
    expected = {i: v[1] for (i, _), v in B.kept_words(data, 35).items()}
    assert {r.doc_id: r.n_removed for r in out} == expected and sum(expected.values()) > 0


@pytest.mark.parametrize("module", [rindex, substring])
def test_the_matching_decides(spark, monkeypatch, module):
    """Without the blocks' indexes, stretches that share windows in different surroundings would stay."""
    docs, run = B.frame(spark).cache(), module.suffix_dedup if module is rindex else module.substring_dedup
    removed = lambda: run(docs).agg(F.sum("n_removed")).first()[0]
    whole = removed()
    found = module.judged
    monkeypatch.setattr(module, "judged", lambda *a: found(*a).where("false"))
    assert removed() < whole


def test_streamed_pieces_are_not_in_the_index():
    """Match lengths tell what an earlier piece has, not what is left of the piece itself."""
    import numpy as np

    text = lambda x: np.frombuffer(x, np.uint8).astype(np.int64) + 1
    earlier = np.append(text(b"the quick brown fox"), 0)
    index = rindex.RunIndex(earlier, np.array([19]))
    later = text(b"a quick brown cat")
    match = {int(a[0]): int(m[0]) for _, a, m in index.statistics(later, np.array([0]), np.array([17]))}
    assert match[1] == 13 and match[0] == 0 and match[16] == 1 and match[14] == 1


def test_full_tables_change_nothing(spark, monkeypatch):
    """With 16 slots for all shingles every slot is taken: prefixes are longer lived, results are the same."""
    last = 1 << 40
    expected = B.component_of({(last if i is None else i): t for i, t in B.texts().items()})
    for bits, cell in ((4, 1 << 18), (4, 2000)):
        monkeypatch.setattr(shared, "LEVEL_BITS", bits)
        monkeypatch.setattr(ngram_join, "CELL", cell)
        out = ngram_join.ngram_components(B.frame(spark)).collect()
        assert {last if r.doc_id is None else r.doc_id: last if r.component_id is None else r.component_id for r in out} == expected


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", -1)
    last = 1 << 40
    expected = B.component_of({(last if i is None else i): t for i, t in B.texts().items()})
    out = ngram_join.ngram_components(B.frame(spark)).collect()
    assert {last if r.doc_id is None else r.doc_id: last if r.component_id is None else r.component_id for r in out} == expected


def test_shared_folder_must_be_set_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), type("C", (), {"get": staticmethod(lambda k, d=None: d)})()

    with pytest.raises(ValueError):
        shared.shared_folder(Session())
