"""The pipeline, stage by stage, and the registered queries."""

import corpus as B
from conftest import SF
from compare import connect, differences

import corpus_pipeline as P
from foliant.llm import queries
from foliant.llm.shared import components


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        before = docs
        docs = P.cut(stage(spark, docs, SF))
        assert docs.columns == names and docs.dtypes == before.dtypes and 0.8 * before.count() < docs.count() <= before.count()
        assert docs.select("doc_id").distinct().count() == docs.count(), k
    whole = P.run(spark, SF)
    tokens = whole.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r.doc_id for r in tokens} == {r.doc_id for r in docs.collect()} and all(r[1] == r[2] for r in tokens)


def test_stages_on_awkward_rows(spark):
    docs = B.frame(spark)
    for _, stage in P.STAGES[:-1]:
        docs = P.cut(stage(spark, docs, SF))
        assert docs.columns == B.frame(spark, []).columns
    assert docs.count() > 50
    empty = B.frame(spark, [])
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_near_duplicates_from_four_fifths(spark):
    """Five-word similarity 0.83 is near, 0.79 isn't."""
    docs = []
    for i, n in ((0, 90), (2, 113)):
        words = B.prose(1000).split(" ")
        other = [*words[:400], *(f"{w}{k}" for k, w in enumerate(words[400 : 400 + n])), *words[400 + n :]]
        docs += [(i, " ".join(words)), (i + 1, " ".join(other))]
    kept = P.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"), SF)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]


def test_queries(spark):
    con = connect(SF)
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 11))
    for name, sql in queries.ORACLE_SQL.items():
        assert differences(spark, con, queries.QUERIES[name], sql, SF) is None
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_toxicity", "op3_substring_dedup", "op5_language_id", "op7_suffix_dedup", "op9_media", "op10_ngram_join"):
        assert queries.QUERIES[name](spark, SF).count() == n


def test_benchmark_passages_are_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    verbatim = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op6_decontamination"](spark, SF).collect()}
    assert verbatim and verbatim <= got and len(got - verbatim) <= 1


def test_components(spark):
    edges = [(k, k + 1) for k in range(20)] + [(30, 31), (33, 31), (40, 40)]
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {k: 0 for k in range(21)} | {30: 30, 31: 30, 33: 30}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
