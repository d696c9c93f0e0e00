"""Operators that learn: held-out accuracy, edge rows, and no use of what they must not see."""

import corpus as B
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from foliant.llm import langid, toxicity

BIG = SF.replace("0.001", "0.01")


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    out = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 150 and np.mean([r.lang_pred == r.lang for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_language_edges(spark):
    docs = B.frame(spark)
    out = langid.language_id(docs)
    by = B.groups((r.doc_id, (r.lang_pred, r.score, r.held_out)) for r in out.collect())
    assert all(by[i][0][:2] == ("und", 0.0) for i in (90, 91, 92, 98, 101))
    assert by[3] == [by[3][0]] * 3 and by[0][0][0] == "aa" and by[None][0][2] is False
    kept = langid.keep_identified(docs, langid.train(docs))
    assert kept.columns == docs.columns and kept.count() == len(B.rows()) - 5
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.language_id(unlabelled).collect()} == {"und"}
    assert langid.language_id(B.frame(spark, [])).count() == 0


def test_language_by_naive_formula(spark):
    """Scores equal a plain dictionary version of the same model."""
    model = langid.train(spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate([("abc abd", "x"), ("xyz xyy", "y")] * 30)], "doc_id long, text string, lang string"))
    data = "abd xy".encode()
    code, at = langid.points(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    total, n = np.array(model.prior), 0
    logs = np.zeros(2)
    for k, h, ok in langid.buckets(code, at):
        for j in range(len(h)):
            gram = "abd xy"[j : j + k]
            assert ok[j] == (not gram.startswith("  ") and gram != " ")
            if ok[j]:
                logs += model.log_p[:, h[j]]
                n += 1
    z = total + logs * min(1, 64 / n)
    p = np.exp(z - z.max())
    (row,) = langid.identify(spark.createDataFrame([(1, "abd xy")], "doc_id long, text string"), model).collect()
    assert row.lang_pred == model.langs[int(p.argmax())] and row.score == pytest.approx((p / p.sum()).max(), abs=1e-4)


def test_toxicity_accuracy(spark):
    big = BIG.replace("0.01", "0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    out = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    rank, n1 = out.score.rank(), out.toxic.sum()
    area = (rank[out.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(out) - n1))
    assert area > 0.98
    assert ((out.toxic == 1) & (out.predicted == 1)).sum() / n1 > 0.85 and (out[out.predicted == 1].toxic == 1).mean() > 0.9


def test_toxicity_edges(spark):
    docs = B.frame(spark)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(60)] + [(None, 1), (5, None), (5, 1)], "doc_id long, toxic int")
    marked = docs.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" what a Stupid idiot"))).otherwise(F.col("text")))
    out = B.groups((r.doc_id, (r.score, r.predicted)) for r in toxicity.toxicity(marked, labels).collect())
    assert out[3] == [out[3][0]] * 3 and out[91] == out[90] and all(0 <= s <= 1 and p == (s >= 0.3) for v in out.values() for s, p in v)
    assert out[5][0][0] > out[6][0][0] and out[10][0][1] == 1 and out[6][0][1] == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    plain = B.groups((r.doc_id, r.score) for r in toxicity.toxicity(marked, none).collect())
    assert plain[5][0] > 0.5 > plain[6][0] and toxicity.toxicity(B.frame(spark, []), labels).count() == 0


def test_label_model_recovers_rates():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.3
    v = np.stack([np.where(y, rng.random(4000) < a, rng.random(4000) < b) for a, b in ((0.7, 0.02), (0.5, 0.05), (0.6, 0.01))], 1)
    v = np.hstack([v, v[:, :1], np.zeros((4000, len(toxicity.PATTERNS)), bool)])  # the last voter copies the first
    gold = np.where(rng.random(4000) < 0.3, y.astype(int), -1)
    p, rates, shares = toxicity.label_model(v, gold)
    assert ((p > 0.5) == y).mean() > 0.9 and abs(rates[0, 1] - 0.7) < 0.1 and abs(rates[1, 0] - 0.05) < 0.05
    assert shares[0] < 0.6 and shares[1] > shares[0] + 0.1
