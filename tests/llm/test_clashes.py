"""Extra columns may be called as any that the operators use inside: results are the same, and operators that keep rows keep them."""

import corpus as B
import pytest
from pyspark.sql import functions as F

from foliant.llm import decontaminate, langid, licenses, lines, media, ngram_join, packing, rindex, substring, toxicity

NAMES = "id th item it key pos dp df total t ws hs z block segment phrase span node token head grams few many c1 c2 n k group least votes gold bucket rate media declared fired held_out lang_pred _id _th r kept ls spans island c0 c99 i u".split()
ITEM = "alpha beta gamma delta epsilon zeta eta theta"


def tables(spark):
    rows = [(r[0], r[1], r[2]) for r in B.rows()] + [(300, f"in front {ITEM} and behind", "aa")]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    return plain, plain.select("*", *[F.lit(f"x{k}").alias(n) for k, n in enumerate(NAMES)])


def bench(spark):
    return spark.createDataFrame([(1, ITEM, "q", 5)], "item_id long, text string, key string, pos int")


def pack(docs):
    import public_tokenizers

    return packing.pack(docs.coalesce(1).sortWithinPartitions("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def labels(spark):
    return spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(60)], "doc_id long, toxic int")


@pytest.mark.parametrize("name", ["toxicity", "packing", "substring", "lines", "language", "decontamination", "suffix", "licenses", "media", "ngram"])
def test_results_are_the_same(spark, name):
    run = {
        "toxicity": lambda d: toxicity.toxicity(d, labels(spark)), "packing": pack, "substring": lambda d: substring.substring_dedup(d, with_text=True), "lines": lambda d: lines.line_dedup(d).select("doc_id", "text", "n_lines", "n_removed"),
        "language": langid.language_id, "decontamination": lambda d: decontaminate.contaminated(d, bench(spark)).drop("_th"), "suffix": rindex.suffix_dedup, "licenses": licenses.license_scan, "media": media.media_columns, "ngram": ngram_join.ngram_components,
    }[name]
    a, b = ([repr(r) for r in run(d).collect()] for d in tables(spark))
    assert sorted(a) == sorted(b) and (a or name == "licenses")


@pytest.mark.parametrize("name", ["lines", "language", "decontamination", "ngram"])
def test_rows_are_kept_whole(spark, name):
    plain, wide = tables(spark)
    run = {
        "lines": lambda d: lines.line_dedup(d).drop("n_lines", "n_removed"), "language": lambda d: langid.keep_identified(d, langid.train(d)),
        "decontamination": lambda d: decontaminate.decontaminate(d, bench(spark)), "ngram": ngram_join.keep_one,
    }[name]
    out = run(wide)
    assert out.columns == wide.columns and all(out.where(F.col(n) == f"x{k}").count() == out.count() for k, n in list(enumerate(NAMES))[::9])
    assert sorted(repr(r) for r in out.select("doc_id", "text", "lang").collect()) == sorted(repr(r) for r in run(plain).collect())
