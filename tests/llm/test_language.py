"""Language identification against naive Bayes written out plainly, and its decisions."""

import math
import unicodedata
import zlib
from collections import Counter, defaultdict

import corpus as B
import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import langid

TRAIN = {"aa": ["mama papa lala", "ala bala mala", "papa ama"], "bb": ["ritz kritz blitz", "spritz witz", "strick flick"], "cc": ["ωμεγα αλφα", "βητα δελτα αλφα"]}


def documents():
    out = [(i, t, lang) for i, (lang, t) in enumerate((lang, t * 3) for lang, ts in TRAIN.items() for t in ts * 4)]
    return out + [(1000 + k, t, None) for k, t in enumerate(["mala papa", "blitz strick!", "αλφα βητα", "Ama KRITZ lala papa", "12 34", "", None, "😀😀", "𐐷𐐷", "x", "日本", "papa 😀 blitz blitz"])]


def plain_grams(text):
    """1- to 4-grams of lowered letters, all else a blank; no gram of two blanks in front, no lone blank."""
    s = "".join((c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] == "L" else " " for c in text or "")
    for n in range(1, 5):
        for i in range(len(s) - n + 1):
            g = s[i : i + n]
            if not (g == " " if n == 1 else g[:2] == "  "):
                yield g


def test_decisions_are_the_models_own(spark):
    """Brute force with unhashed n-grams: the same posterior order wherever it is clear, over the whole table."""
    docs = documents()
    seen = [(t, lang) for i, t, lang in docs if lang and zlib.crc32(str(i).encode()) % 4 != 2]
    counts, prior = defaultdict(Counter), Counter()
    for t, lang in seen:
        prior[lang] += 1
        counts[lang].update(plain_grams(t))

    def posterior(t):
        out = {}
        for lang in counts:
            total = sum(counts[lang].values()) + 0.5 * (1 << langid.BITS)
            out[lang] = math.log((prior[lang] + 1) / (sum(prior.values()) + len(prior))) + sum(math.log((counts[lang][g] + 0.5) / total) for g in plain_grams(t))
        return sorted(out.items(), key=lambda x: -x[1])

    got = {r.doc_id: r for r in langid.language_id(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(docs)
    clear = 0
    for i, t, _ in docs:
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
        if not any(unicodedata.category(c)[0] == "L" for c in t or ""):
            assert (r.lang_pred, r.score) == ("und", 0), t
            continue
        (first, a), (_, b), *_ = posterior(t)
        if a - b > 0.5:
            clear += 1
            assert r.lang_pred == first, t
    assert clear > 30


def test_a_rare_language_wins_on_evidence():
    """A strong prior gives way to much evidence in a long text; tempering must not undo that."""
    log_p = np.full((2, (1 << langid.BITS) + 1), math.log(0.5), np.float32)
    log_p[1] += 0.1
    log_p[:, -1] = 0
    model = langid.Model(["often", "rare"], log_p, np.log([0.999, 0.001]))
    names, scores = langid.classify(model, pa.array(["ab" * 5000, "a"]))
    assert names.tolist() == ["rare", "often"] and 0.5 <= scores[0] <= 1


def test_rare_languages_are_learned(spark):
    docs = [(i, "mama papa lala", "aa") for i in range(3000)] + [(5000 + i, "ritz blitz", "bb") for i in range(4)] + [(9000, "blitz", None)]
    model = langid.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"), rows=40)
    assert model.langs == ["aa", "bb"] and model.prior[0] > model.prior[1]
    assert langid.classify(model, pa.array(["blitz"]))[0].tolist() == ["bb"]


def test_kept_rows_carry_the_prediction(spark):
    docs = spark.createDataFrame([(*r, "s") for r in documents()], "doc_id long, text string, lang string, `we``ird.name` string")
    out = langid.keep_identified(docs, langid.train(docs))
    assert out.columns == docs.columns
    rows = {r.doc_id: r.lang for r in out.collect()}
    assert rows[1000] == "aa" and rows[1002] == "cc" and not {1004, 1005, 1006, 1007} & set(rows)


@pytest.mark.parametrize("data", [[], [(1, "abc", None)]])
def test_nothing_to_learn(spark, data):
    out = langid.language_id(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()
    assert [r.lang_pred for r in out] == ["und"] * len(data)


def test_awkward_rows(spark):
    out = langid.language_id(B.frame(spark)).collect()
    assert len(out) == len(B.rows()) and {r.lang_pred for r in out if not any(c.isalpha() for c in B.texts()[r.doc_id] or "")} == {"und"}
