"""The pipeline and the toxicity scores against plain versions of every step, over whole tables."""

import math
import re

import corpus as B
import numpy as np
import pytest
from conftest import SF

import corpus_pipeline as P
from foliant.llm import langid, queries, toxicity

ITEM = "Tom has 5 apples and Ann gives Tom 3 more apples each day for 2 weeks so how many apples does Tom have in the end of it all"


def five_word_groups(texts: dict) -> dict:
    sets = {i: B.shingles(t, 5) for i, t in texts.items()}
    group = {i: i for i in sets}

    def find(a):
        while group[a] != a:
            a = group[a]
        return a

    for x in sorted(sets):
        for y in sorted(sets):
            if y < x and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                p, q = find(x), find(y)
                group[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


def test_pipeline_by_brute_force(spark, tmp_path):
    """Which documents stay, and the ids of what is left of each, in order."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [(*r[:5],) for r in B.rows(more=False) if r[0] is not None]
    rows += [(200, f"Some words in front. {ITEM} And more words behind it.", "aa", "s", 0), (201, B.texts()[103] + "\n" + B.texts()[104], None, "s", 0)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, "an item that stands nowhere at all in these texts")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    stay = {r[0]: r[1] for r in rows if any(c.isalpha() for c in r[1] or "")}
    lines = {i: kept for (i, _), (_, removed, kept) in B.kept_lines(set(stay.items())).items() if not removed or kept.strip("\n\t\r ")}
    first = {i: t for i, t in lines.items() if five_word_groups(lines)[i] == i}
    clean = {i: t for i, t in first.items() if ITEM not in t}
    assert len(rows) > len(stay) > len(lines) > len(first) > len(clean) == len(first) - 1

    pieces = B.groups((r.doc_id, r) for r in P.run(spark, folder).collect())
    assert set(pieces) == set(clean)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, own in pieces.items():
        own.sort(key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in own]).tolist()
        assert ids == [*tokenizer.encode(clean[i], add_special_tokens=False).ids, 1], i
    sequences = B.groups((r.sequence_id, (r.offset, r.length)) for own in pieces.values() for r in own)
    for own in sequences.values():
        assert [a for a, _ in sorted(own)] == np.cumsum([0, *(n for _, n in sorted(own))])[:-1].tolist() and sum(n for _, n in own) <= 2048


def plain_words(text: str) -> list[str]:
    """Lowered words: letters a to z, and all beyond ASCII."""
    low = "".join(c.lower() if "A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" else c for c in text)
    return re.findall(r"[a-z\x80-\U0010ffff]+", low)


def plain_patterns(text: str) -> list[bool]:
    words, n = B.WORD.findall(text), len(text.encode())
    k = max(len(words), 1)
    up, low = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text)
    return [up > low, text.count("!") > k / 4, sum(c in "#$%&*@^~" for c in text) > k, sum(a == b for a, b in zip(words, words[1:], strict=False)) * 5 > k, text.count("|") > k / 4, n > 14 * k, sum(c.isascii() and c.isdigit() for c in text) * 10 > max(n, 1)]


@pytest.mark.parametrize("awkward", [False, True])
def test_scores_by_brute_force(spark, awkward):
    """Each document's voters word by word, and the linear score of them."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    if awkward:
        docs = B.frame(spark)
    place = {int(b): k for k, b in enumerate(model.voters)}
    buckets: dict[str, list[int]] = {}

    def of(word):
        if word not in buckets:
            data = np.frombuffer(word.encode(), np.uint8)
            buckets[word] = [int(x) for _, found in toxicity.entries(data, np.array([0, len(data)])) for x in found]
        return buckets[word]

    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels, model).collect()}
    for r in docs.collect():
        text = r.text or ""
        fired = {place[b] for w in plain_words(text) for b in of(w) if b in place}
        patterns = [k + len(model.voters) for k, yes in enumerate(plain_patterns(text)) if yes and text]
        z = sum(model.weights[k] for k in [*fired, *patterns]) + model.bias
        own = got[r.doc_id]
        assert own.score == pytest.approx(1 / (1 + math.exp(-min(max(z, -30), 30))), abs=1e-9) and own.fired == len(fired) + len(patterns), r.doc_id
        assert own.predicted == (own.score >= 0.3)


def test_language_of_the_whole_table(spark):
    """Held-out documents of the sf0.1 table, each counted: learned on the others alone."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = queries.op5_language_id(spark, "/root/testdata/sf0.1").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(out) == docs.count() and np.mean([r.lang_pred == r.lang for r in held]) > 0.99
    model = langid.train(docs.where(langid.fold() != langid.HELD))
    assert {r.lang_pred for r in out} == set(model.langs)
