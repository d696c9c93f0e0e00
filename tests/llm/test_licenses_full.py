"""The license scan against brute force, with full texts in the library."""

import random

import corpus as B
import numpy as np

from foliant.llm import licenses


def plain(text: str) -> list[str]:
    return bytes(licenses.PLAIN[np.frombuffer(text.encode(), np.uint8)]).decode("utf-8", "replace").split()


def grams(words: list[str]) -> list[tuple]:
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def brute(text: str, library: dict) -> dict[str, float]:
    """Licenses of which some template has 0.8 of its distinct shingles in a stretch of the text not much longer than itself, and the greatest such share; by trying all stretches."""
    own, found = grams(plain(text)), {}
    for name, templates in library.items():
        for t in templates:
            words = plain(t)
            if len(words) < 5:
                flat = plain(text)
                if any(flat[i : i + len(words)] == words for i in range(len(flat))):
                    found[name] = 1.0
                continue
            wanted = set(grams(words))
            size = len(words) - 4
            count: dict = {}
            for i, g in enumerate(own):
                if g in wanted:
                    count[g] = count.get(g, 0) + 1
                j = i - size - 2 * (size // 4)
                if j >= 0 and own[j] in wanted:
                    count[own[j]] -= 1
                    if not count[own[j]]:
                        del count[own[j]]
                if len(count) >= 0.8 * len(wanted):
                    found[name] = max(found.get(name, 0), len(count) / len(wanted))
    return found


def cases():
    r, library = random.Random(7), licenses.library_texts()
    out = {}
    for k in range(90):
        name = r.choice(sorted(library))
        words = r.choice(library[name]).split()
        rate = r.choice((0, 0, 0.01, 0.02, 0.1))
        words = ["other" if r.random() < rate else w for w in words]
        if k % 6 == 0:
            words = words[: len(words) // 2]
        if k % 9 == 0:
            words = words[len(words) // 10 :]
        out[k] = f"{B.prose(30)} {' '.join(words)} {B.prose(30)}"
    out[100], out[101], out[102] = B.prose(500), "", " ".join(library["GPL-2.0"][-1:] + library["Apache-2.0"][-1:])
    return out, library


def test_against_brute_force(spark):
    """Nothing else is found, and of each document with any license the fullest one is, but for the share that banding may miss near the threshold. (Others may give way to it where they overlap.)"""
    texts, library = cases()
    out = licenses.license_scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).collect()
    got = B.groups((r.doc_id, r.license) for r in out)
    expected = {i: found for i, t in texts.items() if (found := brute(t, library))}
    assert all(set(names) <= set(expected[i]) for i, names in got.items()) and len(expected) > 55
    fullest = {i: {n for n, share in found.items() if share == max(found.values())} for i, found in expected.items()}
    assert sum(fullest[i] <= set(got[i]) for i in expected) >= 0.97 * len(expected)
    assert {"GPL-2.0", "Apache-2.0"} <= set(got[102]) and all(0.8 <= r.containment <= 1 for r in out)


def test_full_texts_are_found_whole(spark):
    library = licenses.library_texts()
    data = [(k, f"{B.prose(20)}\n{library[name][-1]}\n{B.prose(20)}", name) for k, name in enumerate(sorted(licenses.FULL))]
    out = licenses.license_scan(spark.createDataFrame([r[:2] for r in data], "doc_id long, text string")).collect()
    for k, text, name in data:
        longest = max((r for r in out if r.doc_id == k), key=lambda r: r.n_words)
        assert longest.license == name and longest.containment == 1 and longest.n_words == len(plain(library[name][-1])) and longest.start_word == 20


def test_no_templates_match_nothing(spark):
    docs = spark.createDataFrame([(1, "MIT License"), (2, None)], "doc_id long, text string")
    assert licenses.license_scan(docs, {}).count() == 0
