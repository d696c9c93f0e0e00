"""A small corpus with every awkward row, and brute-force versions of the operators."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from functools import lru_cache

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, th string, key string, pos int, spans string, score double, n long"

_r = random.Random(11)
VOCABULARY = ["".join(_r.choice("abcdefgéüñ") for _ in range(_r.randint(2, 7))) for _ in range(400)]


def prose(n: int) -> str:
    return " ".join(_r.choice(VOCABULARY) for _ in range(n))


@lru_cache
def texts() -> dict[int | None, str | None]:
    base, passage, line = prose(160), prose(60), prose(9)
    out: dict = {}
    for i in range(12):
        out[i] = prose(_r.randint(1, 90))
    out[12], out[13], out[14] = base, base, base  # exact copies
    for i in range(15, 40):  # near copies with more and more changes
        words = base.split(" ")
        for _ in range(1 + (i - 15) // 3):
            words[_r.randrange(len(words))] = _r.choice(VOCABULARY)
        out[i] = " ".join(words)
    for i in range(40, 60):  # a passage in changing surroundings
        out[i] = f"{prose(_r.randint(0, 40))} {passage} {prose(_r.randint(0, 40))}"
    for i in range(60, 90):  # a common line
        out[i] = f"{prose(12)}\n{line}\n{prose(12)}\n{line}\n{prose(3)}"
    out[90], out[91], out[92], out[93] = None, "", " \n\t ", "Sh " * 300
    out[94] = prose(3000)  # very long for its kind
    out[95] = out[94][500:9000]
    out[96], out[97] = "one two three", "ONE two\vthree"
    out[98] = "%$# 12 34"
    out[99] = "a" * 700
    out[100] = "xa" + "a" * 300
    out[101] = "\n\n\n\n\n"
    out[102] = passage.upper()
    block = "\n".join(prose(4) for _ in range(4))
    out[103], out[104], out[105] = f"{block}\nx", f"y\n{block}\n{block}", block
    out[None] = base + " tail"
    return out


def rows(more: bool = True) -> list[tuple]:
    out = []
    for i, t in texts().items():
        out.append((i, t, "aa" if i and i % 2 else None, None, len(t or ""), 7, "x", "k", 1, "s", 0.5, None))
    if more:
        out += [out[3], out[3], out[50]]  # repeated rows
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(5)


def shingles(text: str | None, k: int = 4) -> frozenset:
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def component_of(texts: dict) -> dict:
    """Smallest id reachable by links, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    keys = sorted(sets)
    for x in range(len(keys)):
        for y in range(x):
            a, b = sets[keys[y]], sets[keys[x]]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                p, q = find(keys[x]), find(keys[y])
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


def kept_words(rows: list[tuple], window: int) -> dict:
    """(id, text) -> (words, removed, kept)."""
    count = Counter(tuple(w[k : k + window]) for _, t in rows for w in [WORD.findall(t or "")] for k in range(len(w) - window + 1))
    out = {}
    for i, t in set(rows):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out[i, t] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def kept_bytes(rows: set[tuple], length: int) -> dict:
    """(id, text) -> (bytes, removed, spans, kept); rows with id None come last."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i, t] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


def kept_lines(rows: set[tuple], n: int = 3) -> dict:
    first: dict = {}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for i, t in order:
        ls = t.split("\n") if t is not None else []
        for k in range(len(ls) - n + 1):
            first.setdefault(tuple(ls[k : k + n]), (i, t, k))
    out = {}
    for i, t in order:
        ls = t.split("\n") if t is not None else []
        gone = {k + j for k in range(len(ls) - n + 1) if "".join(ls[k : k + n]).strip(" ") and first[tuple(ls[k : k + n])] != (i, t, k) for j in range(n)}
        out[i, t] = (len(ls), len(gone), "\n".join(x for k, x in enumerate(ls) if k not in gone) if t is not None else None)
    return out


def groups(items):
    out = defaultdict(list)
    for k, v in items:
        out[k].append(v)
    return out
