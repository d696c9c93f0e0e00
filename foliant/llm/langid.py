"""Language identification: multinomial naive Bayes over hashed character n-grams.

Priors count all labelled rows. N-grams are counted in a bounded sample of them, chosen by hash in
equal shares of the languages (of the LANGUAGES most frequent ones), with one distributed
aggregate. The log-probability matrix (languages x buckets) has a fixed size, is broadcast, and
whole texts are scored in numpy batches by sparse gathers: only the buckets that a text hits
are read.

The prediction is the greatest posterior; the score is that posterior with all its evidence, prior
included, tempered to 64 n-grams, as n-grams of one text depend on each other.

Defined results: a null text and a text without a letter (of any plane) give `und` and score 0. A null id is
never trained on and is not held out. With no labelled row at all every text is `und`. Among
equal scores the language first in byte order wins. Repeated rows get equal rows. Extra columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import batch, lean

#: Labelled rows that training may read, in expectation, in equal shares of the languages; and languages that it may learn (documented bounds of the operator).
TRAIN_ROWS, LANGUAGES = 20_000, 256
#: Score under which a filter takes a text's language for unknown.
LEAST = 0.5
BITS = 15
ORDERS = (1, 2, 3, 4)
SPACE = 32

#: The fold rule of the evaluation; remainder 2 is held out.
FOLDS, HELD = 4, 2


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


_table: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Lower-case letter for each code point of all planes, a space for all that is no letter."""
    if not _table:
        every = [c for c in range(0x110000) if chr(c).isalpha()]
        t = np.full(0x110000, SPACE, np.uint32)
        t[every] = [ord(low) if len(low := chr(c).lower()) == 1 else c for c in every]
        _table.append(t)
    return _table[0]


def points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points, letters lowered and all else a space, and the rows' offsets in them."""
    code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=starts[1:])
    if starts[-1] != len(code):  # malformed bytes were replaced
        parts = [np.frombuffer(data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        code, at = np.concatenate([*parts, np.zeros(0, np.uint32)]), np.cumsum([0, *map(len, parts)])
    else:
        at = starts[offsets]
    return letters()[code], at


def buckets(code: np.ndarray, at: np.ndarray):
    """For each order: bucket of each n-gram, and the n-grams' offsets; n-grams that start with a space after a space or end a row are left out by weight."""
    row_end = np.repeat(at[1:], np.diff(at))
    where = np.arange(len(code))
    h = np.zeros(len(code), np.uint32)
    blank = code == SPACE
    for n in range(1, max(ORDERS) + 1):
        m = len(code) - n + 1
        if m <= 0:
            return
        h = h[:m] * np.uint32(0x01000193) ^ code[n - 1 : n - 1 + m].astype(np.uint32)
        if n in ORDERS:
            x = (h ^ np.uint32(n * 0x9E37)) * np.uint32(0x85EBCA6B)
            ok = where[:m] + n <= row_end[:m]
            if n > 1:
                ok &= ~(blank[:m] & blank[1 : 1 + m])
            else:
                ok &= ~blank[:m]
            yield n, (x ^ (x >> np.uint32(15))) >> np.uint32(32 - BITS), ok


@dataclass
class Model:
    langs: list[str]
    log_p: np.ndarray  # (languages, buckets + 1); the last bucket weighs nothing
    prior: np.ndarray


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", rows: int = TRAIN_ROWS) -> Model:
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (fold(doc_id) != HELD)).select(F.col(doc_id).cast("string").alias("i"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    # the most frequent values, counted over all rows; each has its share of the bounded sample, so a rare one is wholly in it
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return Model([], np.zeros((0, (1 << BITS) + 1), np.float32), np.zeros(0))
    rates = known.sparkSession.createDataFrame([(r.lang, int(min(1.0, rows / len(sizes) / r.n) * (1 << 20))) for r in sizes], "lang string, rate long")
    sample = known.join(F.broadcast(rates), "lang").where(F.pmod(F.xxhash64("i", F.lit(5)), F.lit(1 << 20)) < F.col("rate")).select("text", "lang")
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            names = b.column("lang").to_pylist()
            for i, j, data, offsets in K.chunks(b.column("text")):
                code, at = points(data, offsets)
                who = {x: k for k, x in enumerate(dict.fromkeys(names[i:j]))}
                lane = np.repeat(np.array([who[x] for x in names[i:j]], np.int64), np.diff(at))
                for _, h, ok in buckets(code, at):
                    both = np.bincount((lane[: len(h)][ok] << BITS) | h[ok], minlength=len(who) << BITS)
                    for x, k in who.items():
                        total[x] = total.get(x, 0) + both[k << BITS : (k + 1) << BITS]
        for x, v in total.items():
            some = np.flatnonzero(v)
            yield batch(schema, [x] * len(some), some.astype(np.int32), v[some])

    # at most LANGUAGES x 2**BITS numbers, of fixed size whatever the input
    pdf = sample.mapInArrow(lean(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    sizes = sorted(sizes)
    langs, prior = [r.lang for r in sizes], np.array([r.n + 1.0 for r in sizes])
    counts = np.zeros((len(langs), 1 << BITS))
    for k, x in enumerate(langs):
        own = pdf[pdf.lang == x]
        counts[k, own.bucket.to_numpy()] = own.n.to_numpy()
    log_p = np.log(counts + 0.5) - np.log((counts + 0.5).sum(1, keepdims=True))
    return Model(langs, np.hstack([log_p, np.zeros((len(langs), 1))]).astype(np.float32), np.log(prior / prior.sum()))


def classify(m: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """lang_pred and score of each text of a column."""
    names, scores = np.full(len(column), "und", object), np.zeros(len(column))
    for i, j, data, offsets in K.chunks(column):
        code, at = points(data, offsets)
        total, grams = np.zeros((len(m.langs), j - i)), np.zeros(j - i)
        full = np.diff(at) > 0
        if not full.any() or not m.langs:
            continue
        heads = at[:-1][full]
        lit = np.zeros(j - i, bool)
        lit[full] = np.maximum.reduceat(code != SPACE, heads)
        for _, h, ok in buckets(code, at):
            h = np.where(ok, h, np.uint32(1 << BITS))
            cuts = heads[heads < len(h)]
            own = np.flatnonzero(full)[: len(cuts)]
            grams[own] += np.add.reduceat(ok.astype(np.int64), cuts)
            for k in range(len(m.langs)):
                total[k, own] += np.add.reduceat(m.log_p[k][h], cuts, dtype=np.float64)
        z = m.prior[:, None] + total
        best = z.argmax(0)  # the model's own decision
        z = (z - z.max(0)) * np.minimum(1, 64 / np.maximum(grams, 1))  # the score alone is tempered
        p = np.exp(z) / np.exp(z).sum(0)
        rows = np.flatnonzero(lit)
        names[i + rows] = np.array(m.langs, object)[best[rows]]
        scores[i + rows] = p[best[rows], rows]
    return names, scores


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: its id, lang_pred and score (the posterior, tempered to 64 n-grams)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def score(batches):
        for b in batches:
            yield batch(schema, b.column("doc_id"), *classify(shared.value, b.column("text")))

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(score), "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang", least: float = LEAST) -> DataFrame:
    """The rows, all their columns, whose language is identified with a score of `least` or more; `lang` takes the prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, into = docs.columns.index(text), docs.columns.index(lang)

    def keep(batches):
        for b in batches:
            names, scores = classify(shared.value, b.column(at))
            own = b.set_column(into, b.schema.field(into), pa.array(names, b.schema.field(into).type))
            yield own.filter(pa.array((names != "und") & (scores >= least)))

    # columns go by place, whatever their names are
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(lean(keep), plain.schema).toDF(*docs.columns)


def language_id(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of a documents table."""
    out = identify(docs, model or train(docs))
    return out.select("doc_id", F.coalesce(fold() == HELD, F.lit(False)).alias("held_out"), "lang_pred", "score")
