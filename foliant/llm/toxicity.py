"""Toxicity by weak supervision.

Voters are lexicon entries (whole words and word beginnings that a bounded sample of labelled
rows shows to go with the label) and surface patterns. A generative label model estimates, by
expectation maximisation, each voter's firing rates in both classes and the voters' correlations
given the class; correlated voters share their weight. The labels themselves are one more noisy
voter. A logistic classifier, linear in the votes, is trained on the model's posteriors and
scores every whole text.

Defined results: null text is empty text; an empty text gets the score of a text on which no
voter fires. Without labels, or with one class only, scores come from the fixed lexicon and
patterns at the prior PRIOR. Repeated rows get equal rows; a row's score depends on its text
alone. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .langid import HELD, fold
from .shared import batch, cut, discard, lean

#: Labelled rows that training may read, in expectation, and lexicon voters kept (documented bounds).
TRAIN_ROWS = 40_000
VOTERS = 320
BITS = 21
PREFIXES = (3, 4, 5, 6, 7)
THRESHOLD = 0.3
PRIOR = 0.1

#: Common English insults, the lexicon's seed.
SEED = ("idiot", "moron", "stupid", "scum", "trash", "loser", "clown", "worthless", "pathetic", "disgusting", "dumb", "filth", "vermin", "imbecile")
PATTERNS = ("shouting", "exclaiming", "symbols", "repeating", "table", "long words", "digits")

LETTER = np.zeros(256, bool)
LETTER[ord("a") : ord("z") + 1] = True
LETTER[0x80:] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case, in UTF-8."""
    low = K.LOWER[data]
    if len(low) > 1:
        second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        low[second] += 0x20
    return low


def entries(data: np.ndarray, offsets: np.ndarray):
    """(row, bucket) arrays of each word, then of each word beginning of PREFIXES letters."""
    low = lowered(data)
    ink = LETTER[low]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    some = np.diff(offsets) > 0
    heads, tails = offsets[:-1][some], offsets[1:][some] - 1
    first[heads], last[tails] = ink[heads], ink[tails]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, a, "right") - 1
    prefix = K.Prefix(K.SYMBOL[low])
    yield row, (K.mix(prefix.span(a, b) + K.U(77)) >> K.U(64 - BITS)).astype(np.int64)
    chars = np.append(np.flatnonzero((low & 0xC0) != 0x80), len(low))
    start, end = np.searchsorted(chars, a), np.searchsorted(chars, b)
    for n in PREFIXES:
        ok = end - start >= n
        yield row[ok], (K.mix(prefix.span(a[ok], chars[start[ok] + n]) + K.U(n)) >> K.U(64 - BITS)).astype(np.int64)


def word_bucket(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(next(entries(data, np.array([0, len(data)])))[1][0])


def pattern_votes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One column for each of PATTERNS."""
    n = np.diff(offsets)

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    upper = count((data >= 65) & (data <= 90))
    lower = count((data >= 97) & (data <= 122))
    marks = np.isin(data, np.frombuffer(b"#$%&*@^~", np.uint8))
    starts, ends, at = K.words(data, offsets)
    h = K.word_hashes(data, starts, ends)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[at[:-1][at[:-1] < len(h)]] = False
    sums = np.concatenate([[0], np.cumsum(same)])
    words = np.maximum(np.diff(at), 1)
    return np.stack([upper > lower, count(data == 33) > words / 4, count(marks) > words, (sums[at[1:]] - sums[at[:-1]]) * 5 > words, count(data == 124) > words / 4, n > 14 * words, count((data >= 48) & (data <= 57)) * 10 > np.maximum(n, 1)], 1)


@dataclass
class Model:
    voters: np.ndarray  # bucket of each lexicon voter
    weights: np.ndarray  # of lexicon voters, then patterns
    bias: float
    rates: np.ndarray  # (voters, 2): estimated firing rate given clean, given toxic
    shares: np.ndarray  # what correlation leaves of each voter's weight


def votes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((len(offsets) - 1, n + len(PATTERNS)), bool)
    for row, bucket in entries(data, offsets):
        voter = table[bucket]
        hit = voter >= 0
        out[row[hit], voter[hit]] = True
    out[:, n:] = pattern_votes(data, offsets)
    return out


def lookup(voters: np.ndarray) -> np.ndarray:
    table = np.full(1 << BITS, -1, np.int16)
    table[voters] = np.arange(len(voters))
    return table


def label_model(v: np.ndarray, gold: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the label, rates and shares, from votes and the noisy gold column (-1: none)."""
    known = gold >= 0
    p = np.where(known, np.where(gold == 1, 0.9, 0.05), np.where(v[:, : v.shape[1] - len(PATTERNS)].any(1), 0.7, 0.1))
    x = v.astype(np.float32)
    share = np.ones(v.shape[1])
    for i in range(rounds):
        total = np.array([(1 - p).sum(), p.sum()]) + 1e-9
        rates = np.stack([((1 - p) @ x + 0.1) / (total[0] + 1), (p @ x + 0.1) / (total[1] + 1)], 1)
        right = np.array([((p * (gold == 1))[known].sum() + 5) / (p[known].sum() + 6), (((1 - p) * (gold == 0))[known].sum() + 5) / ((1 - p)[known].sum() + 6)])
        if i % 8 == 0:  # correlations given the class, from residuals
            z = x - np.outer(1 - p, rates[:, 0]) - np.outer(p, rates[:, 1])
            z = (z / np.maximum(z.std(0), 1e-3)).astype(np.float32)
            rho = np.abs(z.T @ z) / len(z)
            np.fill_diagonal(rho, 0)
            share = 1 / (1 + np.where(rho > 0.15, rho, 0).sum(1))
        on = np.log(rates[:, 1] / rates[:, 0]) * share
        off = np.log((1 - rates[:, 1]) / (1 - rates[:, 0])) * share
        prior = min(max(p.mean(), 1e-3), 0.5)
        logit = np.log(prior / (1 - prior)) + x @ (on - off) + off.sum()
        logit += np.where(gold == 1, np.log(right[0] / (1 - right[1])), np.where(gold == 0, np.log((1 - right[0]) / right[1]), 0))
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return p, rates, share


def fit_linear(x: np.ndarray, p: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on soft labels, by damped Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w, keep = np.zeros(a.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-3)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (q * (1 - q) + 1e-4)[:, None]).T @ a + np.diag(keep), a.T @ (p - q) - keep * w)
        w += step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", rows: int = TRAIN_ROWS, voters: int = VOTERS) -> Model:
    known = labels.where((fold(doc_id) != HELD) & F.col(toxic).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.max(F.col(toxic).cast("int")).alias("gold"))
    n = known.count()
    share = min(1.0, rows / max(n, 1))
    # at most about TRAIN_ROWS pairs of numbers, so this side's size is bounded by the parameter
    chosen = F.broadcast(known.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20))))
    # one pass over the corpus; rows that are one document count once, however often it is repeated
    sample = cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(chosen, "doc_id").select("doc_id", "text", "gold").distinct().select("text", "gold"))
    counts = pa.schema([("bucket", pa.int32()), ("pos", pa.int64()), ("neg", pa.int64())])

    def count(batches):
        total = np.zeros((2, 1 << BITS), np.int32)
        for b in batches:
            gold = b.column("gold").to_numpy(zero_copy_only=False)
            for i, j, data, offsets in K.chunks(b.column("text")):
                if not len(data):
                    continue
                both = [(r << BITS) | h for r, h in entries(data, offsets)]
                u = np.unique(np.concatenate(both))
                h, y = u & ((1 << BITS) - 1), gold[i:j][u >> BITS] == 1
                np.add.at(total[0], h[~y], 1)
                np.add.at(total[1], h[y], 1)
        some = np.flatnonzero(total.any(0))
        yield batch(counts, some.astype(np.int32), total[1, some].astype(np.int64), total[0, some].astype(np.int64))

    size = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("gold"), F.lit(0)).alias("pos")).first()
    share_pos = (size.pos + 1) / (size.n + 2)
    by = sample.mapInArrow(lean(count), "bucket int, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # a lexicon entry must be seen in enough toxic rows and be several times as frequent there
    lift = (F.col("pos") + 0.5) / (F.col("pos") + F.col("neg") + 1.0 / max(share_pos, 1e-3)) / F.lit(share_pos)
    best = by.where("pos >= 4").withColumn("lift", lift).where("lift > 3").orderBy(F.desc(F.col("pos") * F.log("lift")), "bucket").limit(voters)
    learned = [r.bucket for r in best.select("bucket").collect()] if 0 < size.pos < size.n else []
    lexicon = np.array(list(dict.fromkeys([*map(word_bucket, SEED), *learned])), np.int64)
    if not learned:
        discard(sample)
        return Model(lexicon, np.append(np.full(len(lexicon), 3.0), np.zeros(len(PATTERNS))), float(np.log(PRIOR / (1 - PRIOR))), np.zeros((0, 2)), np.zeros(0))
    table = sample.sparkSession.sparkContext.broadcast(lexicon)
    seen = pa.schema([("votes", pa.binary()), ("gold", pa.int32())])

    def vote(batches):
        own = lookup(table.value)
        for b in batches:
            gold = b.column("gold").to_numpy(zero_copy_only=False)
            for i, j, data, offsets in K.chunks(b.column("text")):
                v = np.packbits(votes(data, offsets, own, len(table.value)), axis=1)
                yield batch(seen, [x.tobytes() for x in v], gold[i:j].astype(np.int32))

    got = sample.mapInArrow(lean(vote), "votes binary, gold int").toPandas()  # some 45 bytes for each of the bounded sample's rows
    discard(sample)
    width = len(lexicon) + len(PATTERNS)
    v = np.unpackbits(np.frombuffer(b"".join(map(bytes, got.votes)), np.uint8).reshape(len(got), -1), axis=1)[:, :width].astype(bool)
    order = np.lexsort([*np.packbits(v, axis=1).T, got.gold.to_numpy()])  # results don't depend on the order of rows
    v, gold = v[order], got.gold.to_numpy()[order]
    p, rates, shares = label_model(v, gold)
    weights, bias = fit_linear(v, p)
    return Model(lexicon, weights, bias, rates, shares)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, fired (how many voters fired) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("fired", pa.int32())])

    def run(batches):
        m = shared.value
        table = lookup(m.voters)
        for b in batches:
            s, fired = np.full(b.num_rows, 1 / (1 + np.exp(-m.bias))), np.zeros(b.num_rows, np.int32)
            for i, j, data, offsets in K.chunks(b.column("text")):
                if len(data):
                    v = votes(data, offsets, table, len(m.voters))
                    s[i:j] = 1 / (1 + np.exp(-np.clip(v @ m.weights + m.bias, -30, 30)))
                    fired[i:j] = v.sum(1)
            yield batch(out, b.column("doc_id").cast(pa.int64()), s, fired)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), "doc_id long, score double, fired int")


def toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted and fired of every row of a documents table."""
    out = score(docs, model or train(docs, labels))
    return out.select("doc_id", F.coalesce(fold() == HELD, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "fired")
