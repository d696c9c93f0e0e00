"""N-gram Jaccard join by T-occurrence search.

A document is the set of its distinct word shingles. Two documents link when their Jaccard
similarity reaches SIMILARITY; the result is each document's connected component.

1. Shingles are counted over the whole corpus (a fixed share of them, chosen by hash; per-task
   sums first); a table of fixed size keeps how frequent the most frequent one of each slot is.
2. Each set's rarest shingles by that table are its prefix. It is SPARE of the set longer than linked
   sets need in order to share one, so they share q, a twentieth of the smaller one. One shuffle
   brings equal prefix shingles together; those of one set drop out (certain ones are left out at
   once), and with them sets that are left with fewer than q. Of the others the q - 1 most frequent are spared, now
   by exact counts. So the table only orders: when it is full, as in a large corpus, more unique shingles travel,
   and hardly more sets stay. Sets equal to each other are one from here on.
3. All who share a prefix shingle meet in the cell of the least of them; only those sets are made
   of their texts again. A cell beyond CELL bytes is compared with its pivot first, in blocks: the
   set with most copies and most of its prefix shared, as the original of near copies. Those that link
   with it are joined and needn't be compared with each other, so pairs of blocks are dealt out
   only of the rest against all, and each of the rest gives one edge a pair to what is joined.
4. In a cell, inverted lists are searched as in DivideSkip: a set's short lists are merged by
   counting, the few longest are only probed by binary search for documents whose count can
   still reach the overlap T. Documents of a component that is already joined are not verified
   again, and only edges that join two components leave the cell: at most one per document.
5. Components of those edges are found by rounds of least labels.

No partner or candidate is dropped: step 2 uses necessary conditions, step 4 is exact on 64-bit
hashes of shingles; equal sets are told by 128 bits, sets among each other by 64.

Defined results: null text, and text without words, is the empty set: size 0, linked with
nothing, its own component. Fewer words than a shingle: the whole sequence is the one shingle.
Rows equal in id and text count as one document. A null id ranks last and is reported as null.
Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .shared import LAST_ID, batch, components, cut, discard, lean, level_of, level_sketch, packed_rows

WORDS = 4
SIMILARITY = (85, 100)
#: Of 256 hash classes of shingles, those that are counted.
COUNTED = 80
#: DivideSkip's cost ratio; larger than for heaps, as merging by counting is cheap next to a probe here.
MU = 0.085
#: Bytes of shingle hashes that a cell may hold before it is dealt out.
CELL = 2 << 20
#: A set's prefix is longer than needed by its size over this.
SPARE = 20
#: Level (of the table) up to which a shingle's sets, some 70,000 rows of three numbers at most, may meet in one task.
COMMON = 96


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, ascending in each row, and the rows' offsets."""
    starts, ends, at = K.words(data, offsets)
    h = K.word_hashes(K.LOWER[data], starts, ends)
    n = np.diff(at)
    prefix = K.Prefix(h)
    first = np.arange(len(h))
    row = np.repeat(np.arange(len(n)), n)
    last = at[1:][row]
    ok = (first + words <= last) | ((first == at[:-1][row]) & (n[row] < words))
    first, row = first[ok], row[ok]
    end = np.minimum(first + words, at[1:][row])
    g = K.mix(prefix.span(first, end) + (end - first).astype(np.uint64))
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    g, row = g[keep], row[keep]
    return g, np.searchsorted(row, np.arange(len(n) + 1))


def counted(g: np.ndarray) -> np.ndarray:
    return (g & np.uint64(255)) < np.uint64(COUNTED)


def least_overlap(size: np.ndarray | int, similarity: tuple[int, int]):
    """Shingles that a set must share with any set it links with."""
    return -(-size * similarity[0] // similarity[1])


def least_shared(size: np.ndarray | int, similarity: tuple[int, int]):
    """Prefix shingles that a set must share with any set it links with: what the smallest such set has to spare, and one."""
    return least_overlap(size, similarity) // SPARE + 1


def prefix_tokens(g: np.ndarray, levels: np.ndarray, similarity: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """A set's prefix, but for shingles that are certain to be unique, in an order that is the same for all sets: counted before others, then by level, then by hash. Those of few sets, and those that may be of many."""
    take = len(g) - int(least_overlap(len(g), similarity)) + 1 + len(g) // SPARE
    of = counted(g)
    own = g[of]
    level = level_of(levels, own)
    order = np.lexsort((own, level))[:take]
    chosen, level = own[order], level[order]
    few = (level > 0) & (level <= COMMON)
    return chosen[few], np.concatenate([chosen[level > COMMON], g[~of][: take - min(take, len(own))]])


class Cell:
    """Sets of one cell: an inverted index, and a search of it that joins components."""

    def __init__(self, sets: list[np.ndarray], side: np.ndarray, similarity: tuple[int, int], joined: np.ndarray | None = None):
        """joined: sets that are known to be of one component."""
        self.order = np.argsort([len(x) for x in sets], kind="stable")
        self.sets, self.side, self.similarity = [sets[i] for i in self.order], side[self.order], similarity
        self.size = np.array([len(x) for x in self.sets])
        one = np.flatnonzero(joined[self.order]) if joined is not None else []
        self.root = np.arange(len(sets))
        self.root[one] = one[0] if len(one) else 0
        self.parent = self.root.tolist()

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def linked(self, overlap, a, b):
        return self.similarity[1] * overlap >= self.similarity[0] * (a + b - overlap)

    def edges(self, across: bool):
        """Pairs (places in the caller's order) that join components; across: only between the two sides."""
        if len(self.sets) == 2:
            a, b = self.sets
            if self.linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)) and (not across or self.side[0] != self.side[1]):
                yield int(self.order[0]), int(self.order[1])
            return
        flat = np.concatenate(self.sets)
        doc = np.repeat(np.arange(len(self.sets)), self.size)
        _, token = np.unique(flat, return_inverse=True)
        order = np.argsort(token, kind="stable")
        lists = doc[order]  # ascending in each list, so by size
        head = np.concatenate([[0], np.cumsum(np.bincount(token))])
        at = np.concatenate([[0], np.cumsum(self.size)])
        root = self.root
        for x in range(1, len(self.sets)):
            low = int(np.searchsorted(self.size, least_overlap(int(self.size[x]), self.similarity)))
            if low >= x:
                continue
            own = token[at[x] : at[x + 1]]
            a, b = head[own], head[own + 1]
            n = b - a
            need = int(least_overlap(int(self.size[x]), self.similarity))
            by = np.argsort(n, kind="stable")
            longest = int(n[by[-1]])
            aside = min(need - 1, int(need / (MU * np.log2(longest + 1) + 1)))
            short, long = by[: len(by) - aside], by[len(by) - aside :]
            where = np.repeat(a[short] - (np.cumsum(n[short]) - n[short]), n[short]) + np.arange(int(n[short].sum()))
            found = lists[where]
            count = np.bincount(found[(found >= low) & (found < x)] - low, minlength=x - low)
            cand = np.flatnonzero(count >= need - aside)
            if across:
                cand = cand[self.side[cand + low] != self.side[x]]
            cand = cand[root[cand + low] != root[x]]
            total = count[cand]
            t = -(-self.similarity[0] * (self.size[x] + self.size[cand + low]) // sum(self.similarity))
            for k, i in enumerate(long):
                if not len(cand):
                    break
                inverted = lists[a[i] : b[i]]
                spot = np.searchsorted(inverted, cand + low)
                total = total + (inverted[np.minimum(spot, len(inverted) - 1)] == cand + low)
                may = total + (len(long) - 1 - k) >= t
                cand, total, t = cand[may], total[may], t[may]
            good = cand[self.linked(total, self.size[x], self.size[cand + low])] + low
            joined = False
            for y in good.tolist():
                p, q = self.find(x), self.find(y)
                if p != q:
                    self.parent[max(p, q)] = min(p, q)
                    joined = True
                    yield int(self.order[x]), int(self.order[y])
            if joined:
                root[: x + 1] = [self.find(i) for i in range(x + 1)]


def joined(big: DataFrame, other: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join by a shuffle of both sides: they grow with the corpus, and so the plan is the same at every size."""
    return big.join(other.hint("merge"), on, how)


def ngram_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    known = lambda c: F.when(c != LAST_ID, c)
    out = grouped(docs, doc_id, text, words, similarity)
    return out.select(known(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), known(F.coalesce("least", "id")).alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The rows, all their columns, of the least id of each component; of rows equal in id and text, one."""
    every = cut(grouped(docs, doc_id, text, words, similarity).select("id", "th", "group"))
    several = cut(every.where("group is not null").groupBy("group").agg(F.min(F.struct("id", "th")).alias("first"), F.max(F.struct("id", "th")).alias("last")).where("first <> last").select("group", "first"))
    gone = cut(joined(every, several, ["group"], "inner").where("struct(id, th) <> first").select(F.col("id").alias("_id"), F.col("th").alias("_th")).distinct())
    kept = joined(packed_rows(docs, doc_id, text), gone, ["_id", "_th"], "left_anti")
    if not every.groupBy("id", "th").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["_id", "_th"])
    discard(every, several)
    return kept.select("r.*")


def grouped(docs: DataFrame, doc_id: str, text: str, words: int, similarity: tuple[int, int]) -> DataFrame:
    """id, th, n of every row; and of rows that link with others group, a number, and least, the least id."""
    source = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    spark = docs.sparkSession
    keys = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def count(batches):
        held, size = [], 0

        def out():
            u, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            for i in range(0, len(u), 1 << 16):
                yield batch(keys, K.signed(u[i : i + (1 << 16)]), n[i : i + (1 << 16)])

        for b in batches:
            for _, _, data, offsets in K.chunks(b.column("text")):
                g, _ = shingles(data, offsets, words)
                held.append(g[counted(g)])
                size += len(held[-1])
                if size > 1_000_000:
                    yield from out()
                    size = 0
        if held:
            yield from out()

    levels = spark.sparkContext.broadcast(level_sketch(source.select("text").mapInArrow(lean(count), "key long, n long")))
    sets = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("many", pa.binary())])
    tokens = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("q", pa.int32())])

    def contents(g: np.ndarray, at: np.ndarray, salt: int) -> np.ndarray:
        sums = np.concatenate([[np.uint64(0)], np.cumsum(K.mix(g ^ np.uint64(salt)))])
        return K.signed(K.mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64)))

    def describe(batches):
        for b in batches:
            for i, j, data, offsets in K.chunks(b.column("text")):
                g, at = shingles(data, offsets, words)
                n = np.diff(at)
                many = [prefix_tokens(g[x:y], levels.value, similarity)[1] if y > x else g[:0] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                c1, c2 = (contents(g, at, salt) for salt in (3, 0xABCDEF))
                yield batch(sets, b.column("id").slice(i, j - i), b.column("th").slice(i, j - i), n, pa.array(c1, mask=n == 0), pa.array(c2, mask=n == 0), [x.tobytes() if len(x) else None for x in many])

    every = cut(source.mapInArrow(lean(describe), "id long, th long, n long, c1 long, c2 long, many binary"), wide=True)
    least = (F.min("id").alias("id"), F.min_by("th", "id").alias("th"))
    reps = cut(every.where("n > 0").groupBy("c1", "c2").agg(*least, F.count("*").alias("k"), F.first("n").alias("n"), F.first("many").alias("many")).select("id", "th", "c1", "c2", "k", "n", "many", F.col("c1").alias("node")))

    def few_of(batches):
        for b in batches:
            seen: set[int] = set()  # equal sets of a batch are sent once
            for _, _, data, offsets in K.chunks(b.column("text")):
                g, at = shingles(data, offsets, words)
                own, nodes, shared_ = [g[:0]], [], []
                for x, y, c in zip(at[:-1].tolist(), at[1:].tolist(), contents(g, at, 3).tolist(), strict=True):
                    if y > x and c not in seen:
                        seen.add(c)
                        own.append(prefix_tokens(g[x:y], levels.value, similarity)[0])
                        nodes.append(c)
                        shared_.append(int(least_shared(y - x, similarity)))
                size = [len(x) for x in own[1:]]
                yield batch(tokens, K.signed(np.concatenate(own)), np.repeat(np.array(nodes, np.int64), size), np.repeat(np.array(shared_, np.int32), size))

    def many_of(batches):
        for b in batches:
            own = [np.frombuffer(x.as_py(), np.int64) for x in b.column("many")]
            size = [len(x) for x in own]
            yield batch(tokens, np.concatenate(own), np.repeat(b.column("node").to_numpy(), size), np.repeat(least_shared(b.column("n").to_numpy(), similarity).astype(np.int32), size))

    # who shares a token has the least of its nodes for head. Few share one that is not common: they meet in one shuffle; others by an aggregate and a join
    few = source.select("text").mapInArrow(lean(few_of), "token long, node long, q int").repartition("token").groupBy("token", "node").agg(F.min("q").alias("q"))
    each = Window.partitionBy("token")
    near = few.withColumn("head", F.min("node").over(each)).withColumn("k", F.count("*").over(each)).where("k > 1").select("token", "node", "q", "head", "k")
    many = reps.where("many is not null").select("many", "node", "n").mapInArrow(lean(many_of), "token long, node long, q int")
    heads = cut(many.groupBy("token").agg(F.min("node").alias("head"), F.count("*").alias("k")).where("k > 1"))
    shared = near.union(joined(many, heads, ["token"], "inner").select("token", "node", "q", "head", "k"))
    own = Window.partitionBy("node")
    ranked = shared.withColumn("all", F.count("*").over(own)).withColumn("rank", F.row_number().over(own.orderBy("k", "token")))
    members = cut(ranked.where("all >= q and rank <= all - q + 1").groupBy("head", "node").agg(F.max("all").alias("all")), wide=True)
    # how many copies a set has, and how much of its prefix others share: the set that the others are copies of has most
    typical = (F.col("k") + F.col("all") / F.col("n")).alias("typical")
    sized = cut(members.join(reps.select("node", "n", "k"), "node").select("head", "node", (F.col("n") * 8).alias("bytes"), typical))
    cells = cut(sized.groupBy("head").agg(F.ceil(F.sum("bytes") / CELL).cast("int").alias("blocks"), F.max_by("node", "typical").alias("pivot"), F.count("*").alias("k")).where("k > 1").select("head", "blocks", "pivot"))
    placed = cut(joined(sized.drop("typical"), cells, ["head"], "inner"))
    discard(heads, members, sized)
    met = cut(placed.select("node").distinct())
    chosen = cut(joined(reps.select("id", "th", "node"), met, ["node"], "left_semi"))
    grams = pa.schema([("node", pa.int64()), ("grams", pa.binary())])

    def again(batches):
        for b in batches:
            for i, j, data, offsets in K.chunks(b.column("text")):
                g, at = shingles(data, offsets, words)
                yield batch(grams, b.column("node").slice(i, j - i), [g[x:y].tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])

    texts = joined(source, chosen, ["id", "th"], "inner").groupBy("id", "th").agg(F.first("node").alias("node"), F.first("text").alias("text"))
    own_sets = cut(texts.select("node", "text").mapInArrow(lean(again), "node long, grams binary"), wide=True)
    discard(met, chosen)

    def dealt(rows: DataFrame) -> DataFrame:
        """Rows of (cell, across, side, node) with their sets, cell by cell."""
        return rows.join(own_sets, "node").repartition("cell").sortWithinPartitions("cell")

    pairs = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def by_cell(of):
        def run(batches):
            now, rows, out = None, [], []
            for b in batches:
                for key, across, side, node, g in zip(*(b.column(x).to_pylist() for x in ("cell", "across", "side", "node")), b.column("grams"), strict=True):
                    if key != now:
                        out.extend(of(rows))
                        now = key
                        rows.clear()
                    rows.append((node, np.frombuffer(g.as_py(), np.uint64), across, side))
                if len(out) > 10_000:
                    yield batch(pairs, *zip(*out, strict=True))
                    out = []
            out.extend(of(rows))
            if out:
                yield batch(pairs, *zip(*out, strict=True))

        return lean(run)

    def search(rows):
        if len(rows) > 1:
            side = np.array([r[3] for r in rows])
            for x, y in Cell([r[1] for r in rows], np.minimum(side, 1), similarity, side == 2).edges(rows[0][2]):
                yield rows[x][0], rows[y][0]

    def to_pivot(rows):
        pivots = [r for r in rows if r[3] < 0]
        for pivot, g, *_ in pivots[:1]:
            for node, other, _, side in rows:
                shared_ = len(np.intersect1d(g, other, assume_unique=True)) if side >= 0 and node != pivot else 0
                if shared_ and similarity[1] * shared_ >= similarity[0] * (len(g) + len(other) - shared_):
                    yield pivot, node

    no, yes, none = F.lit(False).alias("across"), F.lit(True).alias("across"), F.lit(0).alias("side")
    links = dealt(placed.where("blocks = 1").select(F.xxhash64("head", F.lit(0)).alias("cell"), no, none, "node")).mapInArrow(by_cell(search), "a long, b long")
    large = placed.where("blocks > 1").withColumn("j", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    tables = []
    if not large.isEmpty():
        subcell = F.xxhash64("head", F.lit(1), "j").alias("cell")
        pivots = cells.where("blocks > 1").select("head", "pivot", F.explode(F.expr("sequence(0, blocks - 1)")).alias("j"))
        star = cut(dealt(large.select(subcell, no, none, "node").union(pivots.select(subcell, no, F.lit(-1), F.col("pivot").alias("node")))).mapInArrow(by_cell(to_pivot), "a long, b long"), wide=True)
        # the rest against all: blocks of the rest, of which each meets each block of the cell; those with the pivot are known to be one component
        with_pivot = large.join(star.select(F.col("a").alias("pivot"), F.col("b").alias("node"), F.lit(True).alias("starred")).distinct(), ["pivot", "node"], "left")
        large = cut(with_pivot.withColumn("starred", F.coalesce("starred", F.col("node") == F.col("pivot"))))
        rest = cut(large.where("not starred"))
        parts = cut(rest.groupBy("head").agg(F.ceil(F.sum("bytes") / CELL).cast("int").alias("parts")))
        pair = F.xxhash64("head", F.lit(2), "i", "j").alias("cell")
        left = joined(rest, parts, ["head"], "inner").withColumn("i", F.expr("cast(pmod(xxhash64(node, 1), parts) as int)")).withColumn("j", F.explode(F.expr("sequence(0, blocks - 1)")))
        right = joined(large, parts, ["head"], "inner").withColumn("i", F.explode(F.expr("sequence(0, parts - 1)")))
        both = left.select(pair, yes, none, "node").union(right.select(pair, yes, F.expr("if(starred, 2, 1)"), "node"))
        links = links.union(star).union(dealt(both).mapInArrow(by_cell(search), "a long, b long"))
        tables = [star, rest, parts, large]
    found = cut(components(links))
    discard(own_sets, placed, cells, *tables)
    linked = reps.select("node", "id").join(found, "node")
    group = found.join(linked.groupBy("component").agg(F.min("id").alias("least")), "component")
    classes = cut(reps.select("c1", "c2", "k", "id", "node").join(group, "node", "left").where("k > 1 or component is not null").select("c1", "c2", F.coalesce("component", "node").alias("group"), F.coalesce("least", "id").alias("least")))
    discard(found, reps)
    return joined(every.select("id", "th", "n", "c1", "c2"), classes, ["c1", "c2"], "left").select("id", "th", "n", "group", "least")
