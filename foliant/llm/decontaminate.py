"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Texts are lowered and their words typed: numbers, names (capitalised inside a sentence, but not in capitals throughout) and
units after numbers become placeholders, so a question with other numbers or names has the same
template. Five-word template windows are hash-joined with those of the benchmark. A document that
holds CONTAINMENT of an item's distinct windows is a candidate; then slots are checked: for each
item and document, each slot value of the item must stand for one value in the document and the
other way round. Windows whose slots disagree don't count towards the containment.

Defined results: null or empty texts match nothing. Items of fewer than five words have no
window and match nothing. Windows with fewer than LITERALS plain words are left out, unless the
item has no others. Repeated benchmark rows count as one item each; rows equal in id and text
count as one document. Null ids are kept: they match as any other. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import LAST_ID, cut, discard, join_keyed, packed_rows

WORDS = 5
CONTAINMENT = 0.8
LITERALS = 2

#: Units that a number may carry.
UNITS = ("km", "m", "cm", "mm", "kg", "g", "mg", "l", "ml", "s", "min", "h", "hours", "hour", "minutes", "seconds", "days", "weeks", "years", "usd", "eur", "dollars", "euros", "cents", "percent", "miles", "feet", "inches", "pounds", "tons", "degrees")
NAME = r"([^.!?\s\x01] )(\p{Lu}\p{Ll})"
UNIT = rf"([0-9]) ?({'|'.join(sorted(UNITS, key=lambda u: (-len(u), u)))})\b"
GAP = r"[^\p{L}\p{N}\x01\x02]+"
NAME_MARK, UNIT_MARK = "\x01", "\x02"
#: What placeholders hash to, in place of a word.
SLOTS = {"number": "<number>", "name": "<name>", "unit": "<unit>"}


def typed_words(text: Column) -> Column:
    """The words, each slot marked by its first character: a digit, or a mark."""
    marked = F.lower(F.regexp_replace(text, NAME, rf"$1{NAME_MARK}$2"))
    return F.filter(F.split(F.regexp_replace(marked, UNIT, rf"$1 {UNIT_MARK}$2"), GAP), lambda w: w != "")


def _template(w: str) -> str:
    return f"CASE WHEN ascii({w}) BETWEEN 48 AND 57 THEN {hash_of('number')} WHEN ascii({w}) = 1 THEN {hash_of('name')} WHEN ascii({w}) = 2 THEN {hash_of('unit')} ELSE xxhash64({w}) END"


def hash_of(slot: str) -> str:
    return f"xxhash64('{SLOTS[slot]}')"


def is_slot(w: str) -> str:
    return f"(ascii({w}) BETWEEN 48 AND 57 OR ascii({w}) IN (1, 2))"


def windows(rows: DataFrame, words: int) -> DataFrame:
    """The columns of rows but `ws`, then key and pos of every template window. Shifted copies of the hashes are zipped, so that windows are made and hashed in generated code."""
    others = [c for c in rows.columns if c != "ws"]
    shifted = ", ".join(f"slice(hs, {k + 1}, size(hs))" for k in range(words))
    full = rows.withColumn("hs", F.expr(f"transform(ws, w -> {_template('w')})"))
    each = full.select(*others, F.posexplode(F.expr(f"if(size(hs) >= {words}, slice(arrays_zip({shifted}), 1, size(hs) - {words - 1}), array())")).alias("pos", "z"))
    return each.select(*others, F.expr(f"xxhash64({', '.join(f'z.`{k}`' for k in range(words))})").alias("key"), "pos")


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, item_windows, matched, exact (all slots equal) for each contaminated pair; and the row key th."""
    items = benchmark.select(F.col(item_id).alias("item"), F.col(item_text).alias("t")).where("t is not null").distinct().withColumn("it", F.xxhash64("t")).withColumn("ws", typed_words(F.col("t"))).where("size(ws) > 0").drop("t")
    plain = f"size(filter(slice(ws, pos + 1, {words}), w -> not {is_slot('w')})) >= {LITERALS}"
    iw = windows(items.withColumn("own", F.col("ws")), words).withColumnRenamed("own", "ws")
    iw = iw.withColumn("plain", F.expr(plain)).withColumn("any", F.expr("max(plain) over (partition by item, it)")).where("plain or not any")
    iw = iw.select("item", "it", "key", "pos", F.slice("ws", F.col("pos") + 1, F.lit(words)).alias("iw"))
    index = cut(iw.withColumn("total", F.expr("size(collect_set(key) over (partition by item, it))")))
    keys = cut(index.select("key").distinct())
    source = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("t"))
    hits = cut(join_keyed(windows(source.select("id", "th", typed_words(F.col("t")).alias("ws")), words).withColumnRenamed("pos", "dp"), keys, ["key"], "inner").distinct())
    # an item's least frequent windows, as many as cannot all be missing, bring documents to it, so windows that are common in the corpus pair nothing; then all windows count
    frequent = hits.groupBy("key").agg(F.count("*").alias("df"))
    rarest = Window.partitionBy("item", "it").orderBy("df", "key")
    distinct_keys = index.select("item", "it", "key", "total").distinct()
    probe = cut(distinct_keys.join(frequent, "key", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("rank", F.row_number().over(rarest)).where(f"rank <= total - ceil({containment} * total) + 1 and df > 0").select("item", "it", "key"))
    found = hits.select("id", "th", "key").distinct()
    pairs = join_keyed(found, probe, ["key"], "inner").select("id", "th", "item", "it").distinct()
    shared = join_keyed(found.join(pairs, ["id", "th"]), index.select("item", "it", "key", "total").distinct(), ["item", "it", "key"], "inner", rows=index.count())
    candidates = cut(shared.groupBy("id", "th", "item", "it").agg(F.count("*").alias("n"), F.max("total").alias("total")).where(f"n >= {containment} * total").drop("n"))
    # the slots of the candidates' matched windows: the texts of those documents alone are typed again, once
    own = cut(candidates.select("id", "th").distinct())
    ws = join_keyed(source, own, ["id", "th"], "left_semi").groupBy("id", "th").agg(F.first("t").alias("t")).select("id", "th", typed_words(F.col("t")).alias("ws"))
    placed = join_keyed(hits.join(candidates, ["id", "th"]), index.drop("total"), ["item", "it", "key"], "inner")
    matched = cut(placed.join(ws, ["id", "th"]).select("id", "th", "item", "it", "total", "key", "pos", "dp", "iw", F.slice("ws", F.col("dp") + 1, F.lit(words)).alias("dw")))
    discard(keys, hits, probe, candidates, own, index)
    slots = matched.selectExpr("id", "th", "item", "it", "key", "pos", "dp", f"inline(filter(transform(iw, (w, k) -> named_struct('a', w, 'b', dw[k])), x -> {is_slot('x.a')}))")
    group = ["id", "th", "item", "it"]
    # of several places of a window, the one that agrees with the most others decides: places are told apart by their shift
    shift = (F.col("dp") - F.col("pos")).alias("shift")
    slots = slots.withColumn("shift", shift)
    one = slots.groupBy(*group, "shift", "a").agg((F.min("b") != F.max("b")).alias("bad")).where("bad").select(*group, "shift", "a")
    two = slots.groupBy(*group, "shift", "b").agg((F.min("a") != F.max("a")).alias("bad")).where("bad").select(*group, "shift", "b")
    bad = slots.join(one, [*group, "shift", "a"], "left_semi").select(*group, "shift", "key", "pos").union(slots.join(two, [*group, "shift", "b"], "left_semi").select(*group, "shift", "key", "pos")).distinct()
    good = matched.withColumn("shift", shift).join(bad, [*group, "shift", "key", "pos"], "left_anti")
    result = good.groupBy(*group).agg(F.count_distinct("key").alias("matched"), F.max("total").cast("long").alias("item_windows"), F.min(F.expr("iw = dw")).alias("exact")).where(f"matched >= {containment} * item_windows")
    return result.select(F.when(F.col("id") != LAST_ID, F.col("id")).alias("doc_id"), F.col("item").alias("item_id"), "item_windows", "matched", "exact", F.col("id").alias("_id"), F.col("th").alias("_th"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all their columns, that hold no benchmark item."""
    hit = cut(contaminated(docs, benchmark, doc_id, text).select("_id", "_th").distinct())
    return join_keyed(packed_rows(docs, doc_id, text), hit, ["_id", "_th"], "left_anti").select("r.*")
