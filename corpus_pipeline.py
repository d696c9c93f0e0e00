"""A corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and its
decisions take effect; all but the last return the columns of documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontaminate as contamination
from foliant.llm import langid, lines, ngram_join, packing
from foliant.llm.shared import cut


#: Rows to an Arrow batch: rows hold whole texts, and a batch's memory is to be bounded.
BATCH_ROWS = 1000


def small_batches(stage):
    """The same stage in a session whose Python stages take BATCH_ROWS rows at a time; the session keeps the setting, as a stage's work begins after it returns."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language isn't identified with a score of 0.5 go; of the others, lang takes the prediction."""
    return langid.keep_identified(docs, langid.train(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows leave the texts; n_chars follows. A document of which nothing but blanks is left, as of a copy, goes."""
    out = lines.deduped(docs).where("n_removed = 0 or trim(BOTH '\n\t\r ' FROM kept) <> ''")
    new = {"text": F.col("kept"), "n_chars": F.coalesce(F.length("kept"), F.lit(0))}
    return out.select(*[new.get(f.name, F.col("r")[f.name]).cast(f.dataType).alias(f.name) for f in docs.schema])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays; near is a Jaccard similarity of 0.8 of five-word shingles (op 10 has its own values)."""
    return ngram_join.keep_one(docs, words=5, similarity=(80, 100))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return contamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids, one row per piece with its ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", language), ("line dedup", dedup_lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminate), ("packing", pack)]
STAGES = [(name, small_batches(stage)) for name, stage in STAGES]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
