"""Spark plumbing that several operators share: durable cuts, a fixed-size table of key levels,
joins that broadcast behind a size check, and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes as written, up to which a keyed side may be broadcast; fixed bounds, checked.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 32 << 20
#: Bits of the table of key levels: 16 MB at every input size.
LEVEL_BITS = 24
LAST_ID = (1 << 63) - 1


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the context's checkpoint folder. Where both are unset, a session in one process, as in tests, gets a temporary one; on a cluster that is an error, as executors don't share local folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[0-9*, ]+\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="foliant-"))
        folder = _own_folder[0]
    return folder.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


#: Rows to an Arrow batch where rows hold whole texts or sets, so that a batch's memory is bounded.
WIDE_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def narrow_batches(spark: SparkSession) -> Iterator[None]:
    """Python stages that are planned meanwhile get at most WIDE_ROWS rows in a batch."""
    before = spark.conf.get(_BATCH)
    try:
        spark.conf.set(_BATCH, str(min(int(before), WIDE_ROWS)) if int(before) > 0 else str(WIDE_ROWS))
        yield
    finally:
        spark.conf.set(_BATCH, before)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def spent_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go when it is written. Else they stay until the driver happens to collect its garbage, so that all shuffles of a query may lie on disk at once."""
    before = spark.conf.get(_CLEANUP, None)
    try:
        spark.conf.set(_CLEANUP, "true")
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame, wide: bool = False, spent: bool = False) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends there, and a lost executor loses nothing. The files go by `discard`, or when the driver ends. wide: Python stages get their rows in smaller batches. spent: see spent_shuffles."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/foliant-{uuid.uuid4().hex}"
    with narrow_batches(spark) if wide else contextlib.nullcontext(), spent_shuffles(spark) if spent else contextlib.nullcontext():
        df.write.parquet(path)
    system, place = _file_system(spark, path)
    system.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames that `cut` gave, once nothing that is still to run reads them."""
    for df in frames:
        system, place = _file_system(df.sparkSession, df.written_to)
        system.delete(place, True)


def packed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """r: the whole row as a struct, whatever its columns are called; _id (null ranks last) and _th (a hash of the text), which rows that are the same document share."""
    return docs.select(F.struct("*").alias("r"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("_id"), F.xxhash64(F.col(text)).alias("_th"))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The same batch function, giving freed memory back when a task ends, as workers live on."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                    ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def _slots(few: DataFrame, bits: int, part: int, width: int):
    """An array of 2**bits places from rows (slot, level): each task makes its own stretches of it.
    What reaches the driver has that fixed size whatever the input."""

    def stretches(frames):
        import pandas as pd

        for pdf in frames:
            for base, own in pdf.groupby(pdf.slot // part):
                x = np.zeros(part, np.uint8)
                np.maximum.at(x, own.slot.to_numpy() % part, own.level.to_numpy().astype(np.uint8))
                yield pd.DataFrame({"base": [base], "data": [(np.packbits(x > 0) if width == 1 else x).tobytes()]})

    each = part * width // 8
    rows = few.groupBy("slot").agg(F.max("level").alias("level")).repartition(F.expr(f"slot div {part}")).sortWithinPartitions("slot").mapInPandas(stretches, "base long, data binary")
    out = np.zeros((1 << bits) * width // 8, np.uint8)
    for base, data in rows.toLocalIterator():
        own = out[base * each : (base + 1) * each]
        np.copyto(own, np.frombuffer(data, np.uint8) | own if width == 1 else np.maximum(np.frombuffer(data, np.uint8), own))
    return out


def repeated_keys(keys: DataFrame) -> DataFrame:
    """key and n of keys that occur at least twice; `keys` holds long `key` and long `n`, how often it occurs there. A distributed aggregate with map-side partial sums."""
    return keys.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")


def level_sketch(keys: DataFrame) -> np.ndarray:
    """A fixed-size table with a byte for each of 2**LEVEL_BITS slots: 0 if no repeated key is there, else it rises with the logarithm of the greatest count."""
    level = F.least(F.lit(255), F.floor(F.log2("n") * 6)).cast("int")
    return _slots(repeated_keys(keys).select(F.shiftrightunsigned("key", 64 - LEVEL_BITS).alias("slot"), level.alias("level")), LEVEL_BITS, 1 << min(16, LEVEL_BITS), 8)


def level_of(levels: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return levels[(keys.view(np.uint64) >> np.uint64(65 - len(levels).bit_length())).astype(np.int64)]


def join_keyed(big: DataFrame, keyed: DataFrame, on: list[str], how: str, rows: int | None = None) -> DataFrame:
    """Join with a side that was cut to a file: broadcast if its counted rows and its written bytes are within the bounds, else shuffled."""
    small = (keyed.count() if rows is None else rows) <= BROADCAST_ROWS
    if small and hasattr(keyed, "written_to"):
        system, place = _file_system(keyed.sparkSession, keyed.written_to)
        small = system.getContentSummary(place).getLength() <= BROADCAST_BYTES
    return big.join(F.broadcast(keyed) if small else keyed.hint("merge"), on, how)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for each node of the edges (a, b): the least node it reaches.

    Each round hooks every node to the least label beside it, then shortcuts labels of labels.
    Rounds end when nothing changes; each round's labels are cut, so a lost executor costs one
    round at most. Least labels are aggregates with partial minima, also for hubs.
    """
    edges = cut(edges.where("a <> b").select(F.expr("inline(array(named_struct('a', a, 'b', b), named_struct('a', b, 'b', a)))")).distinct(), wide=True)
    before = cut(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    labels = before
    for _ in range(rounds):
        beside = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("other"))
        hooked = labels.join(beside, "node").select("node", "label", F.least("label", "other").alias("new"))
        up = labels.select(F.col("node").alias("new"), F.col("label").alias("jump"))
        step = cut(hooked.join(up, "new", "left").select("node", "label", F.least("new", F.coalesce("jump", "new")).alias("new")))
        done = step.where("label <> new").isEmpty()
        discard(before)
        before, labels = step, step.select("node", F.col("new").alias("label"))
        if done:
            discard(edges)
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError("labels did not settle")


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)
