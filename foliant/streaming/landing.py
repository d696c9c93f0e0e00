"""A landing folder as a stream: the same table functions over files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from foliant.schemas import FILES


def landing(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """path, length and content of files as they land."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.djvu").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return raw.select(*[f.split()[0] for f in FILES.split(", ")])


def ingest(spark: SparkSession, path: str, table: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Decode what lands with one of the table functions and append it to Parquet."""
    writer = table(landing(spark, path)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
