"""Extension: packages and event rows as streams.

The pipeline needs no stream for parity; these functions let the same operators run on a folder that
fills up and on the events table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.functions.ids import file_key
from docframe.sources.docx import expand


def package_stream(spark: SparkSession, folder: str, pattern: str = "*.docx", max_files: int = 1000) -> DataFrame:
    """New packages of a folder as part rows."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).load(folder)
    return expand(files.select(file_key(F.col("path")).alias("file_key"), "path", "content"))


def for_each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``handle`` on every micro-batch of what is there now, exactly once per batch number."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events per type and tumbling window with a watermark for late rows; works on a batch and on a stream."""
    at = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        at = at.withWatermark("at", late)
    return at.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
