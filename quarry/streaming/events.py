"""Streams over an event table: repeats removed, windowed counts, and resumable work lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Files that arrive in a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once_each(events: DataFrame, key: list[str], time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The first event of each key; what is later than the watermark is dropped with its state."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def windowed_counts(events: DataFrame, group: list[str], length: str = "1 day", time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of each tumbling window; works alike on batches and streams."""
    rows = events.withWatermark(time, late).groupBy(F.window(time, length), *group).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("window.start").alias("window_start"), *group, "n", "total")


def sessions(events: DataFrame, key: str, gap: str, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return rows.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def append_log(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to a Parquet log; a restart goes on after the last finished batch."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def remaining(work: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Work that no log row names yet."""
    return work.join(done.select(*key).distinct(), key, "left_anti")
