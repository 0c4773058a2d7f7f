"""Structured Streaming forms: a change log kept by batches, latest values, windows of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cloudloom.operators.changefeed import ChangeLog


def follow(stream: DataFrame, log: ChangeLog, checkpoint: str):
    """Appends every micro-batch to the log until the input is read; a repeated batch replaces itself."""
    q = stream.writeStream.foreachBatch(lambda df, batch: log.append(df, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def windowed(events: DataFrame, time: str, length: str, slide: str | None, by: str, value: str, late: str = "10 minutes") -> DataFrame:
    """(window_start, by, n, total): sliding or tumbling windows; on a stream, rows later than ``late`` are dropped."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return events.withWatermark(time, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, by: str, late: str = "10 minutes") -> DataFrame:
    """(session_start, session_end, by, n): activity separated by gaps."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), by, "n")


def stream_table(spark: SparkSession, d: str, name: str, files_per_batch: int = 4) -> DataFrame:
    """A parquet table, one file or a folder of them, as a stream of its files."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{d}/{name}.[p]arquet")  # a pattern may stand for a file or a folder
