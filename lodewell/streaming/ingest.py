"""Ingestion as a stream: an extension of the batch operators for feeds that land as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def landed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New JSON files below `path`."""
    return spark.readStream.schema(schema).json(path)


def first_seen_stream(stream: DataFrame, *, when: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key; state is dropped when the watermark has passed it."""
    return stream.withWatermark(when, late).dropDuplicatesWithinWatermark(keys)


def hourly_counts(stream: DataFrame, *, when: str, by: str, late: str = "1 hour") -> DataFrame:
    """Rows by hour and `by`, final once the watermark has passed."""
    return stream.withWatermark(when, late).groupBy(F.window(when, "1 hour"), by).agg(F.count("*").alias("n"))


def run_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there, appended as Parquet, in recoverable batches."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
