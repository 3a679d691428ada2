"""Streaming ingest (an extension): token counts of arriving documents, and windowed event counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import tokens


def read(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, freq), kept up to date; for output modes update and complete."""
    return docs.select(F.explode(tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("freq"))


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n) by event-time windows; events later than the watermark are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")
