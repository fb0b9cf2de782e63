"""Streams: documents as files arrive, each content once; windowed statistics with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def document_stream(spark: SparkSession, folder: str, schema: str = "doc_id long, text string, ts timestamp") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def once(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each content once within the watermark; the state is bounded by it."""
    return stream.withColumn("content", F.sha2("text", 256)).withWatermark("ts", late).dropDuplicatesWithinWatermark(["content"])


def window_counts(events: DataFrame, size: str = "10 minutes", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def chunk_stream(stream: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    from ..operators.chunks import create_chunks

    return create_chunks(stream, size, overlap)
