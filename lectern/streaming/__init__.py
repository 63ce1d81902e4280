"""Structured Streaming: documents that arrive in a folder, chunked as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.functions.text import lines_of
from lectern.operators.chunks import TEXT_CHARS, exploded, line_chunks


def inbox(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Parquet files that arrive in ``folder``."""
    return spark.readStream.schema(schema).parquet(folder)


def chunk_stream(docs: DataFrame, longest: int = TEXT_CHARS) -> DataFrame:
    """Stateless: each document's chunks, with the columns of ``operators.chunks.exploded``."""
    return exploded(docs, line_chunks(lines_of(F.col("text")), longest), "doc_id")


def to_parquet(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once file sink over everything that is there."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, *, late: str = "10 minutes", width: str = "5 minutes", step: str | None = None) -> DataFrame:
    """Counts and sums by window and type, late rows dropped past the watermark."""
    w = F.window("ts", width, step) if step else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("window.start", "event_type", "n", "value")
