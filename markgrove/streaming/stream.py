"""Structured Streaming over documents: stateless parsing, and quality by event-time window with a watermark.

A document is one event, so parsing keeps no state; the kernel runs on a streaming DataFrame as on a static one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import parse


def read_stream(spark: SparkSession, path: str, schema: str, style: str = "parquet", files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.format(style).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def summaries(stream: DataFrame, id_col: str, content_col: str, time_col: str) -> DataFrame:
    """One summary row per document of the stream, with its time."""
    return parse.documents(stream, id_col, content_col, carry=(time_col,))


def quality_by_window(summary: DataFrame, time_col: str, window: str = "10 minutes", late: str = "20 minutes", slide: str | None = None) -> DataFrame:
    """Documents, mean confidence, repairs and failures of each window; rows later than `late` are dropped by the watermark."""
    span = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    found = summary.withWatermark(time_col, late).groupBy(span.alias("w")).agg(
        F.count("*").alias("n_documents"), F.avg("confidence").alias("mean_confidence"), F.sum("repair_count").alias("repairs"), F.count_if(~F.col("success")).alias("failures")
    )
    return found.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_documents", "mean_confidence", "repairs", "failures")


def write_stream(df: DataFrame, path: str, checkpoint: str, once: bool = True, mode: str = "append") -> StreamingQuery:
    """Write a stream as Parquet; once: take what is there now, then stop."""
    writer = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(path)
