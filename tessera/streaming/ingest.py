"""Streaming: documents chunked as they arrive, and windowed counts of events with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import chunking


def chunk_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Parquet files of documents as they land -> tidy chunks under ``sink``; each batch is whole documents, and has a folder
    of its own, which it writes over when it is played again."""
    docs = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, batch_id: int) -> None:
        chunking.tidy(chunking.chunk_markdown(batch)).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, size: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by type and tumbling window, or sliding ones that begin every ``slide``; on a stream, events later
    than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: events no more than ``gap`` apart."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
