"""Streams of events (beyond the batch engine): windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(events: DataFrame, *, lateness: str = "1 day", width: str = "1 day") -> DataFrame:
    """Counts and sums by type and window; state of windows past the watermark is dropped."""
    return (
        events.withWatermark("ts", lateness).groupBy(F.window("ts", width), "event_type")
        .agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )


def sessions(events: DataFrame, *, gap: str = "30 minutes", lateness: str = "1 day") -> DataFrame:
    """Sessions of each user, apart by a gap."""
    return events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def upsert_batches(stream: DataFrame, sink, checkpoint: str):
    """Run a stream's batches through a function (frame, batch number), once over what there is."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
