"""Streams of events: windows with watermarks, deduplication, and upserts by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, folder: str, name: str = "events", per_trigger: int = 1) -> DataFrame:
    """A table's Parquet as a stream; time stamps become time stamps in UTC."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    for f in schema.fields:
        if f.dataType.typeName() == "timestamp_ntz":
            stream = stream.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return stream


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    by = rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "1 day", step: str = "12 hours", late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    by = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")


def once(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each key once; on a stream, state is kept as long as the watermark allows."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def drain(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None]) -> None:
    """Runs a stream over all that is there, handing each micro-batch to ``batch``."""
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
    query.awaitTermination()


def to_memory(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there into a table in memory; for tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
