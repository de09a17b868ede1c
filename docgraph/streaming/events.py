"""Event-time operators; each takes a batch or a stream of (event_id, ts, user_id, event_type, ...)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window and type; on a stream, events later than `late` are dropped."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def trailing_rate(events: DataFrame, seconds: int = 60) -> DataFrame:
    """Per event, how many of its user's events lie in the trailing window, itself included."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("in_window", F.count("*").over(w))


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each key's first event; on a stream, repeats within the watermark are dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def per_key(events: DataFrame) -> DataFrame:
    """(user_id, n, total): each user's events and value so far, kept as state of the key; a row for each user a batch changes."""

    def run(key, batches, state):
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    if not events.isStreaming:
        return events.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return events.groupBy("user_id").applyInPandasWithState(run, "user_id long, n long, total double", "n long, total double", "update", "NoTimeout")


def append_new(spark: SparkSession, source: str, schema, out: str, checkpoint: str):
    """Appends new Parquet files' rows to out, once each over restarts: files done are remembered in the checkpoint."""
    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
