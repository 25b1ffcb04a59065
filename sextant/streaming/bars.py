"""Extensions over streams: bars from ticks and a CUSUM monitor. Each equals its batch form."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ticks(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of Parquet files of events."""
    return spark.readStream.schema(schema).parquet(folder)


def streaming_bars(events: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """symbol, bar_start, open, high, low, close, n per tumbling window, final when the watermark passes it."""
    key = F.struct("ts", "event_id")
    w = F.window("ts", f"{minutes} minutes")
    g = events.withWatermark("ts", late).groupBy(w, F.col("event_type").alias("symbol")).agg(
        F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.count(F.lit(1)).alias("n"))
    return g.select("symbol", F.col("window.start").alias("bar_start"), "open", "high", "low", "close", "n")


def streaming_cusum(events: DataFrame, mean: float, sd: float, k: float = 0.5, h: float = 4.0) -> DataFrame:
    """symbol, n, cusum, alarms after each micro-batch: one number of state for each key."""

    def step(key, frames, state):
        s, n, alarms = state.get if state.exists else (0.0, 0, 0)
        for f in frames:
            for v in f.sort_values(["ts", "event_id"])["value"]:
                s = max(0.0, s - (v - mean) / sd - k)
                n, alarms = n + 1, alarms + (s > h)
        state.update((s, n, alarms))
        yield pd.DataFrame({"symbol": [key[0]], "n": [n], "cusum": [s], "alarms": [alarms]})

    return events.select(F.col("event_type").alias("symbol"), "ts", "event_id", "value").groupBy("symbol").applyInPandasWithState(
        step, "symbol string, n bigint, cusum double, alarms bigint", "s double, n bigint, alarms bigint", "update", "NoTimeout")


def run_to_table(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """The stream run over what is there, its rows in a table of the session."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
