"""Streams of events: windows over event time, duplicates and late data, and detectors that keep state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream(spark: SparkSession, folder: str, schema: Any, files: int = 1) -> DataFrame:
    """Event files as a stream; ts as a timestamp, which watermarks need."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, every: Column, key: str = "event_type") -> DataFrame:
    """Count, mean and extremes of value for each key and window (F.window or F.session_window)."""
    grouped = events.groupBy(every.alias("w"), key).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("greatest"))
    return grouped.select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n", "mean", "least", "greatest")


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    events = events.withWatermark("ts", late) if late else events
    return windowed(events, F.window("ts", width))


def sliding(events: DataFrame, width: str = "6 hours", step: str = "2 hours", late: str | None = None) -> DataFrame:
    events = events.withWatermark("ts", late) if late else events
    return windowed(events, F.window("ts", width, step))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None, key: str = "user_id") -> DataFrame:
    events = events.withWatermark("ts", late) if late else events
    return windowed(events, F.session_window("ts", gap), key)


def deduplicate(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def _stateful(events: DataFrame, step, state: str) -> DataFrame:
    """A detector that keeps a small state for each series; step(pdf, state or None) gives (scores, state)."""

    def run(key: tuple[str], batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("idx")
        scores, new = step(pdf, kept.get if kept.exists else None)
        kept.update(new)
        yield pd.DataFrame({"series_id": key[0], "idx": pdf["idx"], "score": scores})

    return events.groupBy("series_id").applyInPandasWithState(run, "series_id string, idx long, score double", state, "append", GroupStateTimeout.NoTimeout)


def ema_residual(points: DataFrame, gamma: float = 0.99) -> DataFrame:
    """Squared distance to an exponential moving mean, which each point then moves."""

    def step(pdf: pd.DataFrame, state: tuple | None) -> tuple[list[float], tuple]:
        mean = state[0] if state else float(pdf["value"].iloc[0])
        out = []
        for v in pdf["value"]:
            out.append((v - mean) ** 2)
            mean += (1 - gamma) * (v - mean)
        return out, (mean,)

    return _stateful(points, step, "mean double")


def left_profile(points: DataFrame, width: int = 24, keep: int = 2_000) -> DataFrame:
    """Distance of the window that ends at each point to the nearest earlier one among the last ``keep`` values."""

    def step(pdf: pd.DataFrame, state: tuple | None) -> tuple[list[float], tuple]:
        past, new = (list(state[0]) if state else []), pdf["value"].tolist()
        both = np.array(past + new, float)
        if len(both) < width:
            return [0.0] * len(new), (both.tolist(),)
        w = np.lib.stride_tricks.sliding_window_view(both, width)
        std = w.std(axis=1, keepdims=True)
        z = np.where(std < 1e-12, 0, (w - w.mean(axis=1, keepdims=True)) / np.where(std < 1e-12, 1, std))
        out, zone = [], -(-width // 4)
        for at in range(len(past), len(both)):
            i = at - width + 1
            out.append(float(np.sqrt(np.maximum(((z[: i - zone] - z[i]) ** 2).sum(axis=1), 0)).min()) if i - zone > 0 else 0.0)
        return out, (both[-keep:].tolist(),)

    return _stateful(points, step, "past array<double>")
