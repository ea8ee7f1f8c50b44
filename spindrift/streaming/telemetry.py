"""Structured Streaming versions of the emitters, the ledger, and route statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spindrift.functions.scores import LEARNING_RATE
from spindrift.sources.stores import at_least


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Event files as a stream; files_per_trigger is what keeps a burst from piling up."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tracked(events: DataFrame, level: str, request_id: str) -> DataFrame:
    """Events of the level and above, blank request ids filled from the context."""
    return at_least(events, level).withColumn("request_id", F.coalesce(F.nullif(F.trim("request_id"), F.lit("")), F.lit(request_id)))


def metered(records: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each key once within the delay; state older than it is dropped."""
    return records.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["key"])


def counts_by_window(events: DataFrame, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Events and values by type and tumbling window (beyond the plain emitters)."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


ROUTE_STATE = "samples long, success double, useful double, latency double"


def route_statistics(attempts: DataFrame) -> DataFrame:
    """Moving averages of each route (route, ts, success, useful, latency_ms), carried over batches; route stays the key of the state."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, success, useful, latency = state.get if state.exists else (0, 0.60, 0.60, 700.0)
        rows = pd.concat(list(frames)).sort_values("ts")
        for ok, good, ms in zip(rows["success"], rows["useful"], rows["latency_ms"], strict=True):
            keep = 1 - LEARNING_RATE
            n, success, useful, latency = n + 1, success * keep + LEARNING_RATE * bool(ok), useful * keep + LEARNING_RATE * bool(good), latency * keep + LEARNING_RATE * max(1, ms)
        state.update((n, success, useful, latency))
        yield pd.DataFrame([(key[0], n, success, useful, latency)], columns=["route", "samples", "success", "useful", "latency"])

    return attempts.groupBy("route").applyInPandasWithState(update, f"route string, {ROUTE_STATE}", ROUTE_STATE, "update", GroupStateTimeout.NoTimeout)
