"""Usage events as streams: windowed counts with late data bounded, and a limiter with state per user."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from citemill.operators.limits import SlidingWindow
from citemill.sources import schemas


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.USAGE).json(path)


def write_usage(events: DataFrame, path: str, checkpoint: str):
    """Answers and refusals appended as JSON lines, exactly once."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def per_window(events: DataFrame, length: str = "1 hour", late: str | None = "2 hours") -> DataFrame:
    """events(ts, event_type, user_id, value) -> counts per tumbling window and type; works on streams and tables.

    A stream keeps a window open until ``late`` after its end.
    """
    timed = events.withWatermark("ts", late) if late and events.isStreaming else events
    return timed.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
        F.col("window.start").alias("start"), "event_type", "n", "total"
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "2 hours") -> DataFrame:
    """Sessions of a user: runs of events with less than ``gap`` between them."""
    timed = events.withWatermark("ts", late) if late and events.isStreaming else events
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(
        "user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n"
    )


def limit_stream(events: DataFrame, limit: int, window: float, late: str = "1 minute") -> DataFrame:
    """events(user_id, event_id, ts) -> (user_id, event_id, t, wait) with the sliding window's times as state.

    State is at most ``limit`` times a user and goes when the window has passed the watermark. A
    batch's events are folded in order of time; the limiter doesn't look back over older batches.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        limiter = SlidingWindow(limit, window, held)
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        waits = [limiter.check(t) for t in rows["t"]]
        state.update((list(limiter.held),))
        state.setTimeoutTimestamp(int(max(rows["t"].max(), state.getCurrentWatermarkMs() / 1000) * 1000 + window * 1000 + 1))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "t": rows["t"].to_numpy(), "wait": waits})

    timed = events.withWatermark("ts", late).select("user_id", "event_id", "ts", (F.unix_micros("ts") / 1e6).alias("t"))
    return timed.groupBy("user_id").applyInPandasWithState(
        step, "user_id bigint, event_id bigint, t double, wait double", "held array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )
