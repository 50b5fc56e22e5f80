"""Streams of ledger rows: exactly-once hashes, windows, and stateful rapid-activity flags."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

LATE = "48 hours"
HISTORY = 1000


def timed(stream: DataFrame) -> DataFrame:
    return stream.withColumn("event_time", F.timestamp_seconds("timestamp")).withWatermark("event_time", LATE)


def unique(stream: DataFrame) -> DataFrame:
    """Each hash once within the watermark."""
    return timed(stream).dropDuplicatesWithinWatermark(["hash"])


def hourly(stream: DataFrame) -> DataFrame:
    return timed(stream).groupBy(F.window("event_time", "1 hour")).agg(F.count("*").alias("n"), F.sum("value_eth").alias("volume"))


def sessions(stream: DataFrame, gap: str = "1 hour") -> DataFrame:
    """Sessions of rapid activity of each sender."""
    return timed(stream).groupBy(F.session_window("event_time", gap), "from_addr").agg(F.count("*").alias("n"), F.sum("value_eth").alias("volume"))


def rapid(stream: DataFrame) -> DataFrame:
    """Each batch's rows of a sender against its last ``HISTORY`` times: more than two within an hour."""

    def step(key, frames, state):
        times = list(state.get[0]) if state.exists else []
        for pdf in frames:
            out = []
            for r in pdf.sort_values(["timestamp", "hash"]).itertuples(index=False):
                times = (times + [int(r.timestamp)])[-HISTORY:]
                out.append((r.hash, key[0], int(r.timestamp), sum(r.timestamp - t < 3600 for t in times[-50:]) > 2))
            yield pd.DataFrame(out, columns=["hash", "from_addr", "timestamp", "is_rapid"])
        state.update((times,))

    rows = stream.select("hash", "from_addr", "timestamp")
    return rows.groupBy("from_addr").applyInPandasWithState(step, "hash string, from_addr string, timestamp long, is_rapid boolean", "times array<long>", "append", GroupStateTimeout.NoTimeout)
