"""Streaming forms of capture, wear, replies and silence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def new_messages(stream: DataFrame, delay: str = "12 hours") -> DataFrame:
    """Messages (session_id, message_hash, ts) once each within the watermark, which also bounds the state."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session_id", "message_hash"])


def wear(stream: DataFrame, tau: float = 6 * 3600.0, delay: str = "1 hour") -> DataFrame:
    """Raisings of items (item, ts) summed by hour with their wear at the hour's end."""
    hours = F.window("ts", "1 hour")
    age = F.unix_micros(F.col("hour.end")) / 1e6 - F.unix_micros("ts") / 1e6
    timed = stream.withWatermark("ts", delay).withColumn("hour", hours)
    return timed.groupBy("hour", "item").agg(F.sum(F.exp(-age / tau)).alias("wear"), F.count(F.lit(1)).alias("raisings"))


def replies(outreach: DataFrame, messages: DataFrame, within: str = "12 hours") -> DataFrame:
    """Every outreach (id, user, sent) with each message (user, ts) in the time after it; null when none came.

    The outer rows appear once the watermark says that no message can come any more.
    """
    o = outreach.withWatermark("sent", within).alias("o")
    m = messages.withWatermark("ts", within).alias("m")
    near = (F.col("o.user") == F.col("m.user")) & (F.col("m.ts") > F.col("o.sent")) & (F.col("m.ts") < F.col("o.sent") + F.expr(f"interval {within}"))
    return o.join(m, near, "left_outer").select("o.id", "o.user", "o.sent", F.col("m.ts").alias("answered"))


def silences(stream: DataFrame, quiet_seconds: float = 6 * 3600.0, delay: str = "1 hour") -> DataFrame:
    """A row (user, since, at) when a user of a stream (user, ts) has been quiet for ``quiet_seconds`` of event time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"user": [key[0]], "since": [last], "at": [last + quiet_seconds]})
            return
        last = max([batch["t"].max() for batch in batches] + ([state.get[0]] if state.exists else []))
        state.update((float(last),))
        state.setTimeoutTimestamp(max(int((last + quiet_seconds) * 1000), state.getCurrentWatermarkMs() + 1))

    timed = stream.withWatermark("ts", delay).withColumn("t", F.unix_micros("ts") / 1e6)
    return timed.groupBy("user").applyInPandasWithState(step, "user string, since double, at double", "last double", "append", GroupStateTimeout.EventTimeTimeout)
