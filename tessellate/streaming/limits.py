"""Stateful streams: request limits in windows anchored at a key's first request, and leases that run out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rate_limited(events: DataFrame, window_s: int = 60, limit: int = 120) -> DataFrame:
    """events (key long, ts timestamp, event_id long) to event_id, n (place in its window) and limited."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begin, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        places = []
        for t in rows["ts"]:
            at = int(t.timestamp() * 1_000_000)
            if begin is None or at - begin > window_s * 1_000_000:
                begin, n = at, 0
            n += 1
            places.append(n)
        state.update((begin, n))
        yield pd.DataFrame({"key": key[0], "event_id": rows["event_id"], "n": places, "limited": [p > limit for p in places]})

    return events.groupBy("key").applyInPandasWithState(step, "key long, event_id long, n long, limited boolean", "begin long, n long", "append", GroupStateTimeout.NoTimeout)


def expired_leases(beats: DataFrame, lease: str = "2 minutes") -> DataFrame:
    """Heartbeats (key, ts) to the keys whose lease ran out: a session ends when no beat came within the lease."""
    from pyspark.sql import functions as F

    session = F.session_window("ts", lease)
    return beats.withWatermark("ts", lease).groupBy("key", session).agg(F.count("*").alias("beats")).select("key", F.col("session_window.end").alias("expired_at"), "beats")
