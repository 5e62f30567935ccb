"""First-request-anchored rate limit as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rate_limit_stream(requests: DataFrame, key: str, window_seconds: int, limit: int) -> DataFrame:
    """(key, t microseconds, ts, request_id) to numbered decisions.

    Requests must arrive in time order across micro-batches; inside one they are sorted.
    State is the window start and its count, and goes once the watermark (the latest time less a window) has passed the window's end: a
    request that comes after it starts a window anyway. Requests older than the watermark are dropped.
    """
    window = window_seconds * 1_000_000
    kind = dict(requests.dtypes)[key]

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["t", "request_id"])
        numbers = []
        for t in rows["t"]:
            if start is None or t - start >= window:
                start, count = int(t), 0
            count += 1
            numbers.append(count)
        state.update((start, count))
        # Never behind the watermark, which the state would refuse.
        state.setTimeoutTimestamp(max((start + window) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(
            {"request_id": rows["request_id"], key: group[0], "count": numbers, "allowed": [n <= limit for n in numbers]}
        )

    watched = requests.withWatermark("ts", f"{window_seconds} seconds")
    return watched.groupBy(key).applyInPandasWithState(
        step,
        f"request_id long, {key} {kind}, count long, allowed boolean",
        "start long, count long",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def as_requests(events: DataFrame, key: str, ts: str, request_id: str) -> DataFrame:
    at = F.col(ts).cast("timestamp")
    return events.select(F.col(key), F.unix_micros(at).alias("t"), at.alias("ts"), F.col(request_id).alias("request_id"))
