"""Request limits on a stream of requests."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codegauge.operators.ratelimit import IDLE_SECONDS, MINUTE, PER_MINUTE
from codegauge.streaming.tables import with_event_time


def request_rates(
    requests: DataFrame, seconds: int = MINUTE, slide: int = 10, delay: str = "1 minute"
) -> DataFrame:
    """Requests per client and sliding window; batch or stream."""
    window = F.window("ts", f"{seconds} seconds", f"{slide} seconds")
    late = with_event_time(requests, "ts", delay) if requests.isStreaming else requests
    counted = late.groupBy("client_id", window.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        "client_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n"
    )


def admission_stream(
    requests: DataFrame,
    limit: int = PER_MINUTE,
    seconds: int = MINUTE,
    idle_seconds: int = IDLE_SECONDS,
    delay: str = "1 minute",
) -> DataFrame:
    """Stream of (client_id, event_id, ts, admitted); only admitted requests count.

    A client's state is at most ``limit`` times. It is dropped when the client
    has been idle. Requests of a micro-batch are taken in time order; the intake
    limit of the source bounds how many one client can have in it.
    """
    width, idle_ms = seconds * 1_000_000, idle_seconds * 1000

    def admit(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = deque(state.get[0] if state.exists else [])
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        micros = rows["ts"].to_numpy().astype("datetime64[us]").astype("int64").tolist()
        admitted = []
        for now in micros:
            while recent and now - recent[0] > width:
                recent.popleft()
            ok = len(recent) < limit
            if ok:
                recent.append(now)
            admitted.append(ok)
        state.update((list(recent),))
        last_ms = (recent[-1] if recent else micros[-1]) // 1000  # refused requests keep nobody busy
        state.setTimeoutTimestamp(max(last_ms + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(
            {"client_id": key[0], "event_id": rows["event_id"], "ts": rows["ts"], "admitted": admitted}
        )

    return (
        with_event_time(requests.select("client_id", "event_id", "ts"), "ts", delay)
        .groupBy("client_id")
        .applyInPandasWithState(
            admit,
            "client_id string, event_id long, ts timestamp, admitted boolean",
            "recent array<long>",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )
