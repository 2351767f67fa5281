"""Request limits per client over stored requests."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codegauge.operators.ordered import sliding_count

# The two limits, and when an idle client is forgotten.
PER_MINUTE, MINUTE = 60, 60
PER_HOUR, HOUR = 1000, 3600
IDLE_SECONDS = 3600
UNKNOWN_CLIENT = "unknown"


def client_key(ip: Column, user_id: Column) -> Column:
    """The address, or address and user where the user is known."""
    address = F.coalesce(ip, F.lit(UNKNOWN_CLIENT))
    user = F.nullif(user_id.cast("string"), F.lit(""))
    return F.concat_ws(":user:", address, user)


def over_limit(
    requests: DataFrame, limit: int = PER_MINUTE, seconds: int = MINUTE, time: str = "ts"
) -> DataFrame:
    """Requests made when the client already had ``limit`` others in the window."""
    counted = sliding_count(requests, "client_id", time, seconds)
    return counted.where(F.col("n") > limit)


def idle_clients(requests: DataFrame, now: Column, seconds: int = IDLE_SECONDS) -> DataFrame:
    """Clients whose last admitted request is longer ago than the idle time.

    Without a column ``admitted`` all requests count as admitted.
    """
    if "admitted" in requests.columns:
        requests = requests.where("admitted")
    last = requests.groupBy("client_id").agg(F.max("ts").alias("last_request"))
    return last.where(F.col("last_request") < now - F.make_dt_interval(secs=F.lit(float(seconds))))


def admission(
    requests: DataFrame,
    limit: int = PER_MINUTE,
    seconds: int = MINUTE,
    hour_limit: int | None = None,
    tie: str = "event_id",
) -> DataFrame:
    """Adds ``admitted``: only admitted requests count against the limit.

    A request is refused if ``limit`` admitted ones lie in the window before it
    (or ``hour_limit`` in the last hour, if given). Whether a request is admitted
    depends on the ones before it, so the order matters, but only in busy times:
    where even all requests of a window stay within the limit, each of them is
    admitted. Those are decided by a count. The rest, with the window before it,
    falls into stretches that are further apart than the window, and every
    stretch is decided in order, on its own, with a bounded memory.
    """
    windows = [(limit, seconds)] + ([(hour_limit, HOUR)] if hour_limit else [])
    reach = max(w for _, w in windows)
    columns = requests.columns
    counted = requests
    for i, (_, w) in enumerate(windows):
        counted = sliding_count(counted, "client_id", "ts", w).withColumnRenamed("n", f"__n{i}")
    busy = F.lit(False)
    for i, (most, _) in enumerate(windows):
        busy = busy | (F.col(f"__n{i}") > most)
    marked = counted.select(
        *columns, busy.alias("__busy"), F.unix_micros(F.col("ts").cast("timestamp")).alias("__t")
    )
    active = _near_busy(marked, reach)
    placed = _stretches(active.where("__active"), reach)
    decided = _decide(placed, windows, tie)
    calm = active.where(~F.col("__active")).select(*columns, F.lit(True).alias("admitted"))
    return calm.unionByName(decided.select(*columns, "admitted"))


def _near_busy(marked: DataFrame, seconds: int, chunk_windows: int = 10) -> DataFrame:
    """Marks requests that are busy or have a busy one within the window after them."""
    width = seconds * 1_000_000
    span = width * chunk_windows
    own = F.floor(F.col("__t") / span)
    back = F.floor((F.col("__t") - width) / span)
    spread = marked.select("*", own.alias("__own"), F.explode(F.sequence(back, own)).alias("__chunk"))
    ahead = Window.partitionBy("client_id", "__chunk").orderBy("__t").rangeBetween(0, width)
    flagged = spread.withColumn("__active", F.max("__busy").over(ahead))
    return flagged.where(F.col("__own") == F.col("__chunk")).drop("__own", "__chunk")


def _stretches(active: DataFrame, seconds: int, chunk_windows: int = 10) -> DataFrame:
    """Start time of the stretch each request belongs to; stretches are cut at long gaps."""
    width = seconds * 1_000_000
    cut = active.withColumn("__chunk", F.floor(F.col("__t") / (width * chunk_windows)))
    inside = Window.partitionBy("client_id", "__chunk").orderBy("__t")
    ends = cut.groupBy("client_id", "__chunk").agg(F.max("__t").alias("__last"))
    along = Window.partitionBy("client_id").orderBy("__chunk")
    before = ends.select("client_id", "__chunk", F.lag("__last").over(along).alias("__carried"))
    linked = cut.join(before, ["client_id", "__chunk"])
    previous = F.coalesce(F.lag("__t").over(inside), F.col("__carried"))
    starts = linked.withColumn("__previous", previous).withColumn(
        "__start",
        F.when(
            F.col("__previous").isNull() | (F.col("__t") - F.col("__previous") > width), F.col("__t")
        ),
    )
    local = starts.withColumn("__local", F.max("__start").over(inside))
    latest = starts.groupBy("client_id", "__chunk").agg(F.max("__start").alias("__latest"))
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = latest.select(
        "client_id", "__chunk", F.max("__latest").over(earlier).alias("__from")
    )
    joined = local.join(carried, ["client_id", "__chunk"])
    return joined.withColumn("__stretch", F.coalesce("__local", "__from")).drop(
        "__chunk", "__carried", "__previous", "__start", "__local", "__from"
    )


def _decide(placed: DataFrame, windows: list[tuple[int, int]], tie: str) -> DataFrame:
    """Walks each stretch in order, keeping the admitted times of the longest window."""
    limits = [(most, w * 1_000_000) for most, w in windows]
    longest = max(w for _, w in limits)
    schema = placed.withColumn("admitted", F.lit(True)).schema

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, admitted = None, deque()
        for batch in batches:
            result = []
            keys = zip(batch["client_id"], batch["__stretch"], batch["__t"], strict=True)
            for client, stretch, now in keys:
                if (client, stretch) != current:
                    current, admitted = (client, stretch), deque()
                while admitted and now - admitted[0] > longest:
                    admitted.popleft()
                ok = all(_recent(admitted, now - w, most) < most for most, w in limits)
                if ok:
                    admitted.append(now)
                result.append(ok)
            yield batch.assign(admitted=result)

    together = placed.repartition("client_id", "__stretch").sortWithinPartitions(
        "client_id", "__stretch", "__t", tie
    )
    return together.mapInPandas(walk, schema)


def _recent(admitted: deque, since: int, most: int) -> int:
    """How many of the newest admitted times are not before ``since``, counted up to ``most``."""
    if len(admitted) >= most and admitted[-most] >= since:
        return most
    return min(most - 1, len(admitted))
