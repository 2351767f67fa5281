"""State of runs from their status events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codegauge.functions.labels import IN_PROGRESS, TERMINAL
from codegauge.streaming.tables import with_event_time, write_batches

# When a run has timed out and what is then said.
TIMEOUT_MINUTES = 10
TIMED_OUT = "timed out"


def latest_status(events: DataFrame) -> DataFrame:
    """Status per run: the first terminal one, else the latest; batch or stream.

    Both parts are mergeable, so a run with very many events is pre-aggregated.
    """
    at = F.struct("ts", "status")
    ended = F.min(F.when(F.col("status").isin(*TERMINAL), at))
    tracked = events.groupBy("run_id").agg(F.coalesce(ended, F.max(at)).alias("state"))
    return tracked.select(
        "run_id", F.col("state.status").alias("status"), F.col("state.ts").alias("ts")
    )


def time_out_stale(runs: DataFrame, now: Column, minutes: int = TIMEOUT_MINUTES) -> DataFrame:
    """Runs still in progress after the time limit become failed."""
    limit = now - F.make_dt_interval(mins=F.lit(minutes))
    stale = F.col("status").isin(*IN_PROGRESS) & (F.col("created_at") < limit)
    return runs.withColumns(
        {
            "status": F.when(stale, "failed").otherwise(F.col("status")),
            "summary": F.when(stale, TIMED_OUT).otherwise(F.col("summary")),
        }
    )


def watch_runs(events: DataFrame, delay: str, minutes: int = TIMEOUT_MINUTES) -> DataFrame:
    """Stream of (run_id, status, summary, ts): terminal states as they come, or a time-out.

    Per run only the start time is kept; the events of a run are folded batch by
    batch, so a run with very many events needs no more memory than any other. A run that
    has ended is remembered for the time limit and then forgotten.
    """
    limit_ms = minutes * 60 * 1000
    done = -1
    columns = ["run_id", "status", "summary", "ts"]

    def follow(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        started = state.get[0] if state.exists else None

        def finish() -> None:
            state.update((done,))
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + limit_ms + 1)

        if state.hasTimedOut:
            if started == done:
                state.remove()
                return
            finish()
            at = pd.Timestamp(started + limit_ms, unit="ms")
            yield pd.DataFrame([(key[0], "failed", TIMED_OUT, at)], columns=columns)
            return
        if started == done:
            finish()
            return
        ended = None
        for batch in batches:
            micros = batch["ts"].to_numpy().astype("datetime64[us]").astype("int64").tolist()
            first_ms = min(micros) // 1000
            started = first_ms if started is None else min(started, first_ms)
            for seen in zip(micros, batch["status"].tolist(), strict=True):
                if seen[1] in TERMINAL and (ended is None or seen < ended):
                    ended = seen
        if ended is not None:
            finish()
            at = pd.Timestamp(ended[0], unit="us")
            yield pd.DataFrame([(key[0], ended[1], "", at)], columns=columns)
            return
        state.update((started,))
        state.setTimeoutTimestamp(max(started + limit_ms, state.getCurrentWatermarkMs() + 1))

    return (
        with_event_time(events, "ts", delay)
        .groupBy("run_id")
        .applyInPandasWithState(
            follow,
            "run_id long, status string, summary string, ts timestamp",
            "started long",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


def watch_to_table(events: DataFrame, folder: str, delay: str, minutes: int = TIMEOUT_MINUTES):
    """Starts the watch of ``watch_runs`` over batches: a run costs a row, not a call into Python.

    Terminal states and time-outs go to ``folder/out``. What is remembered of the runs is a table
    with one folder per batch: a batch groups its events with the rows that the batch before left,
    so a repeated batch gives the same rows again. Time-outs are judged at the end of each batch, by
    the latest time seen so far less ``delay``; events up to that time are late in later batches. A
    run that has ended is remembered for the time limit from then on.
    """
    limit = minutes * 60 * 1_000_000
    nothing = F.lit(None)

    def follow(batch: DataFrame, batch_id: int) -> DataFrame:
        spark = batch.sparkSession
        place = lambda name, k: f"{folder}/{name}/batch_id={k}"
        moment = F.col("ts").cast("timestamp")
        latest = batch.agg(F.unix_micros(F.max(moment) - F.expr(f"INTERVAL {delay}"))).first()[0]
        before = spark.read.parquet(place("watermark", batch_id - 1)).first()[0] if batch_id else None
        after = max((m for m in (latest, before) if m is not None), default=0)
        spark.createDataFrame([(after,)], "after long").coalesce(1).write.mode("overwrite").parquet(place("watermark", batch_id))

        at = F.unix_micros(moment)
        timely = batch if before is None else batch.where(at.isNull() | (at > before))
        ended = F.struct(at.isNull().alias("unknown"), at.alias("at"), "status")
        rows = timely.select(
            "run_id",
            at.alias("started"),
            nothing.cast("long").alias("until"),
            F.when(F.col("status").isin(*TERMINAL), ended).alias("ended"),
            F.lit(True).alias("seen"),
        )
        if before is not None:
            held = spark.read.parquet(place("runs", batch_id - 1))
            rows = rows.unionByName(
                held.where(F.col("until").isNull() | (F.col("until") >= before)).select(
                    "run_id", "started", "until", nothing.cast(rows.schema["ended"].dataType).alias("ended"), F.lit(False).alias("seen")
                )
            )
        runs = rows.groupBy("run_id").agg(
            F.min("started").alias("started"), F.max("until").alias("until"), F.min("ended").alias("ended"), F.max("seen").alias("seen")
        )
        known, due = F.col("until").isNotNull(), F.col("started") + limit
        finished = ~known & F.col("ended").isNotNull()
        timed_out = ~known & F.col("ended").isNull() & F.coalesce(due < after, F.lit(False))
        runs.select(
            "run_id",
            "started",
            F.when(finished | timed_out | (known & F.col("seen")), F.lit(after + limit)).otherwise(F.col("until")).alias("until"),
            F.when(finished, F.col("ended.status")).when(timed_out, "failed").alias("status"),
            F.when(finished, "").when(timed_out, TIMED_OUT).alias("summary"),
            F.timestamp_micros(F.when(finished, F.col("ended.at")).when(timed_out, due)).alias("ts"),
        ).write.mode("overwrite").parquet(place("runs", batch_id))
        return spark.read.parquet(place("runs", batch_id)).where("status IS NOT NULL").select("run_id", "status", "summary", "ts")

    return write_batches(events, f"{folder}/out", f"{folder}/checkpoint", follow)
