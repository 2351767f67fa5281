"""Continuous analysis of arriving files and submissions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from codegauge.functions.text import round2, run_summary_text
from codegauge.operators.catalog import DEFAULT_RULES, Rule
from codegauge.operators.joins import COMMIT_KEY
from codegauge.operators.rules import analyze_files, issues_of
from codegauge.streaming.tables import with_event_time, write_batches

# What the summary of a run says whose analysis raised, and how much of the message is kept.
FAILED = "Analysis failed: "
MESSAGE_LENGTH = 1000


def analyze_stream(
    files: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES
) -> DataFrame:
    """The batch analysis on a stream: it is stateless, so it is the same plan."""
    return analyze_files(files, rules)


def check_rules(spark: SparkSession, rules: Sequence[Rule]) -> None:
    """Raises where a rule's own pattern is broken, so that no run is blamed for it."""
    patterns = [p.regex() for r in rules for p in r.patterns]
    if patterns:
        spark.range(1).select(*[F.regexp_count(F.lit(""), F.lit(p)).alias(f"p{k}") for k, p in enumerate(patterns)]).collect()


def failing_runs(
    batch: DataFrame, rules: Sequence[Rule], prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows
) -> list[tuple]:
    """(run_id, message) of the runs of a batch whose preparation or analysis raises.

    The batch is halved by a hash of the run until each part either passes or holds one run.
    Before the first run is blamed, a harmless file is analysed: where that fails too, the fault is
    the job's or the cluster's, and it is raised.
    """
    found: list[tuple] = []

    def settle(part: DataFrame, depth: int) -> None:
        try:
            analyze_files(prepare(part).where(F.col("content").isNotNull()), rules).write.format("noop").mode("overwrite").save()
        except Exception as failure:  # noqa: BLE001 - whatever the analysis of these files raises
            runs = part.select("run_id").distinct().limit(2).collect()
            if len(runs) > 1:
                half = F.pmod(F.xxhash64("run_id", F.lit(depth)), F.lit(2)) == 0
                settle(part.where(half), depth + 1)
                settle(part.where(~half), depth + 1)
                return
            if not found:
                harmless = part.sparkSession.range(1).select(
                    F.lit(None).cast(part.schema["run_id"].dataType).alias("run_id"), F.lit("a.txt").alias("path"), F.lit("").alias("content")
                )
                analyze_files(harmless, rules).write.format("noop").mode("overwrite").save()
            if runs:
                message = str(failure).strip().splitlines()
                found.append((runs[0]["run_id"], (message[0] if message else type(failure).__name__)[:MESSAGE_LENGTH]))

    settle(batch, 0)
    return found


def start_analysis(
    files: DataFrame,
    out: str,
    checkpoint: str,
    rules: Sequence[Rule] = DEFAULT_RULES,
    interval: str | None = None,
    prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows,
):
    """Analyses arriving files; writes issues and what each micro-batch adds to its runs.

    ``prepare`` makes files (run_id, path, content) of what arrives, such as texts of stored
    bytes. It runs with the analysis, so that a run it raises for fails alone; a step of the
    stream itself that raises fails the whole micro-batch.

    The analysed rows of a batch are written once; issues and the runs' parts are derived
    from the written rows. Files without content could not be read: they count as failed
    and the others of their run are analysed. Where the analysis of a batch raises, its failing
    runs are found and written as failed with the message; the others are analysed, and later
    batches go on. What fails for every run alike (a broken rule, a full disk, an unreadable
    source) fails the micro-batch, which the stream then repeats as a whole, replacing its
    folders. ``run_states`` gives one state per run over all batches.
    """
    checked: list[bool] = []

    def analyze(batch: DataFrame, batch_id: int) -> DataFrame:
        spark = batch.sparkSession
        if not checked:
            check_rules(spark, rules)
            checked.append(True)
        analyzed_at = f"{out}/analyzed/batch_id={batch_id}"

        def write(rows: DataFrame) -> None:
            analyze_files(prepare(rows).where(F.col("content").isNotNull()), rules).write.mode("overwrite").parquet(analyzed_at)

        failed: list[tuple] = []
        try:
            write(batch)
        except Exception:
            failed = failing_runs(batch, rules, prepare)
            ids = [r for r, _ in failed if r is not None]
            keep = ~F.coalesce(F.col("run_id").isin(ids), F.lit(False))
            if len(ids) < len(failed):
                keep &= F.col("run_id").isNotNull()
            batch = batch.where(keep)
            write(batch)
        analyzed = spark.read.parquet(analyzed_at)
        issues_of(analyzed, rules).write.mode("overwrite").parquet(f"{out}/issues/batch_id={batch_id}")
        none = F.lit(None)
        done = analyzed.select("run_id", F.lit(0).alias("failed"), "score", "total_issues", none.cast("string").alias("error"))
        lost = prepare(batch).where(F.col("content").isNull()).select(
            "run_id", F.lit(1).alias("failed"), none.cast("int").alias("score"), F.lit(0).alias("total_issues"), none.cast("string").alias("error")
        )
        rows = done.unionByName(lost)
        if failed:
            raised = spark.createDataFrame(failed, StructType([batch.schema["run_id"], StructField("error", StringType())]))
            rows = rows.unionByName(
                raised.select("run_id", F.lit(0).alias("failed"), none.cast("int").alias("score"), F.lit(0).alias("total_issues"), "error")
            )
        return rows.groupBy("run_id").agg(
            F.count("score").alias("files"),
            F.sum("score").cast("long").alias("score_sum"),
            F.sum("total_issues").cast("long").alias("issues"),
            F.sum("failed").cast("long").alias("failed"),
            F.min("error").alias("error"),
        )

    return write_batches(files, f"{out}/states", checkpoint, analyze, interval=interval)


def run_states(spark: SparkSession, out: str) -> DataFrame:
    """One row per run over all micro-batches: status, files, issues, mean score and summary.

    The parts that the batches wrote (a row per run and batch) are summed, so a run whose
    files arrive in many batches has the same result as one that arrives at once. A run with
    a file that could not be read has failed, and so has one whose analysis raised in any batch;
    its summary is then the message.
    """
    parts = spark.read.option("mergeSchema", "true").parquet(f"{out}/states")
    error = F.min("error") if "error" in parts.columns else F.lit(None).cast("string")
    runs = parts.groupBy("run_id").agg(
        F.sum("files").cast("int").alias("files_analyzed"),
        F.sum("issues").cast("long").alias("total_issues"),
        round2(F.sum("score_sum") / F.nullif(F.sum("files"), F.lit(0))).cast("decimal(5,2)").alias("average_score"),
        F.sum("failed").alias("failed"),
        error.alias("error"),
    )
    text = run_summary_text(F.col("files_analyzed"), F.col("average_score"), F.col("total_issues"))
    lost = F.concat(F.col("failed").cast("string"), F.lit(" files could not be read"))
    unread = F.col("failed") > 0
    raised = F.col("error").isNotNull()
    return runs.select(
        "run_id",
        F.when(raised | unread, "failed").otherwise("completed").alias("status"),
        "files_analyzed",
        "total_issues",
        F.coalesce("average_score", F.lit(0)).cast("decimal(5,2)").alias("average_score"),
        F.when(raised, F.concat(F.lit(FAILED), "error")).when(unread, lost).otherwise(text).alias("summary"),
    )


def new_submissions(
    spark: SparkSession, submissions: DataFrame, history: DataFrame, delay: str, out: str
):
    """Submissions of a stream without repeats, and the batch step that also drops known ones.

    Repeats that arrive within the delay are dropped by the stream state; older
    ones by an anti join with the history and with what was written before.
    """
    key = list(COMMIT_KEY)
    timed = with_event_time(submissions, "created_at", delay)
    fresh = timed.dropDuplicatesWithinWatermark(key)

    def unknown(batch: DataFrame, batch_id: int) -> DataFrame:
        left = batch.join(history.select(*key), key, "left_anti")
        if batch_id > 0:
            earlier = spark.read.parquet(out).where(F.col("batch_id") < batch_id)
            left = left.join(earlier.select(*key), key, "left_anti")
        return left

    return fresh, unknown
