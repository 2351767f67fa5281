"""The whole analysis as a job: files in, stored tables out."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegauge.operators.catalog import DEFAULT_RULES, Rule
from codegauge.operators.rules import analyze_files, issues_of
from codegauge.operators.scoring import run_summary
from codegauge.sources.results import stable_id
from codegauge.sources.store import Store

BUCKETS = 64
ANALYZED, ISSUES, METRICS, RUNS = "analyzed", "analysis_issues", "file_metrics", "run_summary"


def analyze_to_store(
    files: DataFrame, folder: str, rules: Sequence[Rule] = DEFAULT_RULES, buckets: int = BUCKETS
) -> dict[str, DataFrame]:
    """Analyses once, writes the compact rows, and adds the tables derived from them to the store.

    The written rows cut the lineage: issues, metrics and summaries read a few columns of
    them and never the texts again. The tables are partitioned by a bucket of the run and all
    four change in one commit. Runs that the store does not hold are added; a run that it holds
    is replaced as a whole, so repeating a job changes nothing, and the runs of other jobs, also
    of those that commit meanwhile, stay as they are.
    """
    spark = files.sparkSession
    store = Store(spark, folder)
    staged = f"{store.root}/staged/{uuid.uuid4().hex}"
    analyze_files(files, rules).write.parquet(staged)
    analyzed = spark.read.parquet(staged)
    tables = {
        ANALYZED: analyzed,
        ISSUES: stored_issues(analyzed, rules),
        METRICS: analyzed.drop("hits"),
        RUNS: run_summary(analyzed),
    }
    store.replace(tables, dict.fromkeys(tables, "run_id"), analyzed.select("run_id"), buckets)
    path = spark._jvm.org.apache.hadoop.fs.Path(staged)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return read_store(spark, folder)


def read_store(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All tables as one commit left them."""
    store = Store(spark, folder)
    held = store.manifest()
    return {n: store.read(n, held) for n in (ANALYZED, ISSUES, METRICS, RUNS)}


def stored_issues(analyzed: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Issue rows as they are stored, with a key that is the same on every run."""
    key = ("run_id", "path", "rule_order", "pattern_order", "match_index")
    rows = issues_of(analyzed, rules)
    return rows.select(stable_id(*key).alias("id"), *rows.columns)


def summarize_store(tables: dict[str, DataFrame]) -> DataFrame:
    """Check of a store: per run the stored issues against the summary."""
    stored = tables[ISSUES].groupBy("run_id").agg(F.count(F.lit(1)).alias("stored_issues"))
    return tables[RUNS].join(stored, "run_id", "left").select(
        "run_id", "total_issues", F.coalesce("stored_issues", F.lit(0)).alias("stored_issues")
    )
