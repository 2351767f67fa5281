"""The physical plans: scans, shuffles and what is evaluated how often."""

import re

import pytest
from pyspark.sql import functions as F

from codegauge.operators import joins as J
from codegauge.operators import reports as P
from codegauge.operators import rules as R
from codegauge.operators import scoring as S
from codegauge.operators import selection as B
from codegauge.sources import snapshots as N
from codegauge.sources.results import export_results
from suite import ingest, streams
from suite.mapping import mapped


def plan_of(frame):
    plan = frame._jdf.queryExecution().executedPlan()
    return plan.toString()


def exchanges(plan):
    return len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|Round|Single)", plan))


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return mapped(spark, sf_dir, "document_files")


def test_analysis_needs_no_shuffle_and_no_join(documents):
    analyzed = R.analyze_files(documents)
    for frame in (analyzed, R.issues_of(analyzed), export_results(analyzed)):
        plan = plan_of(frame)
        assert exchanges(plan) == 0 and "Join" not in plan


def test_run_summary_is_one_preaggregated_shuffle(documents):
    plan = plan_of(S.run_summary(R.analyze_files(documents)))
    assert exchanges(plan) == 1 and "partial_count" in plan and "partial_sum" in plan


def test_filters_on_results_do_not_repeat_the_analysis(documents):
    analyzed = R.analyze_files(documents)
    once = plan_of(analyzed).count("mysqli_query")
    assert once > 0
    assert plan_of(analyzed.where("score < 50 AND critical_count > 0")).count("mysqli_query") == once
    assert plan_of(R.issues_of(analyzed).where("severity = 'critical'")).count("mysqli_query") == once


def test_filters_on_files_reach_the_scan(documents):
    plan = plan_of(R.analyze_files(documents).where("run_id = 'src1'"))
    assert re.search(r"PushedFilters: \[.*EqualTo\(source,src1\)", plan)


def test_only_needed_columns_are_read(spark, sf_dir):
    plan = plan_of(P.issue_distribution(mapped(spark, sf_dir, "issues")))
    assert re.search(r"ReadSchema: struct<l_linenumber:int,l_returnflag:string>", plan)
    plan = plan_of(P.run_totals(mapped(spark, sf_dir, "runs")))
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint>", plan)


def test_unfinished_metrics_are_pruned(documents):
    """Counting long lines does not run the other rules' patterns or the decision counter."""
    plan = plan_of(R.file_metrics(documents).select("path", "code_length"))
    assert "foreach" not in plan


def test_top_lists_are_cut_early(spark, sf_dir):
    runs = mapped(spark, sf_dir, "runs")
    assert "TakeOrderedAndProject" in plan_of(P.recent_runs(runs))
    assert "WindowGroupLimit" in plan_of(P.recent_runs_per(runs, "repository_id", 5))


def test_batch_validation_moves_no_contents(spark, documents):
    files = documents.select(F.floor(F.col("entry_index") / 50).alias("batch_id"), "entry_index", "path", "content")
    plan = plan_of(B.validate_batches(files, B.MAX_FILES, B.MAX_FILE_BYTES))
    shuffled = re.search(r"Exchange hashpartitioning.*?\n(.*)", plan).group(1)
    assert "content" not in shuffled


def test_no_line_of_a_file_is_shuffled(spark, documents):
    issues = R.issues_of(R.analyze_files(documents)).withColumnRenamed("line", "line_number")
    plan = plan_of(J.lines_with_issues(documents, issues))
    lines = re.search(r"Generate posexplode\(arrays_zip", plan)
    assert lines and "Exchange" not in plan[: lines.start()]


def test_texts_of_snapshots_are_shuffled_once(spark, documents):
    files = documents.selectExpr("run_id", "path", "entry_index", "content", "'low' AS quality_level", "1 AS function_count", "1 AS lines_of_code")
    plan = plan_of(N.pack_snapshots(files))
    below = [m.group(1) for m in re.finditer(r"Exchange hashpartitioning.*?\n(.*)", plan)]
    assert sum("entry#" in line or "content" in line for line in below) == 1 and len(below) == 2


def test_no_forced_broadcast(spark, sf_dir):
    """Without a small enough side the joins are ordinary shuffled joins."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        runs, repos = mapped(spark, sf_dir, "runs"), mapped(spark, sf_dir, "repositories")
        issues = mapped(spark, sf_dir, "issues")
        for frame in (
            J.list_runs(runs, repos),
            J.run_detail(runs, repos, issues),
            J.owned_issues(issues, runs, repos),
            P.folder_rollup(issues, issues),
            J.submission_decision(runs, runs),
        ):
            plan = plan_of(frame)
            assert "Broadcast" not in plan and "CartesianProduct" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_known_files_are_compared_in_given_partitions(spark, sf_dir):
    """One exchange of a given number of partitions, which are not merged, and rows compared after it only."""
    issues = mapped(spark, sf_dir, "issues")
    plan = plan_of(P.known_files(issues, issues))
    assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange hashpartitioning") == 1
    assert "REPARTITION_BY_NUM" in plan_of(mapped(spark, sf_dir, "code_files"))


def test_code_files_are_made_behind_the_shuffle(spark, sf_dir):
    """Orders and line items are dealt once, by order; neither statements nor texts are shuffled."""
    plan = plan_of(mapped(spark, sf_dir, "code_files"))
    assert plan.count("Exchange hashpartitioning") == 2 and "hashpartitioning(path" not in plan
    below = plan.split("Exchange hashpartitioning(l_orderkey")[1]
    assert "AS stmt" in plan and "AS stmt" not in below


def test_archives_are_packed_in_given_partitions(spark, sf_dir):
    """Partitions merged by their packed size would leave the packing to few tasks."""
    dealt = r"hashpartitioning\(archive#\d+, 8\), REPARTITION_BY_NUM"
    assert re.search(dealt, plan_of(ingest._archives(spark, sf_dir)))
    assert re.search(dealt, plan_of(ingest._stored_archives(mapped(spark, sf_dir, "document_files"))))


def test_pages_are_stored_by_many_tasks(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "shared_folder", lambda spark, name: str(tmp_path / name))
    rows = ingest.loose_file_scan(spark, sf_dir).count()
    written = list((tmp_path / "loose").rglob("part-*.txt"))
    assert len(written) == rows and len({f.name[:10] for f in written}) > 1


def test_a_part_of_a_stream_is_stored_by_many_tasks(spark, tmp_path):
    rows = spark.range(400).selectExpr("'r' AS run_id", "CAST(id AS STRING) AS path", "id % 2 AS part")
    stream = streams._stored_parts(rows, str(tmp_path / "files"), 2)
    assert stream.isStreaming and spark.read.parquet(str(tmp_path / "files")).count() == 400
    assert all(len(list((tmp_path / f"files/part={k}").glob("*.parquet"))) > 1 for k in (0, 1))
