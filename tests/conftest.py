import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .appName("codegauge-tests")
        .config("spark.driver.memory", "6g")  # all tests share one JVM
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def analyze(spark):
    """Analyses (path, content) pairs; returns the analysed rows and issue rows per path."""
    from codegauge.operators import rules as R
    from codegauge.operators.catalog import DEFAULT_RULES

    def run(files, rules=DEFAULT_RULES):
        rows = [(1, i, p, c) for i, (p, c) in enumerate(files)]
        frame = spark.createDataFrame(rows, "run_id long, entry_index int, path string, content string")
        analyzed = R.analyze_files(frame, rules)
        by_path = {r["path"]: r for r in analyzed.collect()}
        issues = {p: [] for p, _ in files}
        ordered = R.issues_of(analyzed, rules).orderBy("path", "rule_order", "pattern_order", "match_index")
        for r in ordered.collect():
            issues[r["path"]].append(r)
        return by_path, issues

    return run
