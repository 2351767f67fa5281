"""Queries of the reports: history, distributions, histograms, folders, order in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegauge.functions.text import cutoff, duration_seconds, short_hash
from codegauge.operators import ordered as G
from codegauge.operators import reports as P
from suite.mapping import mapped, with_sql
from suite.registry import query

NOW = "1998-09-01 00:00:00"
_HOURS = 24 * 365
_CUT = f"TIMESTAMP '{NOW}' - INTERVAL {_HOURS} HOUR"


def _cut():
    return cutoff(F.lit(NOW).cast("timestamp_ntz"), _HOURS)


@query(
    "B12",
    sql=with_sql("issues", body="""
SELECT id, run_id, path, severity, category, message, rule_id FROM issues
WHERE severity = 'minor' AND (contains(lower(path), 'inden') OR contains(lower(message), 'inden')
  OR contains(lower(rule_id), 'inden'))"""),
)
def issue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.filter_issues(mapped(spark, sf_dir, "issues"), severity="Minor", search="INDEN")
    return found.select("id", "run_id", "path", "severity", "category", "message", "rule_id")


@query(
    "B14",
    sql=with_sql("issues", body="SELECT id, run_id, line_number FROM issues WHERE lower(path) = 'src/7/f3.php'"),
)
def issues_of_one_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.issues_of_file(mapped(spark, sf_dir, "issues"), "SRC/7/F3.php")
    return found.select("id", "run_id", "line_number")


@query("B15", sql=with_sql("runs", body="SELECT id, status FROM runs WHERE status IN ('completed', 'failed')"))
def finished_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.finished(mapped(spark, sf_dir, "runs")).select("id", "status")


@query(
    "E5", "J16", "J17",
    sql=with_sql("runs", body=f"""
SELECT count(*) AS total_runs, round(coalesce(avg(coalesce(date_diff('second', created_at, completed_at), 0)), 0), 6) AS average_duration,
  CAST(coalesce(sum(files_analyzed), 0) AS BIGINT) AS total_files,
  CAST(coalesce(sum(total_issues), 0) AS BIGINT) AS total_issues,
  round(coalesce(avg(CAST(average_score AS DOUBLE)), 0), 6) AS average_score
FROM runs WHERE created_at >= {_CUT} AND status = 'completed'"""),
)
def period_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = P.period_metrics(mapped(spark, sf_dir, "runs"), _cut())
    return metrics.withColumns(
        {c: F.round(c, 6) for c in ("average_duration", "average_score")}
    )


@query(
    "E6", "J17",
    sql=with_sql("issues", body=f"""
SELECT concat(severity, ':', category) AS key, count(*) AS n FROM issues
WHERE created_at >= {_CUT} GROUP BY 1"""),
)
def issue_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.issue_distribution(mapped(spark, sf_dir, "issues"), _cut())


@query(
    "E7",
    sql=with_sql("issues", body="""
SELECT concat(severity, ':', category) AS key, count(*) AS n FROM issues GROUP BY 1"""),
)
def merged_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two disjoint periods, merged."""
    issues = mapped(spark, sf_dir, "issues")
    return P.merge_counts(
        P.issue_distribution(issues.where(F.col("created_at") >= _cut())),
        P.issue_distribution(issues.where(F.col("created_at") < _cut())),
    )


@query("E8", sql=with_sql("runs", body="SELECT status, count(*) AS n FROM runs GROUP BY 1"))
def runs_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.count_by(mapped(spark, sf_dir, "runs"), "status")


@query(
    "E9",
    sql=with_sql("issues", body="SELECT lower(severity) AS severity, lower(category) AS category, count(*) AS n FROM issues GROUP BY 1, 2"),
)
def issues_by_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.count_by(mapped(spark, sf_dir, "issues"), "severity", "category")


@query(
    "E10", "E13", "E22", "E20",
    sql=with_sql("runs", body="""
SELECT count(*) AS analyses_processed, CAST(sum(files_analyzed) AS BIGINT) AS files_analyzed FROM runs"""),
)
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.run_totals(mapped(spark, sf_dir, "runs"))


_BOUNDS = "(VALUES (1), (2), (4), (8), (16), (32), (64), (128), ('inf'::DOUBLE)) b(le)"
_BUCKETS = f"""(SELECT event_type, CAST(le AS DOUBLE) AS le, count(*) FILTER (WHERE value <= le) AS n
  FROM requests, {_BOUNDS} GROUP BY 1, 2)"""


@query("E11", sql=with_sql("requests", body=f"SELECT event_type, CAST(le AS VARCHAR) AS le, n FROM {_BUCKETS}"))
def duration_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = P.duration_histogram(mapped(spark, sf_dir, "requests"), "value", ["event_type"])
    le = F.when(F.col("le") == float("inf"), "inf").otherwise(F.col("le").cast("string"))
    return buckets.withColumn("le", le)


@query(
    "E11", "E13",
    sql=with_sql("requests", body="""
SELECT event_type, count(*) AS count, round(sum(value), 4) AS sum FROM requests GROUP BY 1"""),
)
def duration_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = P.histogram_totals(mapped(spark, sf_dir, "requests"), "value", ["event_type"])
    return totals.withColumn("sum", F.round("sum", 4))


@query(
    "E12",
    sql=with_sql("requests", body=f"""
SELECT event_type, round(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (0.95 * total - below) / (n - below) END, 6) AS quantile
FROM (SELECT *, coalesce(lag(n) OVER w, 0) AS below, coalesce(lag(le) OVER w, 0) AS lo,
        max(n) OVER (PARTITION BY event_type) AS total
      FROM {_BUCKETS} WINDOW w AS (PARTITION BY event_type ORDER BY le))
WHERE n >= 0.95 * total
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY le) = 1"""),
)
def duration_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = P.duration_histogram(mapped(spark, sf_dir, "requests"), "value", ["event_type"])
    found = P.histogram_quantile(buckets, 0.95, ["event_type"])
    return found.withColumn("quantile", F.round("quantile", 6))


@query("E12", sql=with_sql("requests", body="SELECT round(quantile_cont(value, 0.95), 6) AS quantile FROM requests"))
def duration_p95_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.exact_quantile(mapped(spark, sf_dir, "requests"), "value")
    return found.withColumn("quantile", F.round("quantile", 6))


@query(
    "E14", "E13",
    sql=with_sql("issues", body="""
SELECT category, CAST(n AS BIGINT) AS n, round(n * 100.0 / sum(n) OVER (), 4) AS percent
FROM (SELECT category, count(*) AS n FROM issues GROUP BY 1)"""),
)
def category_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = P.count_by(mapped(spark, sf_dir, "issues"), "category")
    return P.share_of_total(counts, "category").withColumn("percent", F.col("percent").cast("double"))


@query(
    "E15",
    sql=with_sql("issues", body="""
SELECT CASE severity WHEN 'major' THEN 'high' WHEN 'minor' THEN 'medium' WHEN 'info' THEN 'low' ELSE severity END AS severity,
  count(*) AS n FROM issues GROUP BY 1"""),
)
def renamed_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.renamed_severity_totals(mapped(spark, sf_dir, "issues"))


@query(
    "E21",
    sql=with_sql("issues", body="""
SELECT s.severity, count(i.severity) AS n FROM (VALUES ('critical'), ('major'), ('minor'), ('info')) s(severity)
LEFT JOIN issues i ON i.severity = s.severity GROUP BY 1"""),
)
def severity_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.severity_counters(mapped(spark, sf_dir, "issues"))


@query(
    "E16",
    sql=with_sql("requests", body="""
SELECT round(avg(value), 6) AS mean FROM (SELECT value FROM requests ORDER BY ts DESC, event_id DESC LIMIT 100)"""),
)
def mean_of_last_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = P.mean_of_recent(mapped(spark, sf_dir, "requests"), "value", "ts", "event_id")
    return mean.withColumn("mean", F.round("mean", 6))


@query(
    "E17",
    sql=with_sql("requests", body="SELECT event_id, value FROM requests ORDER BY ts DESC, event_id DESC LIMIT 1000"),
)
def last_1000_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.recent_samples(mapped(spark, sf_dir, "requests"), "ts", "event_id").select("event_id", "value")


@query(
    "H1", "J15",
    sql=with_sql("runs", body="""
SELECT id, created_at, substring(head_commit_sha, 1, 8) AS head FROM runs ORDER BY created_at DESC, id DESC LIMIT 20"""),
)
def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.recent_runs(mapped(spark, sf_dir, "runs")).select(
        "id", "created_at", short_hash(F.col("head_commit_sha")).alias("head")
    )


@query(
    "H1", "G7",
    sql=with_sql("runs", body="""
SELECT repository_id, id, CAST(row_number() OVER w AS INT) AS recency FROM runs
WINDOW w AS (PARTITION BY repository_id ORDER BY created_at DESC, id DESC)
QUALIFY row_number() OVER w <= 5"""),
)
def recent_runs_per_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.recent_runs_per(mapped(spark, sf_dir, "runs"), "repository_id", 5).select(
        "repository_id", "id", "recency"
    )


@query("H3", sql=with_sql("requests", body="SELECT event_id, ts FROM requests ORDER BY ts, event_id LIMIT 1"))
def oldest_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.oldest(mapped(spark, sf_dir, "requests").select("event_id", "ts"), "ts", "event_id")


@query(
    "H4", "E20",
    sql=with_sql("runs", body="SELECT id, status FROM runs WHERE status = 'failed' ORDER BY id LIMIT 1"),
)
def first_failed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.first_match(mapped(spark, sf_dir, "runs"), F.col("status") == "failed").select("id", "status")


@query("E20", sql="SELECT count(*) AS n FROM customer")
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.row_count(mapped(spark, sf_dir, "repositories"))


@query(
    "I2",
    sql=with_sql("issues", "code_files", body="""
SELECT run_id, path FROM issues WHERE path <> '' UNION SELECT run_id, path FROM code_files WHERE path <> ''"""),
)
def known_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.known_files(mapped(spark, sf_dir, "issues"), mapped(spark, sf_dir, "code_files"))


@query("I3", sql=with_sql("issues", body="SELECT DISTINCT category FROM issues WHERE category <> ''"))
def distinct_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.categories(mapped(spark, sf_dir, "issues"))


_TREE = """
SELECT run_id, array_to_string(p[1:d], '/') AS path,
  CASE WHEN d > 0 THEN array_to_string(p[1:d-1], '/') END AS parent_path,
  CASE WHEN d = 0 THEN 'root' ELSE p[d] END AS name, CAST(d AS INT) AS depth,
  CASE WHEN d = len(p) THEN 'file' ELSE 'folder' END AS type, CAST(sum(n) AS BIGINT) AS issue_count,
  CASE min(r) WHEN 1 THEN 'critical' WHEN 2 THEN 'major' WHEN 3 THEN 'minor' ELSE 'info' END AS max_severity
FROM (SELECT run_id, string_split(path, '/') AS p, count(*) AS n,
        min(CASE severity WHEN 'critical' THEN 1 WHEN 'major' THEN 2 WHEN 'minor' THEN 3 ELSE 4 END) AS r
      FROM issues GROUP BY 1, 2) x, unnest(range(0, len(p) + 1)) AS t(d)
GROUP BY 1, 2, 3, 4, 5, 6"""


@query("E18", "E19", "F9", "J18", sql=with_sql("issues", body=_TREE))
def folder_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = mapped(spark, sf_dir, "issues")
    return P.folder_rollup(issues, issues)


@query(
    "H2", "E18",
    sql=with_sql("issues", body=f"""
SELECT *, row_number() OVER (PARTITION BY run_id, parent_path ORDER BY type <> 'folder', name) AS position,
  row_number() OVER (PARTITION BY run_id ORDER BY list_transform(range(1, depth + 1), lambda k:
    CASE WHEN k = depth AND type = 'file' THEN 'b' ELSE 'a' END || string_split(path, '/')[k])) AS tree_position
FROM ({_TREE}) t"""),
)
def folder_tree_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = mapped(spark, sf_dir, "issues")
    return P.folder_tree(issues, issues)


@query(
    "G1", "G2",
    sql=with_sql("issues", body="""
SELECT run_id, path, id, row_number() OVER w AS position, count(*) OVER (PARTITION BY run_id, path) AS group_size,
  coalesce(lead(id) OVER w, first_value(id) OVER w) AS next_id,
  coalesce(lag(id) OVER w, last_value(id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS previous_id
FROM issues WINDOW w AS (PARTITION BY run_id, path ORDER BY line_number, id)"""),
)
def issue_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = mapped(spark, sf_dir, "issues").select("run_id", "path", "line_number", "id")
    placed = G.with_neighbours(
        issues, ["run_id", "path"], ["line_number", "id"], "id", F.floor(F.col("line_number") / 64)
    )
    return placed.drop("line_number")


@query(
    "G1", "G2",
    sql=with_sql("issues", body="""
SELECT path, id, row_number() OVER w AS position, count(*) OVER (PARTITION BY path) AS group_size,
  coalesce(lead(id) OVER w, first_value(id) OVER w) AS next_id,
  coalesce(lag(id) OVER w, last_value(id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS previous_id
FROM issues WINDOW w AS (PARTITION BY path ORDER BY line_number, id)"""),
)
def issue_neighbours_across_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the issues of a path in all runs, where groups span many chunks."""
    issues = mapped(spark, sf_dir, "issues").select("path", "line_number", "id")
    chunk = F.struct("line_number", F.substring("id", 1, 1))
    placed = G.with_neighbours(issues, ["path"], ["line_number", "id"], "id", chunk)
    return placed.drop("line_number")


@query(
    "G3",
    sql=with_sql("issues", body="""
SELECT run_id, path, id, line_number FROM issues
QUALIFY row_number() OVER (PARTITION BY run_id, path ORDER BY line_number, id) = 1"""),
)
def first_issue_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = mapped(spark, sf_dir, "issues").select("run_id", "path", "id", "line_number")
    return G.first_of_group(issues, ["run_id", "path"], ["line_number", "id"])


@query(
    "G4",
    sql=with_sql("issues", body="""
SELECT run_id, path, id, line_number, message FROM issues
QUALIFY NOT contains(lower(message), 'nesting')
  OR row_number() OVER (PARTITION BY run_id, path, message ORDER BY line_number, id) = 1"""),
)
def nesting_messages_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = mapped(spark, sf_dir, "issues").select("run_id", "path", "id", "line_number", "message")
    return G.once_per_message(issues)


@query(
    "J16",
    sql=with_sql("runs", body="""
SELECT id, CAST(date_diff('microsecond', created_at, completed_at) / 1e6 AS DOUBLE) AS seconds FROM runs"""),
)
def run_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(spark, sf_dir, "runs").select(
        "id", duration_seconds(F.col("created_at"), F.col("completed_at")).alias("seconds")
    )
