"""Queries that join runs, repositories, issues, snapshots and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegauge.functions.text import canonical_url, repo_name, repo_owner, shown_score
from codegauge.operators import joins as J
from suite.mapping import mapped, with_sql
from suite.registry import query

_LIST = """id, repository_id, user_id, coalesce(full_name, name) AS repo_name, branch_name, default_branch,
  base_commit_sha, head_commit_sha, status, files_analyzed, CAST(average_score AS DOUBLE) AS average_score,
  total_issues, created_at, completed_at"""
_REPO = "JOIN (SELECT id AS repo_id, user_id, full_name, name, clone_url FROM repositories) p ON repository_id = repo_id"


@query("F1", "B13", "B20", sql=with_sql("runs", "repositories", body=f"SELECT {_LIST} FROM runs {_REPO}"))
def runs_of_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.list_runs(mapped(spark, sf_dir, "runs"), mapped(spark, sf_dir, "repositories"))


@query(
    "B13", "B20",
    sql=with_sql("runs", "repositories", body=f"""
SELECT {_LIST} FROM runs {_REPO}
WHERE user_id = 7 AND contains(lower(clone_url), 'building/repo') AND branch_name = 'branch-2'"""),
)
def runs_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.list_runs(
        mapped(spark, sf_dir, "runs"), mapped(spark, sf_dir, "repositories"),
        user_id=7, repo_url=" https://github.com/BUILDING/repo.git/", branch="branch-2",
    )


@query(
    "B21", "F1",
    sql=with_sql("runs", "repositories", body=f"""
SELECT id, coalesce(full_name, name) AS repo_name, branch_name, status, files_analyzed, created_at,
  CASE WHEN status <> 'running' THEN CAST(average_score AS DOUBLE) END AS average_score,
  CASE WHEN status <> 'running' THEN total_issues END AS total_issues,
  CASE WHEN status <> 'running' THEN completed_at END AS completed_at
FROM runs {_REPO}"""),
)
def runs_in_progress_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = J.list_runs(mapped(spark, sf_dir, "runs"), mapped(spark, sf_dir, "repositories"))
    shown = listed.select(
        "id", "repo_name", "branch_name", "status", "files_analyzed", "created_at",
        "average_score", "total_issues", "completed_at",
    )
    return J.hide_unfinished(shown)


@query(
    "F2", "B11",
    sql=with_sql("issues", "runs", "repositories", body=f"""
SELECT i.id, i.run_id, user_id, repository_id, path, line_number, severity, category, rule_id
FROM issues i JOIN runs r ON i.run_id = r.id {_REPO}
WHERE severity = 'major' AND category = 'style'"""),
)
def owned_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = J.owned_issues(
        mapped(spark, sf_dir, "issues"), mapped(spark, sf_dir, "runs"),
        mapped(spark, sf_dir, "repositories"), severity="major", category="style",
    )
    return joined.select(
        "id", "run_id", "user_id", "repository_id", "path", "line_number", "severity", "category", "rule_id"
    )


@query(
    "F3",
    sql=with_sql("issues", "runs", "repositories", body=f"""
SELECT r.id, status, coalesce(full_name, name) AS repo_name, path AS file_path, line_number AS line_start,
  severity, category, message, rule_id
FROM runs r {_REPO} LEFT JOIN (SELECT * EXCLUDE (id, created_at) FROM issues) i ON r.id = i.run_id"""),
)
def run_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = J.run_detail(
        mapped(spark, sf_dir, "runs"), mapped(spark, sf_dir, "repositories"), mapped(spark, sf_dir, "issues")
    )
    return joined.select(
        "id", "status", "repo_name", "file_path", "line_start", "severity", "category", "message", "rule_id"
    )


_SNAPSHOTS = [
    "l_orderkey AS run_id",
    "concat_ws('-', CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)) AS snapshot_id",
    "l_shipdate AS created_at",
]


@query(
    "F4",
    sql=with_sql("runs", body=f"""
SELECT r.id, r.status, s.snapshot_id, s.created_at AS snapshot_at FROM runs r
LEFT JOIN (SELECT * FROM (SELECT {', '.join(_SNAPSHOTS)} FROM lineitem)
  QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY created_at, snapshot_id) = 1) s ON r.id = s.run_id"""),
)
def run_with_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codegauge.sources.tables import read_table

    snapshots = read_table(spark, sf_dir, "lineitem").selectExpr(*_SNAPSHOTS)
    return J.with_snapshot(mapped(spark, sf_dir, "runs"), snapshots).select(
        "id", "status", "snapshot.snapshot_id", F.col("snapshot.created_at").alias("snapshot_at")
    )


# Runs before the day are history, those from it on are submissions.
_DAY = "1998-01-01"
_KNOWN = f"""known AS (SELECT repository_id, base_commit_sha, head_commit_sha, min(id) AS kid,
  arg_min(status, id) AS kstatus, arg_min(files_analyzed, id) AS kfiles
  FROM runs WHERE created_at < TIMESTAMP '{_DAY}' GROUP BY 1, 2, 3)"""
_SUBMITTED = f"""FROM runs s LEFT JOIN known k USING (repository_id, base_commit_sha, head_commit_sha)
WHERE s.created_at >= TIMESTAMP '{_DAY}'"""


def _history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    runs = mapped(spark, sf_dir, "runs")
    day = F.lit(_DAY).cast("timestamp_ntz")
    return runs.where(F.col("created_at") >= day), runs.where(F.col("created_at") < day)


@query(
    "F5", "H4",
    sql=with_sql("runs", body="").rstrip() + f", {_KNOWN} SELECT s.id, CASE WHEN kstatus = 'completed' THEN kid END AS reused_run_id {_SUBMITTED}",
)
def completed_run_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    submitted, history = _history(spark, sf_dir)
    return J.completed_lookup(submitted, history).select("id", "reused_run_id")


@query(
    "F6", "H4",
    sql=with_sql("runs", body="").rstrip() + f""", {_KNOWN}
SELECT s.id, kid AS known_run_id, CASE WHEN kid IS NULL THEN 'new'
  WHEN kstatus = 'running' OR (kstatus = 'completed' AND kfiles > 0) THEN 'reuse' ELSE 'replace' END AS decision
{_SUBMITTED}""",
)
def submission_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    submitted, history = _history(spark, sf_dir)
    return J.submission_decision(submitted, history).select("id", "known_run_id", "decision")


_CANON = """concat('https://github.com/', list_extract(string_split(u, '/'), -2), '/',
  list_extract(string_split(u, '/'), -1))"""
_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(trim(clone_url),
  '(?i)^https?://github\.com/', ''), '/+$', ''), '(?i)\.git$', '')"""


@query(
    "F7", "J4", "J5", "J6",
    sql=with_sql("repositories", body=f"""
SELECT user_id, name, clone_url, created FROM (
  SELECT user_id, name, {_CANON} AS clone_url, false AS created
  FROM (SELECT *, {_CLEAN} AS u FROM repositories WHERE user_id < 16)
  UNION ALL
  SELECT DISTINCT user_id, name, {_CANON}, true
  FROM (SELECT *, {_CLEAN} AS u FROM repositories JOIN orders ON o_custkey = id) WHERE user_id >= 16)"""),
)
def repository_get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests name every repository that has runs; those of some owners are not stored yet."""
    repositories = mapped(spark, sf_dir, "repositories")
    url = F.col("clone_url")
    stored = repositories.where("user_id < 16").select(
        "user_id", "name", canonical_url(repo_owner(url), repo_name(url)).alias("clone_url")
    )
    asked = mapped(spark, sf_dir, "runs").select(F.col("repository_id").alias("id")).join(
        repositories.select("id", "user_id", url.alias("repo_url")), "id"
    )
    return J.get_or_create_repositories(asked, stored)


@query(
    "F8",
    sql=with_sql("code_files", body="""
SELECT f.path, f.line_number, f.line, coalesce(n, 0) AS issue_count,
  CASE r WHEN 3 THEN 'critical' WHEN 2 THEN 'major' WHEN 1 THEN 'minor' WHEN 0 THEN 'other' END AS mark
FROM (SELECT path, entry_index, CAST(i AS INT) AS line_number, l[i] AS line
      FROM (SELECT path, entry_index, string_split(content, chr(10)) AS l FROM code_files) x,
      unnest(range(1, len(l) + 1)) AS t(i)) f
LEFT JOIN (SELECT l_orderkey, CAST(l_quantity AS INT) AS line_number, count(*) AS n,
      max(CASE WHEN l_linenumber = 1 THEN 3 WHEN l_linenumber <= 3 THEN 2 WHEN l_linenumber <= 5 THEN 1 ELSE 0 END) AS r
      FROM lineitem GROUP BY 1, 2) i ON i.l_orderkey = f.entry_index AND i.line_number = f.line_number"""),
)
def source_lines_with_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the rendered files and the stored issues of their order."""
    files = mapped(spark, sf_dir, "code_files")
    issues = mapped(spark, sf_dir, "issues").drop("path").withColumnRenamed("run_id", "entry_index")
    placed = issues.join(files.select("entry_index", "run_id", "path"), "entry_index")
    return J.lines_with_issues(files, placed).select("path", "line_number", "line", "issue_count", "mark")


@query(
    "F9", "E19", "I2",
    sql=with_sql("issues", body="""
SELECT f.run_id, f.path, coalesce(n, 0) AS issue_count, coalesce(s, 'none') AS max_severity
FROM (SELECT DISTINCT run_id, CASE WHEN line_number % 2 = 0 THEN upper(path) ELSE path END AS path FROM issues) f
LEFT JOIN (SELECT run_id, lower(path) AS low, count(*) AS n,
    CASE min(CASE severity WHEN 'critical' THEN 1 WHEN 'major' THEN 2 WHEN 'minor' THEN 3 ELSE 4 END)
      WHEN 1 THEN 'critical' WHEN 2 THEN 'major' WHEN 3 THEN 'minor' ELSE 'info' END AS s
  FROM issues WHERE category <> 'style' GROUP BY 1, 2) i ON f.run_id = i.run_id AND lower(f.path) = low"""),
)
def files_with_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = mapped(spark, sf_dir, "issues")
    files = issues.selectExpr(
        "run_id", "CASE WHEN line_number % 2 = 0 THEN upper(path) ELSE path END AS path"
    ).distinct()
    counted = J.files_with_issue_counts(files, issues.where("category <> 'style'"))
    return counted.select("run_id", "path", "issue_count", "max_severity")


@query(
    "F10",
    sql="""SELECT c_custkey, c_name FROM customer
WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)""",
)
def existing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codegauge.sources.tables import read_table

    candidates = read_table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "key")
    stored = read_table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "key")
    return J.existing_keys(candidates, stored, "key").select("c_custkey", "c_name")


@query(
    "J12", "J13",
    sql=with_sql("runs", "repositories", body=r"""
SELECT r.id, CASE WHEN r.average_score <> 0 THEN CAST(r.average_score AS DOUBLE)
    ELSE coalesce(CAST(nullif(regexp_extract(r.summary, 'Score: (\d+)', 1), '') AS DOUBLE), 0) END AS score,
  concat(list_extract(string_split(p.clone_url, '/'), -2), '/', list_extract(string_split(p.clone_url, '/'), -1)) AS shown
FROM runs r JOIN repositories p ON r.repository_id = p.id"""),
)
def shown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codegauge.functions.text import display_repo_name

    joined = J.runs_with_repository(mapped(spark, sf_dir, "runs"), mapped(spark, sf_dir, "repositories"))
    return joined.select(
        "id",
        shown_score(F.col("average_score"), F.col("summary")).alias("score"),
        display_repo_name(F.col("clone_url")).alias("shown"),
    )
