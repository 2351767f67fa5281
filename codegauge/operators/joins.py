"""Joins of runs, repositories, issues, snapshots and source lines.

Plain equi-joins: the optimizer broadcasts a side whose size it knows to be
small and splits skewed partitions at run time, so no side is forced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegauge.functions.labels import IN_PROGRESS, line_mark, line_rank, rank_name, severity_rank
from codegauge.functions.text import canonical_url, repo_name, repo_owner, sanitize_repo_url

COMMIT_KEY = ("repository_id", "base_commit_sha", "head_commit_sha")


def shown_name() -> Column:
    return F.coalesce("full_name", "name")


def runs_with_repository(runs: DataFrame, repositories: DataFrame) -> DataFrame:
    """Inner join on the repository; adds owner, shown name and URL."""
    repos = repositories.select(
        F.col("id").alias("repository_id"), "user_id", shown_name().alias("repo_name"), "clone_url"
    )
    return runs.join(repos, "repository_id")


def list_runs(
    runs: DataFrame,
    repositories: DataFrame,
    user_id: int | None = None,
    repo_url: str | None = None,
    branch: str | None = None,
) -> DataFrame:
    """Runs of an owner, optionally of one repository URL and branch; the list columns."""
    if branch:
        runs = runs.where(F.lower("branch_name") == branch.lower())
    if user_id is not None:
        repositories = repositories.where(F.col("user_id") == user_id)
    if repo_url:
        wanted = sanitize_repo_url(F.lit(repo_url))
        repositories = repositories.where(F.contains(F.lower("clone_url"), F.lower(wanted)))
    return runs_with_repository(runs, repositories).select(
        "id", "repository_id", "user_id", "repo_name", "branch_name", "default_branch",
        "base_commit_sha", "head_commit_sha", "status", "files_analyzed",
        F.col("average_score").cast("double").alias("average_score"),
        "total_issues", "created_at", "completed_at",
    )


def hide_unfinished(runs: DataFrame) -> DataFrame:
    """Runs in progress show only id, name, branch, status, files and creation time."""
    shown = {"id", "repo_name", "branch_name", "status", "files_analyzed", "created_at"}
    pending = F.col("status").isin(*IN_PROGRESS)
    return runs.withColumns(
        {c: F.when(~pending, F.col(c)) for c in runs.columns if c not in shown}
    )


def run_detail(runs: DataFrame, repositories: DataFrame, issues: DataFrame) -> DataFrame:
    """Runs with their repository and, one row per issue, all their issues.

    The rows stay flat: a run may hold any number of issues, so they are not
    gathered into one row. A run without issues keeps one row. The matching part
    is an inner join, where a run with very many issues can be split over tasks
    (in an outer join only the side that is kept whole could be); the runs
    without issues are found against the distinct run ids.
    """
    kept = issues.select(
        F.col("run_id").alias("id"),
        F.col("path").alias("file_path"),
        F.col("line_number").alias("line_start"),
        "severity", "category", "message", "rule_id",
    )
    owned = runs_with_repository(runs, repositories)
    without = owned.join(kept.select("id").distinct(), "id", "left_anti")
    return owned.join(kept, "id").unionByName(without, allowMissingColumns=True)


def owned_issues(
    issues: DataFrame,
    runs: DataFrame,
    repositories: DataFrame,
    user_id: int | None = None,
    severity: str | None = None,
    category: str | None = None,
) -> DataFrame:
    """Issues with the owner of their run; optional exact severity and category."""
    if severity:
        issues = issues.where(F.col("severity") == severity)
    if category:
        issues = issues.where(F.col("category") == category)
    repos = repositories.select(F.col("id").alias("repository_id"), "user_id")
    if user_id is not None:
        repos = repos.where(F.col("user_id") == user_id)
    owners = runs.select(F.col("id").alias("run_id"), "repository_id").join(repos, "repository_id")
    return issues.join(owners, "run_id")


def with_snapshot(runs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Runs with their first snapshot (by time, then id), if they have one."""
    rest = [c for c in snapshots.columns if c != "run_id"]
    first = snapshots.groupBy(F.col("run_id").alias("id")).agg(
        F.min_by(F.struct(*rest), F.struct("created_at", "snapshot_id")).alias("snapshot")
    )
    return runs.join(first, "id", "left")


def _known_runs(runs: DataFrame) -> DataFrame:
    """The first run (lowest id) of each repository and commit pair."""
    return runs.groupBy(*COMMIT_KEY).agg(
        F.min(F.struct("id", "status", "files_analyzed")).alias("known")
    )


def completed_lookup(submissions: DataFrame, runs: DataFrame) -> DataFrame:
    """Submissions with the id of a completed run for the same commits, else NULL."""
    joined = submissions.join(_known_runs(runs), list(COMMIT_KEY), "left")
    reused = F.when(F.col("known.status") == "completed", F.col("known.id"))
    return joined.withColumn("reused_run_id", reused).drop("known")


def submission_decision(submissions: DataFrame, runs: DataFrame) -> DataFrame:
    """reuse, replace or new per submission, with the run that is reused or replaced.

    A completed run with files and a run in progress are reused; a failed run or
    one without files is replaced, so the commit key stays unique.
    """
    joined = submissions.join(_known_runs(runs), list(COMMIT_KEY), "left")
    known = F.col("known")
    usable = (known["status"] == "completed") & (known["files_analyzed"] > 0)
    decision = (
        F.when(known.isNull(), "new")
        .when(usable | known["status"].isin(*IN_PROGRESS), "reuse")
        .otherwise("replace")
    )
    return joined.withColumns({"decision": decision, "known_run_id": known["id"]}).drop("known")


def get_or_create_repositories(requests: DataFrame, repositories: DataFrame) -> DataFrame:
    """Existing repositories plus one new row per unknown (URL, owner) among the requests.

    Requests hold ``repo_url`` and ``user_id``; URLs that name no repository are left out.
    URLs are the same in any case; of several spellings the first in order is taken.
    """
    owner, name = repo_owner(F.col("repo_url")), repo_name(F.col("repo_url"))
    asked = (
        requests.select("user_id", owner.alias("owner"), name.alias("name"))
        .where(F.col("owner").isNotNull())
        .select("user_id", F.struct(canonical_url(F.col("owner"), F.col("name")).alias("clone_url"), "name").alias("r"))
        .groupBy("user_id", F.lower("r.clone_url").alias("__low"))
        .agg(F.min("r").alias("r"))
        .select("user_id", "r.name", "r.clone_url", "__low")
    )
    existing = repositories.select(
        "user_id", "name", "clone_url", F.lit(False).alias("created")
    )
    known = existing.select("user_id", F.lower("clone_url").alias("__low"))
    new = asked.join(known, ["user_id", "__low"], "left_anti").drop("__low")
    return existing.unionByName(new.withColumn("created", F.lit(True)))


def lines_with_issues(files: DataFrame, issues: DataFrame) -> DataFrame:
    """Every source line with its issue count and highest mark.

    Issues are counted per line, then gathered per file (at most one mark a line), and
    both sides meet on the file. The lines are cut and laid beside their marks after
    the join, in the task, so no line is shuffled. Marks outside the file are left out.
    """
    key = ["run_id", "path"]
    marks = issues.groupBy(*key, "line_number").agg(
        F.count(F.lit(1)).alias("issue_count"), F.max(line_rank(F.col("severity"))).alias("rank")
    )
    of_file = marks.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("line_number", "issue_count", "rank"))).alias("marks")
    )
    kind = of_file.schema["marks"].dataType
    n_lines = F.length("content") - F.length(F.translate("content", "\n", "")) + 1
    placed = files.select(*key, "content", n_lines.alias("n_lines")).join(of_file, key, "left")
    placed = placed.withColumn(
        "marks",
        F.coalesce(
            F.filter("marks", lambda m: m["line_number"].between(1, F.col("n_lines"))), F.array().cast(kind)
        ),
    )

    def with_gap(m: Column, i: Column) -> Column:
        before = F.coalesce(F.get("marks", i - 1)["line_number"], F.lit(0))
        empty = F.array_repeat(F.lit(None).cast(kind.elementType), (m["line_number"] - before - 1).cast("int"))
        return F.concat(empty, F.array(m))

    beside = F.arrays_zip(
        F.split("content", "\n", -1).alias("line"), F.flatten(F.transform("marks", with_gap)).alias("m")
    )
    lines = placed.select(*key, F.posexplode(beside).alias("i", "at"))
    return lines.select(
        *key,
        (F.col("i") + 1).alias("line_number"),
        F.col("at")["line"].alias("line"),
        F.coalesce(F.col("at")["m"]["issue_count"], F.lit(0)).alias("issue_count"),
        F.when(F.col("at")["m"]["rank"].isNotNull(), line_mark(F.col("at")["m"]["rank"])).alias("mark"),
    )


def files_with_issue_counts(files: DataFrame, issues: DataFrame) -> DataFrame:
    """Files with issue count and highest severity; paths match in any case."""
    counted = issues.groupBy("run_id", F.lower("path").alias("__low")).agg(
        F.count(F.lit(1)).alias("issue_count"),
        F.max(severity_rank(F.col("severity"))).alias("max_rank"),
    )
    joined = files.withColumn("__low", F.lower("path")).join(counted, ["run_id", "__low"], "left")
    return joined.drop("__low").withColumns(
        {
            "issue_count": F.coalesce("issue_count", F.lit(0)),
            "max_rank": F.coalesce("max_rank", F.lit(0)),
        }
    ).withColumn("max_severity", rank_name(F.col("max_rank")))


def existing_keys(candidates: DataFrame, stored: DataFrame, *key: str) -> DataFrame:
    """Candidates whose key is already stored; texts are the same in any case."""
    kinds = dict(stored.dtypes)
    alike = {c: F.lower if kinds[c] == "string" else F.col for c in key}
    left = candidates.withColumns({f"__{c}": alike[c](c) for c in key})
    right = stored.select(*[alike[c](c).alias(f"__{c}") for c in key])
    return left.join(right, [f"__{c}" for c in key], "left_semi").select(candidates.columns)
