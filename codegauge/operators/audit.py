"""Audits of the stored tables: what a database would enforce and files do not."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Unique keys, references, required columns and length limits.
# ---------------------------------------------------------------------------
UNIQUE_KEYS = {
    "users": ("email",),
    "repositories": ("github_repo_id",),
    "analysis_runs": ("repository_id", "base_commit_sha", "head_commit_sha"),
}
REFERENCES = (
    ("repositories", "user_id", "users"),
    ("analysis_runs", "repository_id", "repositories"),
    ("analysis_issues", "run_id", "analysis_runs"),
    ("analysis_metrics", "run_id", "analysis_runs"),
)
REQUIRED = {
    "analysis_runs": (
        "repository_id", "branch_name", "default_branch", "base_commit_sha", "head_commit_sha",
        "status", "files_analyzed", "average_score", "total_issues", "created_at",
    ),
    "analysis_issues": ("run_id", "file_path", "severity", "category", "message", "created_at"),
}
MAX_LENGTH = {
    "analysis_runs": {
        "branch_name": 255, "default_branch": 255, "base_commit_sha": 40, "head_commit_sha": 40,
        "status": 50,
    },
    "analysis_issues": {"file_path": 500, "severity": 50, "category": 100, "rule_id": 100},
}


def duplicate_keys(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count.

    Texts are the same in any case; the first spelling in order is shown.
    """
    kinds = dict(rows.dtypes)
    alike = [F.lower(c).alias(f"__{c}") if kinds[c] == "string" else F.col(c).alias(f"__{c}") for c in key]
    counted = rows.groupBy(*alike).agg(*[F.min(c).alias(c) for c in key], F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") > 1).select(*key, "n")


def orphans(children: DataFrame, key: str, parents: DataFrame, parent_key: str = "id") -> DataFrame:
    """Children whose parent does not exist."""
    known = parents.select(F.col(parent_key).alias(key))
    return children.where(F.col(key).isNotNull()).join(known, key, "left_anti")


def cascade_delete(tables: Mapping[str, DataFrame], name: str, condition: Column) -> dict[str, DataFrame]:
    """The tables without the rows of ``name`` that meet a condition and all their descendants."""
    kept = dict(tables)
    gone = {name: tables[name].where(condition).select("id")}
    kept[name] = tables[name].where(~F.coalesce(condition, F.lit(False)))
    for child, key, parent in REFERENCES:
        if parent not in gone or child not in tables:
            continue
        ids = gone[parent].select(F.col("id").alias(key))
        kept[child] = kept[child].join(ids, key, "left_anti")
        if "id" in tables[child].columns:
            gone[child] = tables[child].join(ids, key, "left_semi").select("id")
    return kept


def violations(
    rows: DataFrame,
    required: Sequence[str] = (),
    max_length: Mapping[str, int] | None = None,
    key: str = "id",
) -> DataFrame:
    """One row per broken column rule: (key, column, problem). One pass, no shuffle."""
    checks = [
        F.when(F.col(c).isNull(), F.struct(F.lit(c).alias("column"), F.lit("missing").alias("problem")))
        for c in required
    ] + [
        F.when(
            F.char_length(c) > n,
            F.struct(F.lit(c).alias("column"), F.lit(f"longer than {n}").alias("problem")),
        )
        for c, n in (max_length or {}).items()
    ]
    found = F.filter(F.array(*checks), lambda v: v.isNotNull())
    return rows.select(key, F.explode(found).alias("v")).select(key, "v.column", "v.problem")
