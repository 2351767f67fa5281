"""Queries of the audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegauge.operators import audit as L
from codegauge.sources.store import Store
from codegauge.workspace import shared_folder
from suite.mapping import mapped, with_sql
from suite.registry import query


@query(
    "L1",
    sql=with_sql("runs", body="""
SELECT repository_id, base_commit_sha, head_commit_sha, count(*) AS n FROM runs GROUP BY 1, 2, 3 HAVING count(*) > 1"""),
)
def duplicate_commit_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.duplicate_keys(mapped(spark, sf_dir, "runs"), L.UNIQUE_KEYS["analysis_runs"])


@query(
    "L1",
    sql=with_sql("repositories", body="SELECT github_repo_id, count(*) AS n FROM repositories GROUP BY 1 HAVING count(*) > 1"),
)
def duplicate_repository_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.duplicate_keys(mapped(spark, sf_dir, "repositories"), L.UNIQUE_KEYS["repositories"])


@query(
    "L1",
    sql="""SELECT min(c_mktsegment) AS email, count(*) AS n
FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END || '@' || c_nationkey AS c_mktsegment FROM customer)
GROUP BY lower(c_mktsegment) HAVING count(*) > 1""",
)
def duplicate_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that differ in case alone are one address."""
    from codegauge.sources.tables import read_table

    users = read_table(spark, sf_dir, "customer").selectExpr(
        "CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END || '@' || c_nationkey AS email"
    )
    return L.duplicate_keys(users, L.UNIQUE_KEYS["users"])


# The repositories of one owner are taken for deleted, which leaves orphans behind.
_GONE = "user_id = 3"


@query(
    "L2",
    sql=with_sql("runs", "repositories", body="""
SELECT id, repository_id FROM runs WHERE repository_id IN (SELECT id FROM repositories WHERE user_id = 3)"""),
)
def orphan_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = mapped(spark, sf_dir, "repositories").where(f"NOT ({_GONE})")
    return L.orphans(mapped(spark, sf_dir, "runs"), "repository_id", kept).select("id", "repository_id")


@query(
    "L2",
    sql=with_sql("issues", "runs", body="""
SELECT id, run_id FROM issues WHERE run_id NOT IN (SELECT id FROM runs WHERE status <> 'failed')"""),
)
def orphan_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of runs that failed, taken as removed."""
    kept = mapped(spark, sf_dir, "runs").where("status <> 'failed'")
    return L.orphans(mapped(spark, sf_dir, "issues"), "run_id", kept).select("id", "run_id")


_LEFT = with_sql("issues", "runs", "repositories", body="""
SELECT 'repositories' AS table_name, count(*) AS n FROM repositories WHERE user_id <> 3
UNION ALL SELECT 'analysis_runs', count(*) FROM runs
  WHERE repository_id NOT IN (SELECT id FROM repositories WHERE user_id = 3)
UNION ALL SELECT 'analysis_issues', count(*) FROM issues WHERE run_id NOT IN (
  SELECT r.id FROM runs r JOIN repositories p ON repository_id = p.id WHERE user_id = 3)""")


@query("L3", sql=_LEFT)
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {
        "repositories": mapped(spark, sf_dir, "repositories"),
        "analysis_runs": mapped(spark, sf_dir, "runs"),
        "analysis_issues": mapped(spark, sf_dir, "issues"),
    }
    kept = L.cascade_delete(tables, "repositories", F.expr(_GONE))
    merged = None
    for name, rows in kept.items():
        counted = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        merged = counted if merged is None else merged.unionByName(counted)
    return merged


@query("L3", sql=_LEFT)
def cascade_delete_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in a store: only buckets that can hold a descendant are read, all tables change at once."""
    store = Store(spark, shared_folder(spark, "cascade"))
    tables = {
        "repositories": mapped(spark, sf_dir, "repositories"),
        "analysis_runs": mapped(spark, sf_dir, "runs"),
        "analysis_issues": mapped(spark, sf_dir, "issues"),
    }
    keys = {"repositories": "id", "analysis_runs": "repository_id", "analysis_issues": "run_id"}
    store.replace(tables, keys, buckets=16)
    after = store.delete("repositories", F.expr(_GONE), L.REFERENCES)
    merged = None
    for name in tables:
        counted = store.read(name, after).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        merged = counted if merged is None else merged.unionByName(counted)
    return merged


@query(
    "L4",
    sql=with_sql("runs", body="""
SELECT id, 'summary' AS column, 'missing' AS problem FROM runs WHERE summary IS NULL
UNION ALL SELECT id, 'completed_at', 'missing' FROM runs WHERE completed_at IS NULL
UNION ALL SELECT id, 'summary', 'longer than 48' FROM runs WHERE len(summary) > 48"""),
)
def column_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored rules, and two stricter ones that some rows break."""
    return L.violations(
        mapped(spark, sf_dir, "runs"),
        (*L.REQUIRED["analysis_runs"], "summary", "completed_at"),
        {**L.MAX_LENGTH["analysis_runs"], "summary": 48},
    )
