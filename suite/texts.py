"""Queries of the scalar text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegauge.functions import text as T
from codegauge.functions.bytesview import byte_view, line_of
from codegauge.sources.tables import read_table
from suite.mapping import mapped, with_sql
from suite.registry import query


@query(
    "J3",
    sql="""
SELECT p_partkey, concat(lower(substring(c, 1, 1)), substring(c, 2)) AS camel FROM (
  SELECT p_partkey, array_to_string(list_transform(string_split(replace(concat('get_', p_name, '_', p_type), ' ', '_'), '_'),
    lambda x: concat(upper(substring(x, 1, 1)), substring(x, 2))), '') AS c FROM part)""",
)
def snake_to_camel(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read_table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "replace(concat('get_', p_name, '_', p_type), ' ', '_') AS name"
    )
    return parts.select("p_partkey", T.snake_to_camel(F.col("name")).alias("camel"))


_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(trim(clone_url),
  '(?i)^https?://github\.com/', ''), '/+$', ''), '(?i)\.git$', '')"""


@query(
    "J4", "J5", "J6", "J13",
    sql=with_sql("repositories", body=f"""
SELECT id, u AS sanitized, list_extract(string_split(u, '/'), -2) AS owner,
  list_extract(string_split(u, '/'), -1) AS name,
  concat('https://github.com/', list_extract(string_split(u, '/'), -2), '/', list_extract(string_split(u, '/'), -1)) AS canonical,
  concat(list_extract(string_split(clone_url, '/'), -2), '/', list_extract(string_split(clone_url, '/'), -1)) AS shown
FROM (SELECT *, {_CLEAN} AS u FROM repositories)"""),
)
def repository_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("clone_url")
    return mapped(spark, sf_dir, "repositories").select(
        "id",
        T.sanitize_repo_url(url).alias("sanitized"),
        T.repo_owner(url).alias("owner"),
        T.repo_name(url).alias("name"),
        T.canonical_url(T.repo_owner(url), T.repo_name(url)).alias("canonical"),
        T.display_repo_name(url).alias("shown"),
    )


@query(
    "J4", "J5",
    sql=r"""
SELECT page_id, CASE WHEN trim(u) = '' THEN 'MISSING_URL' WHEN len(string_split(u, '/')) < 2 THEN 'INVALID_URL' END AS error,
  CASE WHEN len(string_split(u, '/')) >= 2 THEN list_extract(string_split(u, '/'), -2) END AS owner
FROM (SELECT page_id, regexp_replace(regexp_replace(h, '/+$', ''), '(?i)\.git$', '') AS u
      FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN list_extract(string_split(url, '/'), -1)
            ELSE replace(url, '?', '/') END AS h FROM pages))""",
)
def repository_url_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = read_table(spark, sf_dir, "pages").selectExpr(
        "page_id",
        "CASE WHEN page_id % 3 = 0 THEN element_at(split(url, '/'), -1) ELSE replace(url, '?', '/') END AS u",
    )
    return urls.select(
        "page_id", T.repo_url_error(F.col("u")).alias("error"), T.repo_owner(F.col("u")).alias("owner")
    )


_SHAPED = "concat(text, ' ghp_', substring(repeat(md5(text), 2), 1, 36), ' github_pat_', md5(text), '_x')"


@query(
    "J7",
    sql=f"""
SELECT doc_id, md5(regexp_replace(regexp_replace({_SHAPED}, 'ghp_[A-Za-z0-9]{{36}}', '[REDACTED_TOKEN]', 'g'),
  'github_pat_[A-Za-z0-9_]+', '[REDACTED_TOKEN]', 'g')) AS digest FROM documents""",
)
def redact_repository_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_SHAPED} AS t")
    return docs.select("doc_id", F.md5(T.redact_tokens(F.col("t"))).alias("digest"))


_JSON_TAIL = """concat(text, ' {"access_token": "abc def", "key" : 12, "password":"x"} Authorization: Bearer z')"""


@query(
    "J8",
    sql=rf"""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace({_JSON_TAIL}, '\b[a-zA-Z0-9]{{40,}}\b', '[REDACTED]', 'g'),
  '(?i)(token|key|secret|password|authorization)\s*[:=]\s*[^\s,}}"]+', '\1: [REDACTED]', 'g'),
  '(?i)"(token|password|client_secret|access_token|refresh_token)"\s*:\s*"[^"]+"', '"\1": "[REDACTED]"', 'g')) AS digest
FROM documents""",
)
def redact_log_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_JSON_TAIL} AS t")
    return docs.select("doc_id", F.md5(T.redact_log(F.col("t"))).alias("digest"))


_URL = "concat(url, '&githubToken=', md5(url), '&b=1&githubToken=', md5(url))"


@query(
    "J9",
    sql=f"""
SELECT page_id, regexp_replace({_URL}, 'githubToken=[^&]*', 'githubToken=[REDACTED]', 'g') AS every,
  regexp_replace({_URL}, 'githubToken=[^&]*', 'githubToken=[REDACTED]') AS first FROM pages""",
)
def redact_query_parameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").selectExpr("page_id", f"{_URL} AS u")
    return pages.select(
        "page_id",
        T.redact_query(F.col("u")).alias("every"),
        T.redact_query(F.col("u"), first_only=True).alias("first"),
    )


@query(
    "J10",
    sql="""
SELECT doc_id, md5(CASE WHEN len(text) > 2000 THEN concat(substring(text, 1, 2000), '... [Truncated]') ELSE text END) AS body,
  CASE WHEN len(text) > 200 THEN concat(substring(text, 1, 200), '...') ELSE text END AS error
FROM documents""",
)
def truncate_with_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return read_table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(T.truncate(text)).alias("body"),
        T.truncate(text, T.ERROR_LIMIT, T.ERROR_MARKER).alias("error"),
    )


@query(
    "J11", "J12",
    sql=with_sql("runs", body="""
SELECT id, concat('Analyzed ', CAST(files_analyzed AS VARCHAR), ' files. Score: ', CAST(average_score AS VARCHAR),
  '/100. Issues: ', CAST(total_issues AS VARCHAR)) AS summary, CAST(floor(average_score) AS INT) AS score FROM runs"""),
)
def summary_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = T.run_summary_text(F.col("files_analyzed"), F.col("average_score"), F.col("total_issues"))
    return mapped(spark, sf_dir, "runs").select(
        "id", summary.alias("summary"), T.score_from_summary(summary).alias("score")
    )


@query(
    "J14",
    sql=with_sql("issues", body="""
SELECT id, CASE WHEN regexp_matches(lower(message), 'security|injection|xss') THEN 'Security'
  WHEN regexp_matches(lower(message), 'performance|slow|optimization') THEN 'Performance'
  WHEN regexp_matches(lower(message), 'style|format|indentation') THEN 'Style' ELSE 'General' END AS inferred
FROM issues"""),
)
def inferred_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(spark, sf_dir, "issues").select(
        "id", T.infer_category(F.col("message")).alias("inferred")
    )


@query(
    "J15", "J17",
    sql=with_sql("runs", body="""
SELECT id, substring(base_commit_sha, 1, 8) AS short, created_at - INTERVAL 24 HOUR AS cutoff FROM runs"""),
)
def short_hash_and_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(spark, sf_dir, "runs").select(
        "id", T.short_hash(F.col("base_commit_sha")).alias("short"), T.cutoff(F.col("created_at")).alias("cutoff")
    )


@query(
    "J1", "J2",
    sql=with_sql("code_files", body="""
SELECT path, CAST(strlen(content) AS INT) AS n_bytes,
  CAST(1 + len(p) - len(replace(p, chr(10), '')) AS INT) AS line
FROM (SELECT path, content, substring(content, 1, 120) AS p FROM code_files)"""),
)
def line_of_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that holds byte offset 120 of each file."""
    view = byte_view(F.col("content"))
    return mapped(spark, sf_dir, "code_files").select(
        "path", F.length(view).alias("n_bytes"), line_of(view, F.lit(120)).alias("line")
    )


@query(
    "J21",
    sql="""
SELECT l_orderkey, l_partkey, l_suppkey,
  CAST(round(CAST((l_partkey % 1000) * 0.001 AS DECIMAL(10,3)), 2) AS DECIMAL(10,2)) AS rounded FROM lineitem""",
)
def rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_partkey", "l_suppkey", "CAST((l_partkey % 1000) * 0.001 AS DECIMAL(10,3)) AS v"
    )
    return rows.select(
        "l_orderkey", "l_partkey", "l_suppkey", T.round2(F.col("v")).cast("decimal(10,2)").alias("rounded")
    )
