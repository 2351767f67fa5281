"""Queries of the rules, metrics, scores and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegauge.operators import rules as R
from codegauge.operators import scoring as S
from codegauge.operators.catalog import DEFAULT_RULES, rules_with
from suite.mapping import mapped, with_sql
from suite.registry import query

ISSUE_COLUMNS = (
    "path", "line_number", "severity", "category", "message", "rule_id", "suggested_fix", "pattern_order",
)


def _texts(rule_id: str) -> dict:
    rule = next(r for r in DEFAULT_RULES if r.rule_id == rule_id)
    return {"severity": rule.severity, "category": rule.category, "message": rule.message, "fix": rule.fix, "rule": rule}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _message_sql(rule_id: str, text: str = "''", number: str = "''", template: str | None = None) -> str:
    m = _quoted(template or _texts(rule_id)["message"])
    return f"replace(replace({m}, '{{text}}', {text}), '{{number}}', CAST({number} AS VARCHAR))"


def _row_sql(
    rule_id: str, line: str, source: str, text: str = "''", number: str = "''",
    fix: str | None = None, template: str | None = None, pattern: str = "0",
) -> str:
    """SELECT of issue rows: the texts of a rule around a place computed in SQL."""
    t = _texts(rule_id)
    return f"""SELECT path, CAST({line} AS INT) AS line_number, '{t["severity"]}' AS severity,
  '{t["category"]}' AS category, {_message_sql(rule_id, text, number, template)} AS message,
  '{rule_id}' AS rule_id, {fix or _quoted(t["fix"])} AS suggested_fix,
  CAST({pattern} AS INT) AS pattern_order FROM {source}"""


def _pattern_sql(rule_id: str, files: str) -> str:
    """Matches of the patterns of a rule by their place among the pieces between them."""
    rows = []
    for k, p in enumerate(_texts(rule_id)["rule"].patterns):
        regex = _quoted("(?i)" + p.regex().split(")", 1)[1].replace(r"(?<![A-Za-z0-9_])", r"\b"))
        source = f"""(SELECT path, i, m, p FROM (
            SELECT path, regexp_extract_all(content, {regex}) AS m,
                   string_split_regex(content, {regex}) AS p
            FROM {files} WHERE regexp_matches(content, {regex})) x, unnest(range(1, len(m) + 1)) AS t(i)) y"""
        before = "concat(array_to_string(p[1:i], ''), array_to_string(m[1:i-1], ''))"
        line = f"1 + len({before}) - len(replace({before}, chr(10), ''))"
        rows.append(_row_sql(rule_id, line, source, template=p.message, pattern=str(k)))
    return "\nUNION ALL\n".join(rows)


def _lines(files: str) -> str:
    """Lines of the files with their numbers."""
    return f"""(SELECT path, i AS no, l[i] AS line FROM (
        SELECT path, string_split(content, chr(10)) AS l FROM {files}) x,
        unnest(range(1, len(l) + 1)) AS t(i)) y"""


def _detect(files: str, rule_id: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rules = rules_with(rule_id)
        return R.detect(mapped(spark, sf_dir, files), rules).select(*ISSUE_COLUMNS)

    return run


_F = "code_files"
_STYLE_SQL = {
    "FUNCTION_TOO_LONG": _row_sql(
        "FUNCTION_TOO_LONG",
        "1 + len(split_part(content, 'function load_order', 1)) "
        "- len(replace(split_part(content, 'function load_order', 1), chr(10), ''))",
        f"""(SELECT *, 2 + 51 * CAST(o_orderpriority = '1-URGENT' AS INT)
              + greatest(n, 1) - 1 AS n_lines
             FROM {_F} JOIN orders ON o_orderkey = entry_index
             LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey) z
            WHERE n_lines > 50""",
        text="'load_order'", number="n_lines",
    ),
    "FILE_TOO_LONG": _row_sql(
        "FILE_TOO_LONG", "1",
        f"(SELECT path, len(string_split(content, chr(10))) AS n FROM {_F}) z WHERE n > 500", number="n",
    ),
    "HIGH_COMPLEXITY": _row_sql(
        "HIGH_COMPLEXITY", "1",
        f"""(SELECT path, 1 + 20 * CAST(entry_index % 7 = 0 AS INT) + 2 * coalesce(w, 0) AS n FROM {_F}
             LEFT JOIN (SELECT l_orderkey, count(*) AS w FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1)
             ON l_orderkey = entry_index) z WHERE n > 20""",
        number="n",
    ),
    "NAMING_CONVENTION_FUNCTION": _row_sql(
        "NAMING_CONVENTION_FUNCTION", "no",
        _lines(_F) + " WHERE line LIKE 'function load_order(%'",
        text="'load_order'", fix="'Rename to camelCase, e.g., ''loadOrder'''",
    ),
    "NAMING_CONVENTION_CLASS": _row_sql(
        "NAMING_CONVENTION_CLASS", "no", _lines(_F) + " WHERE line = 'class order_box'", text="'order_box'",
    ),
    "SHORT_VARIABLE_NAME": _row_sql(
        "SHORT_VARIABLE_NAME", "no", _lines(_F) + " WHERE line LIKE '%$r = rand%'", text="'r'",
    ),
    "MISSING_DOCUMENTATION": _row_sql(
        "MISSING_DOCUMENTATION", "no",
        f"""{_lines(_F)} JOIN (SELECT path AS p2, entry_index AS k FROM {_F}) q ON path = p2
            WHERE line LIKE 'public function total(%' AND (k % 10 <> 0 OR k % 20 = 0)""",
        text="'total'",
    ),
    "MISSING_CLASS_DOCUMENTATION": _row_sql(
        "MISSING_CLASS_DOCUMENTATION", "no",
        f"""{_lines(_F)} JOIN (SELECT path AS p2, entry_index AS k FROM {_F}) q ON path = p2
            WHERE line = 'class order_box' AND k % 10 <> 0""",
        text="'order_box'",
    ),
    "INCONSISTENT_INDENTATION": _row_sql(
        "INCONSISTENT_INDENTATION", "greatest(s, t)",
        f"""(SELECT path, min(no) FILTER (WHERE starts_with(line, '    ')) AS s,
                    min(no) FILTER (WHERE starts_with(line, chr(9))) AS t
             FROM {_lines(_F)} GROUP BY path) z WHERE s IS NOT NULL AND t IS NOT NULL""",
    ),
    "DEEP_NESTING": _row_sql(
        "DEEP_NESTING", "no",
        f"""(SELECT path, no, (strlen(line) - strlen(ltrim(line, ' ' || chr(9)))) // 4 AS n
             FROM {_lines(_F)}) z WHERE n > 4""",
        number="n",
    ),
    "LINE_TOO_LONG": _row_sql(
        "LINE_TOO_LONG", "no",
        f"(SELECT path, no, strlen(line) AS n FROM {_lines(_F)}) z WHERE n > 120", number="n",
    ),
    "MISSING_STRICT_TYPES": _row_sql(
        "MISSING_STRICT_TYPES", "1",
        f"{_F} WHERE ends_with(path, '.php') AND NOT contains(content, 'declare(strict_types=1);')",
    ),
    "UNUSED_IMPORT": _row_sql(
        "UNUSED_IMPORT", "no",
        f"""{_lines(_F)} JOIN (SELECT path AS p2, entry_index AS k FROM {_F}) q ON path = p2
            WHERE line = 'use Foo;' AND k % 6 <> 0""",
        text="'Foo'",
    ),
    "TRAILING_WHITESPACE": _row_sql(
        "TRAILING_WHITESPACE", "no",
        _lines("part_files") + r" WHERE regexp_matches(line, '[ \t\x0B\f\r]$')",
    ),
}

_SECURITY = (
    "SQL_INJECTION", "XSS_VULNERABILITY", "HARDCODED_SECRET", "INSECURE_RANDOM",
    "PATH_TRAVERSAL", "COMMAND_INJECTION", "FILE_INCLUSION",
)
_RULE_IDS = {
    "SQL_INJECTION": "C1", "XSS_VULNERABILITY": "C2", "HARDCODED_SECRET": "C3", "INSECURE_RANDOM": "C4",
    "PATH_TRAVERSAL": "C5", "COMMAND_INJECTION": "C6", "FILE_INCLUSION": "C7", "FUNCTION_TOO_LONG": "C8",
    "FILE_TOO_LONG": "C9", "HIGH_COMPLEXITY": "C10", "NAMING_CONVENTION_FUNCTION": "C11",
    "NAMING_CONVENTION_CLASS": "C12", "SHORT_VARIABLE_NAME": "C13", "MISSING_DOCUMENTATION": "C14",
    "MISSING_CLASS_DOCUMENTATION": "C15", "INCONSISTENT_INDENTATION": "C16", "DEEP_NESTING": "C17",
    "LINE_TOO_LONG": "C18", "MISSING_STRICT_TYPES": "C19", "UNUSED_IMPORT": "C20",
    "TRAILING_WHITESPACE": "C21",
}

for _rule_id, _id in _RULE_IDS.items():
    _files = "part_files" if _rule_id == "TRAILING_WHITESPACE" else _F
    _body = _pattern_sql(_rule_id, _files) if _rule_id in _SECURITY else _STYLE_SQL[_rule_id]
    query(_id, sql=with_sql(_files, body=_body), name=f"rule_{_rule_id.lower()}")(
        _detect(_files, _rule_id)
    )

query(
    "C3", name="rule_hardcoded_secret_documents",
    sql=with_sql("document_files", body=_pattern_sql("HARDCODED_SECRET", "document_files")),
)(_detect("document_files", "HARDCODED_SECRET"))
query(
    "C18", name="rule_line_too_long_documents",
    sql=with_sql("document_files", body=_STYLE_SQL["LINE_TOO_LONG"].replace(_F, "document_files")),
)(_detect("document_files", "LINE_TOO_LONG"))
query(
    "C18", name="rule_line_too_long_pages",
    sql=with_sql("page_files", body=_STYLE_SQL["LINE_TOO_LONG"].replace(_F, "page_files")),
)(_detect("page_files", "LINE_TOO_LONG"))


@query(
    "D1", "D2", "D3", "D4", "D5", "D6",
    sql=with_sql(_F, body=f"""
SELECT path, CAST(c AS INT) AS cyclomatic_complexity, CAST(strlen(content) AS BIGINT) AS code_length,
  CAST(len(string_split(content, chr(10))) AS INT) AS lines_of_code,
  CAST(len(regexp_extract_all(content, '(?i)\\bfunction\\s+\\w+\\s*\\(')) AS INT) AS function_count,
  CAST(len(regexp_extract_all(content, '(?i)\\bclass\\s+\\w+')) AS INT) AS class_count,
  CASE WHEN c <= 10 THEN 'low' WHEN c <= 20 THEN 'medium' WHEN c <= 50 THEN 'high'
       ELSE 'very_high' END AS complexity_level
FROM (SELECT *, 1 + 20 * CAST(entry_index % 7 = 0 AS INT) + 2 * coalesce(w, 0) AS c FROM {_F}
      LEFT JOIN (SELECT l_orderkey, count(*) AS w FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1)
      ON l_orderkey = entry_index)"""),
)
def metrics_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.file_metrics(mapped(spark, sf_dir, _F)).select("path", *R.METRIC_COLUMNS)


@query(
    "D2", "D3", "D4", "D5",
    sql=with_sql("document_files", body="""
SELECT path, CAST(strlen(content) AS BIGINT) AS code_length,
  CAST(len(string_split(content, chr(10))) AS INT) AS lines_of_code,
  CAST(len(regexp_extract_all(content, '(?i)\\bfunction\\s+\\w+\\s*\\(')) AS INT) AS function_count,
  CAST(len(regexp_extract_all(content, '(?i)\\bclass\\s+\\w+')) AS INT) AS class_count,
  CAST(1 AS INT) AS cyclomatic_complexity
FROM document_files"""),
)
def metrics_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.file_metrics(mapped(spark, sf_dir, "document_files")).select(
        "path", "code_length", "lines_of_code", "function_count", "class_count", "cyclomatic_complexity"
    )


def _union_sql(bodies: list[str]) -> str:
    return "\nUNION ALL\n".join(bodies)


_CODE_ISSUES = _union_sql(
    [_pattern_sql(r, _F) for r in _SECURITY]
    + [_STYLE_SQL[r] for r in _RULE_IDS if r in _STYLE_SQL and r != "TRAILING_WHITESPACE"]
)
_DOC_ISSUES = _union_sql(
    [_pattern_sql(r, "document_files") for r in _SECURITY]
    + [_STYLE_SQL["LINE_TOO_LONG"].replace(_F, "document_files")]
    + [_STYLE_SQL["DEEP_NESTING"].replace(_F, "document_files")]
    + [_STYLE_SQL["FILE_TOO_LONG"].replace(_F, "document_files")]
)
_COUNTS = """
  CAST(count(*) FILTER (WHERE severity = 'critical') AS INT) AS critical_count,
  CAST(count(*) FILTER (WHERE severity = 'major') AS INT) AS major_count,
  CAST(count(*) FILTER (WHERE severity = 'minor') AS INT) AS minor_count,
  CAST(count(*) FILTER (WHERE severity = 'info') AS INT) AS info_count,
  CAST(count(severity) AS INT) AS total_issues"""
_POINTS = "100 - 10 * critical_count - 5 * major_count - 2 * minor_count - info_count"
_CODE_SCORES = f"""
code_issues AS MATERIALIZED ({_CODE_ISSUES}),
counted AS (SELECT f.run_id, f.path, f.entry_index, {_COUNTS}
  FROM {_F} f LEFT JOIN code_issues i ON f.path = i.path GROUP BY 1, 2, 3),
leveled AS (SELECT *, 1 + 20 * CAST(entry_index % 7 = 0 AS INT) + 2 * coalesce(w, 0) AS c FROM counted
  LEFT JOIN (SELECT l_orderkey, count(*) AS w FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1)
  ON l_orderkey = entry_index),
scored AS (SELECT *, CAST(greatest(0, least(100, {_POINTS}
  - CASE WHEN c > 50 THEN 20 WHEN c > 20 THEN 10 WHEN c > 10 THEN 5 ELSE 0 END)) AS INT) AS score
  FROM leveled)"""
_DOC_SCORES = f"""
doc_issues AS MATERIALIZED ({_DOC_ISSUES}),
counted AS (SELECT f.run_id, f.path, {_COUNTS}
  FROM document_files f LEFT JOIN doc_issues i ON f.path = i.path GROUP BY 1, 2),
scored AS (SELECT *, CAST(greatest(0, least(100, {_POINTS})) AS INT) AS score FROM counted)"""


def _scored_sql(files: str, body: str) -> str:
    ctes = _CODE_SCORES if files == _F else _DOC_SCORES
    return with_sql(files, body="").rstrip() + ",\n" + ctes + "\n" + body


_RUN_SUMMARY = """
SELECT *, concat('Analyzed ', CAST(files_analyzed AS VARCHAR), ' files. Score: ',
  CAST(average_score AS VARCHAR), '/100. Issues: ', CAST(total_issues AS VARCHAR)) AS summary
FROM (SELECT run_id, CAST(count(*) AS INT) AS files_analyzed,
  CAST(sum(total_issues) AS BIGINT) AS total_issues,
  CAST(round(avg(score), 2) AS DECIMAL(5,2)) AS average_score FROM scored GROUP BY run_id)"""


@query("I1", "J2", sql=with_sql(_F, body=_CODE_ISSUES))
def analyze_code_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules in one scan; the issue rows of the three rule families together."""
    return R.detect(mapped(spark, sf_dir, _F)).select(*ISSUE_COLUMNS)


@query(
    "E1", "D7", "D8", "D9",
    sql=_scored_sql(_F, """
SELECT run_id, path, critical_count, major_count, minor_count, info_count, total_issues, score,
  CASE WHEN score < 50 THEN 'very_high' WHEN score < 70 THEN 'high' WHEN score < 85 THEN 'medium'
       ELSE 'low' END AS quality_level,
  CASE WHEN score < 50 THEN 'red' WHEN score < 80 THEN 'yellow' ELSE 'green' END AS band FROM scored"""),
)
def file_scores_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    analyzed = R.analyze_files(mapped(spark, sf_dir, _F))
    return analyzed.select(
        "run_id", "path", *R.COUNT_COLUMNS, "total_issues", "score", "quality_level", "band"
    )


@query("E3", "J11", "J21", sql=_scored_sql(_F, _RUN_SUMMARY))
def run_summary_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.run_summary(R.analyze_files(mapped(spark, sf_dir, _F)))


@query("E3", "C1", "C3", "C18", sql=_scored_sql("document_files", _RUN_SUMMARY))
def run_summary_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.run_summary(R.analyze_files(mapped(spark, sf_dir, "document_files")))


@query(
    "E3",
    sql=_scored_sql(_F, """
SELECT CAST(count(*) AS INT) AS files_analyzed, CAST(sum(total_issues) AS BIGINT) AS total_issues,
  CAST(round(avg(score), 2) AS DECIMAL(5,2)) AS average_score FROM scored"""),
)
def overall_summary_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.overall_summary(R.analyze_files(mapped(spark, sf_dir, _F)))


@query(
    "E2",
    sql=with_sql(_F, body=f"""
SELECT f.path, s.severity, i.line_number, i.category, i.message, i.rule_id, i.suggested_fix, i.pattern_order
FROM {_F} f CROSS JOIN (VALUES ('critical'), ('major'), ('minor'), ('info')) s(severity)
LEFT JOIN ({_CODE_ISSUES}) i ON i.path = f.path AND i.severity = s.severity"""),
)
def issues_grouped_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = R.issues_by_severity(R.analyze_files(mapped(spark, sf_dir, _F)))
    listed = grouped.select("path", F.explode("by_severity").alias("severity", "issues"))
    names = ("line_number", "category", "message", "rule_id", "suggested_fix", "pattern_order")
    return listed.select("path", "severity", F.explode_outer("issues").alias("i")).select(
        "path", "severity", *[f"i.{n}" for n in names]
    )


@query(
    "D7", "E1",
    sql=with_sql("issues", body=f"""
SELECT run_id, path, {_COUNTS.replace("count(severity)", "count(*)")}
FROM issues GROUP BY 1, 2"""),
)
def stored_file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts from stored issue rows."""
    return S.file_summary(mapped(spark, sf_dir, "issues"))


@query(
    "E4",
    sql=with_sql("issues", body="""
SELECT run_id, severity, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT run_id, lower(severity) AS severity, count(*) AS n FROM issues GROUP BY 1, 2
  UNION ALL SELECT DISTINCT run_id, unnest(['error', 'warning', 'info']), 0 FROM issues)
GROUP BY 1, 2"""),
)
def run_severity_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.severity_map(mapped(spark, sf_dir, "issues"))
