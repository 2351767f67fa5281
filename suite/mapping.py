"""The given tables seen as files, repositories, runs, issues and requests.

Each mapping is a list of SQL expressions that Spark and DuckDB both accept, so
a query and its SQL check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegauge.sources.tables import read_table

REPO_PATH = "concat(lower(c_mktsegment), '/repo', CAST(c_custkey AS STRING))"

REPOSITORIES = (
    "customer",
    [
        "c_custkey AS id",
        "CAST(c_nationkey AS BIGINT) AS user_id",
        "c_custkey + 100000 AS github_repo_id",
        "concat('repo', CAST(c_custkey AS STRING)) AS name",
        f"CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE {REPO_PATH} END AS full_name",
        f"""CASE c_custkey % 4 WHEN 0 THEN concat('https://github.com/', {REPO_PATH})
            WHEN 1 THEN concat('https://github.com/', {REPO_PATH}, '.git')
            WHEN 2 THEN concat(' https://GitHub.com/', {REPO_PATH}, '//')
            ELSE concat('http://github.com/', {REPO_PATH}, '.git/') END AS clone_url""",
        "'git' AS provider",
    ],
)

_SCORE = "CAST((o_orderkey % 10001) / 100.0 AS DECIMAL(5,2))"

RUNS = (
    "orders",
    [
        "o_orderkey AS id",
        "o_custkey AS repository_id",
        "concat('branch-', substring(o_orderpriority, 1, 1)) AS branch_name",
        "'main' AS default_branch",
        "concat(md5(CAST(o_custkey AS STRING)), '00000000') AS base_commit_sha",
        "concat(md5(concat(o_orderpriority, o_orderstatus)), '00000000') AS head_commit_sha",
        """CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running'
           ELSE 'failed' END AS status""",
        "CAST(o_orderkey % 60 AS INT) AS files_analyzed",
        f"""CASE WHEN o_orderkey % 7 = 0 THEN CAST(0 AS DECIMAL(5,2))
            ELSE {_SCORE} END AS average_score""",
        "CAST(floor(o_totalprice / 1000) AS INT) AS total_issues",
        f"""CASE WHEN o_orderstatus = 'F' THEN concat('Analyzed ', CAST(o_orderkey % 60 AS STRING),
            ' files. Score: ', CAST({_SCORE} AS STRING), '/100. Issues: ',
            CAST(CAST(floor(o_totalprice / 1000) AS INT) AS STRING)) END AS summary""",
        "o_orderdate AS created_at",
        """CASE WHEN o_orderstatus = 'F' AND o_orderkey % 10 <> 0
           THEN o_orderdate + (o_orderkey % 90) * INTERVAL '1' SECOND END AS completed_at""",
    ],
)

ISSUES = (
    "lineitem",
    [
        """concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING),
           CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING),
           CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)) AS id""",
        "l_orderkey AS run_id",
        """concat('src/', CAST(l_suppkey AS STRING), '/f', CAST(l_partkey % 5 AS STRING), '.php')
           AS path""",
        "CAST(l_quantity AS INT) AS line_number",
        """CASE WHEN l_linenumber = 1 THEN 'critical' WHEN l_linenumber <= 3 THEN 'major'
           WHEN l_linenumber <= 5 THEN 'minor' ELSE 'info' END AS severity""",
        """CASE l_returnflag WHEN 'A' THEN 'security' WHEN 'N' THEN 'style'
           ELSE 'complexity' END AS category""",
        """CASE l_linenumber
           WHEN 1 THEN 'Potential SQL Injection vulnerability detected.'
           WHEN 3 THEN concat('Deep nesting detected (level ',
                              CAST(CAST(l_quantity AS INT) % 4 + 5 AS STRING), ').')
           WHEN 4 THEN concat('Line exceeds 120 characters (',
                              CAST(CAST(l_quantity AS INT) + 120 AS STRING), ' characters).')
           WHEN 5 THEN 'Inconsistent indentation detected.'
           ELSE 'Missing strict_types declaration.' END AS message""",
        """CASE l_linenumber WHEN 1 THEN 'SQL_INJECTION' WHEN 3 THEN 'DEEP_NESTING'
           WHEN 4 THEN 'LINE_TOO_LONG' WHEN 5 THEN 'INCONSISTENT_INDENTATION'
           ELSE 'MISSING_STRICT_TYPES' END AS rule_id""",
        "l_shipdate AS created_at",
    ],
)

REQUESTS = (
    "events",
    [
        "event_id",
        "concat('10.0.0.', CAST(user_id % 256 AS STRING), ':user:', CAST(user_id AS STRING)) AS client_id",
        "ts",
        "event_type",
        "value",
    ],
)

DOCUMENTS = (
    "documents",
    [
        "source AS run_id",
        "CAST(doc_id AS INT) AS entry_index",
        "concat(source, '/', CAST(doc_id AS STRING), '.txt') AS path",
        "text AS content",
    ],
)

PAGES = (
    "pages",
    [
        "'pages' AS run_id",
        "CAST(page_id AS INT) AS entry_index",
        "concat('site/', CAST(page_id AS STRING), '.html') AS path",
        "html AS content",
    ],
)

# Short texts, some of whose lines end in blanks or tabs.
PARTS = (
    "part",
    [
        "'parts' AS run_id",
        "CAST(p_partkey AS INT) AS entry_index",
        "concat('parts/', CAST(p_partkey AS STRING), '.txt') AS path",
        """concat(rpad(p_name, 12, ' '), chr(10), p_type,
           CASE WHEN p_size > 25 THEN chr(9) ELSE '' END, chr(10), p_brand) AS content""",
    ],
)

MAPPED = {
    "part_files": PARTS,
    "repositories": REPOSITORIES,
    "runs": RUNS,
    "issues": ISSUES,
    "requests": REQUESTS,
    "document_files": DOCUMENTS,
    "page_files": PAGES,
}

# One statement per line item: the indent follows the return flag, the wrapping
# the supplier, the trailing comment the line status.
_NL = "chr(10)"
_CORE = """CASE l_linenumber
    WHEN 1 THEN '$query = "SELECT * FROM t WHERE id = $id";'
    WHEN 2 THEN concat('echo $_GET[', chr(39), 'k', chr(39), '];')
    WHEN 3 THEN concat('$token = "', lpad(CAST(l_partkey AS STRING), 12, '0'), '";')
    WHEN 4 THEN '$r = rand(1, 9);'
    WHEN 5 THEN concat('include $_GET[', chr(39), 'p', chr(39), '];')
    WHEN 6 THEN 'exec("ls $dir");'
    ELSE concat('require_once($_POST[', chr(39), 'f', chr(39), ']);') END"""
STATEMENT = f"""concat(
    CASE l_returnflag WHEN 'R' THEN repeat(' ', 20) WHEN 'A' THEN chr(9) ELSE '    ' END,
    CASE WHEN l_suppkey % 2 = 0 THEN concat('if ($aa && $bb) {{ ', {_CORE}, ' }}') ELSE {_CORE} END,
    CASE WHEN l_linestatus = 'O' THEN concat(' // if while ', repeat('x', 120)) ELSE '' END)"""

# What stands before and after the statements of an order.
HEAD = f"""concat('<?php', {_NL},
    CASE WHEN o_orderkey % 2 = 0 THEN concat('declare(strict_types=1);', {_NL}) ELSE '' END,
    CASE WHEN o_orderkey % 3 = 0 THEN concat('use Foo;', {_NL}) ELSE '' END,
    CASE WHEN o_orderkey % 6 = 0 THEN concat('$foo = new Foo();', {_NL}) ELSE '' END,
    CASE WHEN o_orderkey % 5 = 0 THEN concat(
        CASE WHEN o_orderkey % 10 = 0 THEN concat('/** Holds one order. */', {_NL}) ELSE '' END,
        'class order_box', {_NL}, '{{', {_NL},
        CASE WHEN o_orderkey % 20 = 0 THEN concat('# ', repeat('y', 230), {_NL}) ELSE '' END,
        'public function total($sum)', {_NL}, '{{', {_NL}, '}}', {_NL}, '}}', {_NL}) ELSE '' END,
    CASE WHEN o_orderkey % 7 = 0
         THEN concat(repeat('if ($aa || $bb) {{}}', 10), {_NL}) ELSE '' END,
    'function load_order($key) {{', {_NL})"""
TAIL = f"""concat({_NL},
    CASE WHEN o_orderpriority = '1-URGENT' THEN repeat({_NL}, 51) ELSE '' END, '}}', {_NL},
    CASE WHEN o_orderkey % 50 = 0 THEN repeat({_NL}, 500) ELSE '' END)"""
CODE_PATH = """concat(CASE WHEN o_orderkey % 11 = 0 THEN 'vendor/' ELSE '' END,
    c_mktsegment, '/', n_name, '/order_', CAST(o_orderkey AS STRING),
    CASE o_orderpriority WHEN '1-URGENT' THEN '.php' WHEN '2-HIGH' THEN '.php'
         WHEN '3-MEDIUM' THEN '.js' WHEN '4-NOT SPECIFIED' THEN '.PY' ELSE '.txt' END)"""

_CODE_SQL = f"""
SELECT o_custkey AS run_id, CAST(o_orderkey AS INT) AS entry_index, {CODE_PATH} AS path,
       concat({HEAD}, coalesce(body, ''), {TAIL}) AS content
FROM orders
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (
    SELECT l_orderkey, string_agg(stmt, chr(10) ORDER BY l_linenumber, stmt) AS body
    FROM (SELECT l_orderkey, l_linenumber, {STATEMENT} AS stmt FROM lineitem)
    GROUP BY l_orderkey) b ON o_orderkey = l_orderkey
"""


def mapped_sql(name: str) -> str:
    """The mapping as a DuckDB query."""
    if name == "code_files":
        return _CODE_SQL
    table, columns = MAPPED[name]
    return f"SELECT {', '.join(columns)} FROM {table}"


def with_sql(*names: str, body: str) -> str:
    """A DuckDB query whose mapped tables are common table expressions."""
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({mapped_sql(n)})" for n in names)
    return f"WITH {ctes}\n{body}"


def mapped(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The mapping as a DataFrame."""
    if name == "code_files":
        return code_files(spark, sf_dir)
    table, columns = MAPPED[name]
    return read_table(spark, sf_dir, table).selectExpr(*columns)


def even_tasks(spark: SparkSession) -> int:
    """A given number of partitions, which are not merged by their packed size into few long tasks."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files written from orders and line items: a file is one order.

    Orders and the few columns of the line items that statements need are dealt by order to a
    given number of partitions; statements and texts are made behind that, so neither is
    shuffled, and the files are spread over all tasks, as a table of files would be. Partitions
    merged by their packed size would be few and long tasks.
    """
    tasks = even_tasks(spark)
    items = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"
    )
    statements = items.repartition(tasks, "l_orderkey").selectExpr("l_orderkey", "l_linenumber", f"{STATEMENT} AS stmt")
    # Structs are never null, so sort_array has the order of array_sort without a comparison by lambda.
    bodies = statements.groupBy("l_orderkey").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("l_linenumber", "stmt")))["stmt"], "\n").alias("body")
    )
    orders = read_table(spark, sf_dir, "orders")
    customers = read_table(spark, sf_dir, "customer")
    nations = read_table(spark, sf_dir, "nation")
    named = (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", "o_custkey", "o_orderpriority", "c_mktsegment", "n_name")
    )
    joined = named.repartition(tasks, "o_orderkey").join(bodies, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.selectExpr(
        "o_custkey AS run_id",
        "CAST(o_orderkey AS INT) AS entry_index",
        f"{CODE_PATH} AS path",
        f"concat({HEAD}, coalesce(body, ''), {TAIL}) AS content",
    )
