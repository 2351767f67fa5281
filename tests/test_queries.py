"""Every registered query runs on the smallest tables and agrees with its SQL."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from suite.registry import REGISTRY
from tools.check import TABLES, compare

# The corpus queries have their own tests.
QUERIES = {n: q for n, q in entry.queries().items() if n in REGISTRY}
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, db, name):
    frame = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in frame.collect()]
    assert len(set(frame.columns)) == len(frame.columns)
    if name in SQL:
        cursor = db.execute(SQL[name])
        names = [d[0] for d in cursor.description]
        assert compare(frame.columns, rows, names, cursor.fetchall()) is None


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.count() > 0 and "average_score" in frame.columns


def test_entry_without_the_corpus_package(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    left_out = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "spark-warehouse")
    shutil.copytree(root, tmp_path / "repo", ignore=left_out)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), *sorted(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, check=True)
    assert done.stdout.split()[2:] == sorted(REGISTRY)


def test_every_inventory_id_is_covered():
    listed = {i for q in REGISTRY.values() for i in q.ids}
    counts = {"A": 12, "B": 21, "C": 21, "D": 9, "E": 22, "F": 10, "G": 7, "H": 4, "I": 3, "J": 21, "K": 9, "L": 4}
    missing = {f"{k}{i}" for k, n in counts.items() for i in range(1, n + 1)} - listed
    assert not missing
