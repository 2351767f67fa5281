"""The versioned store: commits as a whole, killed and concurrent jobs, cascades."""

import pytest
from pyspark.sql import functions as F

from codegauge.sources.store import Manifest, Store

KEYS = {"runs": "run_id", "issues": "run_id"}


def tables(spark, runs, status="old"):
    one = spark.createDataFrame([(r, status) for r in runs], "run_id long, status string")
    many = spark.createDataFrame([(r, k, status) for r in runs for k in range(3)], "run_id long, line int, note string")
    return {"runs": one, "issues": many}


def held(store, manifest=None):
    manifest = manifest or store.manifest()
    return (
        sorted(tuple(r) for r in store.read("runs", manifest).collect()),
        sorted(tuple(r) for r in store.read("issues", manifest).collect()),
    )


def expected(runs):
    return sorted(runs.items()), sorted((r, k, s) for r, s in runs.items() for k in range(3))


def test_commits_replace_runs_as_a_whole(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.manifest() == Manifest() and store.numbers() == []
    first = store.replace(tables(spark, range(20)), KEYS, buckets=4)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "store" / "data").rglob("*.parquet")}
    for _ in range(2):  # repeating a job changes nothing
        store.replace(tables(spark, [3, 99], "new"), KEYS)
        assert held(store) == expected({**dict.fromkeys(range(20), "old"), 3: "new", 99: "new"})
    # an earlier commit stays readable, its files are untouched, and most buckets were not rewritten
    assert held(store, first) == expected(dict.fromkeys(range(20), "old"))
    assert {p: p.stat().st_mtime_ns for p in files} == files
    assert len(set(first.tables["runs"].folders.values()) & set(store.manifest().tables["runs"].folders.values())) >= 2
    assert len(store.read("runs", buckets=[0]).inputFiles()) < len(store.read("runs").inputFiles())
    # runs that go without new rows, and vacuum of what nobody names
    store.replace(tables(spark, []), KEYS, gone=spark.createDataFrame([(3,), (None,)], "run_id long"))
    assert held(store) == expected({**{k: "old" for k in range(20) if k != 3}, 99: "new"})
    assert store.vacuum(1) >= 1 and len(store.numbers()) == 1  # the oldest commit's folder may still be named
    assert len(held(store)[0]) == 20


def test_a_killed_commit_leaves_the_store(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    store.replace(tables(spark, range(5)), KEYS, buckets=4)
    before = held(store)

    def killed(self, manifest):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(Store, "publish", killed)
        store.replace(tables(spark, [1, 7], "half"), KEYS)
    assert held(store) == before
    # killed between two tables: the first is written, nothing is seen
    write = Store.write

    def second_fails(self, commit, name, rows, table):
        if name == "issues":
            raise OSError("disk")
        return write(self, commit, name, rows, table)

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(Store, "write", second_fails)
        store.replace(tables(spark, [1, 7], "half"), KEYS)
    assert held(store) == before and store.numbers() == [1]
    assert store.vacuum() == 2
    assert held(store) == before


def test_two_jobs_on_different_runs_both_land(spark, tmp_path):
    store, other = (Store(spark, str(tmp_path / "store")) for _ in range(2))
    store.replace(tables(spark, range(4)), KEYS, buckets=1)  # one bucket, so both rewrite the same
    publish, met = Store.publish, []

    class Slow(Store):
        def publish(self, manifest):
            if not met:
                met.append(True)
                other.replace(tables(spark, [2, 8], "other"), KEYS)
            return publish(self, manifest)

    Slow(spark, str(tmp_path / "store")).replace(tables(spark, [1, 9], "mine"), KEYS)
    assert held(store) == expected({0: "old", 3: "old", 2: "other", 8: "other", 1: "mine", 9: "mine"})
    assert store.numbers() == [1, 2, 3]


def test_cascade_reads_only_buckets_of_what_goes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    users = spark.range(8).select("id", F.lit("u").alias("name"))
    runs = spark.range(80).select("id", (F.col("id") % 8).alias("user_id"))
    issues = spark.range(400).select((F.col("id") % 80).alias("run_id"), F.when(F.col("id") % 3 > 0, "x").alias("note"))
    store.replace({"users": users, "runs": runs, "issues": issues}, {"users": "id", "runs": "user_id", "issues": "run_id"}, buckets=16)
    before = store.manifest()
    references = (("runs", "user_id", "users"), ("issues", "run_id", "runs"), ("metrics", "run_id", "runs"))
    after = store.delete("users", F.col("id") == 5, references)
    assert store.read("users").count() == 7
    assert store.read("runs").where("user_id = 5").count() == 0 and store.read("runs").count() == 70
    assert store.read("issues").count() == 350 and store.read("issues").where("note IS NULL").count() > 0
    moved = {b for b, f in after.tables["runs"].folders.items() if before.tables["runs"].folders.get(b) != f}
    assert len(moved) <= 1 and after.number == before.number + 1
    same = store.delete("users", F.col("id") > 1000, references)
    assert {n: t.folders for n, t in same.tables.items()} == {n: t.folders for n, t in after.tables.items()}
