"""Readers, selection, results, snapshots and stores."""

import hashlib
import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from codegauge.operators import rules as R
from codegauge.operators import scoring as S
from codegauge.operators import selection as B
from codegauge.operators.rules import analyze_files
from codegauge.sources import exposition as X
from codegauge.sources import files as A
from codegauge.sources import results as O
from codegauge.sources import snapshots as N


def archive(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark, tmp_path):
    good = archive([
        ("root/", b""), ("root/a.php", b"\xef\xbb\xbf<?php"), ("root/vendor/b.php", b"x"), ("root/c.txt", b"x"),
        ("root/d/e.JS", b"caf\xe9"), ("other/f.py", b"1"), ("root/big.php", b"a" * 600_000),
    ])
    (tmp_path / "good.zip").write_bytes(good)
    (tmp_path / "bad.zip").write_bytes(b"not an archive")
    broken = bytearray(archive([("r/a.php", b"hello hello"), ("r/b.php", b"fine")]))
    broken[broken.index(b"hello")] = ord("j")
    (tmp_path / "broken.zip").write_bytes(bytes(broken))
    rows = A.read_archives(spark, str(tmp_path), max_bytes=B.MAX_FILE_BYTES).collect()
    by_name = {(r["archive"].rsplit("/", 1)[1], r["path"]): r for r in rows}
    assert by_name["good.zip", "a.php"]["content"] == "<?php"
    assert by_name["good.zip", "d/e.JS"]["content"] == "caf�"
    assert ("good.zip", "other/f.py") in by_name
    assert not {p for _, p in by_name} & {"vendor/b.php", "c.txt"}
    assert by_name["good.zip", "big.php"]["error"] == B.TOO_LARGE and by_name["good.zip", "big.php"]["content"] is None
    assert by_name["bad.zip", None]["error"]
    assert by_name["broken.zip", "a.php"]["error"] and by_name["broken.zip", "b.php"]["content"] == "fine"
    whole = {r["path"]: r for r in A.read_archives(spark, str(tmp_path), rejects=True).collect()}
    assert len(whole["big.php"]["content"]) == 600_000
    assert (whole["vendor/b.php"]["error"], whole["c.txt"]["error"]) == (B.IGNORED_FOLDER, B.OTHER_EXTENSION)
    limited = A.read_archives(spark, str(tmp_path), max_archive_bytes=len(good) - 1).where(f"error = '{B.TOO_LARGE}'").collect()
    assert [(r["archive"].rsplit("/", 1)[1], r["size_bytes"]) for r in limited] == [("good.zip", len(good))]


def test_nothing_is_cut_by_default(spark, tmp_path):
    big = b"<?php\n" + b"$q = rand(1);\n" * 45_000  # over the usual 512,000 bytes of a file
    stored = io.BytesIO()
    with zipfile.ZipFile(stored, "w", zipfile.ZIP_STORED) as z:
        z.writestr("r/big.php", big)
        z.writestr("r/pad.py", os.urandom(3_000_000))
    (tmp_path / "big.zip").write_bytes(stored.getvalue())
    rows = A.read_archives(spark, str(tmp_path)).select("path", F.length("content").alias("n"), "size_bytes", "error")
    got = {r["path"]: r for r in rows.collect()}
    assert got["big.php"]["n"] == len(big) and got["pad.py"]["size_bytes"] == 3_000_000
    files = B.select_files(A.read_archives(spark, str(tmp_path)).where("path = 'big.php'"))
    assert analyze_files(files.withColumn("run_id", F.lit(1))).first()["lines_of_code"] > 45_000


def test_one_archive_is_read_by_many_tasks(spark, tmp_path):
    folder = tmp_path / "my archives+%20"
    folder.mkdir()
    stored = io.BytesIO()
    with zipfile.ZipFile(stored, "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(300):
            z.writestr(f"r/d{k % 7}/f{k}.php", os.urandom(300).hex() + "é", compress_type=(zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2)[k % 3])
        z.writestr("r/vendor/x.php", "no")
        z.writestr("r/empty.js", "")
    data = bytearray(stored.getvalue())
    data[data.index(b"PK\x03\x04", 1000)] = 0  # one header is broken
    (folder / "hot.zip").write_bytes(bytes(data))
    (folder / "none.zip").write_bytes(b"PK")
    (folder / "blank.zip").write_bytes(b"PK\x05\x06" + bytes(18))
    for options in ({}, {"rejects": True}, {"max_bytes": 100}):
        rows = A.read_archives(spark, str(folder), split_bytes=5000, **options)
        whole = spark.read.format("binaryFile").load(str(folder)).select(F.col("path").alias("archive"), "content")
        plain = A.archive_entries(whole, **options)
        got, want = (sorted(map(repr, f.select("archive", "entry_index", "path", "content", "size_bytes").collect())) for f in (rows, plain))
        assert got == want
        broken = [r["path"] for r in rows.where("error IS NOT NULL AND path IS NOT NULL AND content IS NULL").collect()]
        assert broken if options else len(broken) == 1
    rows = A.read_archives(spark, str(folder), split_bytes=5000)
    assert rows.select(F.spark_partition_id()).distinct().count() > 3


def test_loose_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "vendor").mkdir()
    (tmp_path / "src" / "a b+c.php").write_text("<?php\nif")
    (tmp_path / "src" / "n.txt").write_text("x")
    (tmp_path / "vendor" / "v.php").write_text("x")
    rows = A.read_files(spark, str(tmp_path)).collect()
    assert [(r["path"], r["content"], r["size_bytes"]) for r in rows] == [("src/a b+c.php", "<?php\nif", 8)]


def test_loose_files_equal_archived_ones(spark, tmp_path):
    contents = {
        "a.php": b"\xef\xbb\xbf<?php", "t/src/deep/y.php": b"caf\xe9 \xf0\x9f\x98 \xe2\x82", "50%/x+y z#1.py": b"a\xc0\xafb",
        "big.php": b"x" * 600_000,
    }
    root = tmp_path / "build" / "my repo%20+" / "t" / "src"
    stored = io.BytesIO()
    with zipfile.ZipFile(stored, "w") as z:
        for name, data in contents.items():
            z.writestr(f"root/{name}", data)
            (root / name).parent.mkdir(parents=True, exist_ok=True)
            (root / name).write_bytes(data)
    frame = spark.createDataFrame([("a", stored.getvalue())], "archive string, content binary")
    archived = {(r["path"], r["content"], r["size_bytes"]) for r in A.archive_entries(frame).collect()}
    loose = {(r["path"], r["content"], r["size_bytes"]) for r in A.read_files(spark, str(root)).collect()}
    assert loose == archived and len(loose) == len(contents)


def test_files_are_listed_and_read_by_tasks(spark, tmp_path):
    """The same files as Spark's own source, which lists them on the driver and plans over each."""
    names = [
        "a.php", "_a.php", "_a=b.php", ".b.php", "c.php._COPYING_", "_metadata.php", "empty.php", "é ü/d%20+.php", "_x/e.php", "_x=1/e.php",
        ".y/f.php", "_metadata/g.php", "p/q/r/s/h.php", "p/q/i.js", "p/vendor/j.php", "[k]*/l.php", "z.zip", "p/y.zip", "p/y.ZIP", "_w.zip",
    ]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(archive([("r/a.php", name.encode())]) if name.lower().endswith(".zip") else b"" if "empty" in name else name.encode())
    (tmp_path / "none").mkdir()
    (tmp_path / "linked").symlink_to(tmp_path / "p")
    (tmp_path / "gone.php").symlink_to(tmp_path / "nowhere.php")
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    start = len(f"file:{tmp_path}") + 1
    whole = {(r["path"][start:], r["content"].decode(), r["length"]) for r in source.where("path NOT ILIKE '%.zip'").collect()}
    rows = A.read_files(spark, str(tmp_path))
    got = {tuple(r) for r in rows.collect()}
    assert got == {r for r in whole if "vendor" not in r[0] and not r[0].endswith("_COPYING_")}
    assert len(got) > 8 and not any(str(tmp_path) in name for name in rows.inputFiles())
    zips = {r["archive"] for r in A.read_archives(spark, str(tmp_path)).collect()}
    assert zips == {r["path"] for r in source.where("path LIKE '%.zip'").collect()}
    assert A.read_files(spark, str(tmp_path / "none")).collect() == A.read_archives(spark, str(tmp_path / "none")).collect() == []


def test_a_stored_page_is_one_file(spark, tmp_path, monkeypatch):
    """No file is written twice, moved or accompanied; pages of one id share a file, a null page is an empty line."""
    from suite import ingest
    from suite.registry import REGISTRY

    pages = spark.createDataFrame([(k % 40, None if k == 7 else f"<p>{k % 40}é") for k in range(50)], "page_id long, html string")
    pages.write.parquet(str(tmp_path / "in" / "pages.parquet"))
    monkeypatch.setattr(ingest, "shared_folder", lambda spark, name: str(tmp_path / name))
    got = {r["page_id"]: r for r in REGISTRY["loose_file_scan"].run(spark, str(tmp_path / "in")).collect()}
    assert sorted(got) == list(range(40))
    assert len([p for p in (tmp_path / "loose").rglob("*") if p.is_file()]) == 40
    for k, r in got.items():
        text = (("\n" if k == 7 else f"<p>{k}é\n") + (f"<p>{k}é\n" if k < 10 else "")).encode()
        if k != 7:  # whose two texts come in either order
            assert r["digest"] == hashlib.md5(text).hexdigest()
        assert r["size_bytes"] == len(text)


@pytest.mark.parametrize(
    "path, size, keep",
    [
        ("test.php", None, True), ("script.js", None, True), ("component.jsx", None, True),
        ("style.css", None, True), ("file.txt", None, False), ("image.png", None, False),
        ("vendor/lib.php", None, False), ("node_modules/pkg.js", None, False), ("a/OUT/b.js", None, False),
        ("large.php", 512001, True), ("edge.php", 512000, True), ("bare.", None, False), (" ", None, False),
        ("Build", None, False), ("a.b/c", None, False), ("X.PHP", 1, True),
    ],
)
def test_wanted(spark, path, size, keep):
    frame = spark.createDataFrame([(path, size)], "path string, size_bytes long")
    assert frame.where(B.wanted(F.col("path"), F.col("size_bytes"))).count() == int(keep)


def test_size_limit_is_an_argument(spark):
    frame = spark.createDataFrame([("large.php", 2000)], "path string, size_bytes long")
    assert frame.where(B.wanted(F.col("path"), F.col("size_bytes"), limit=1000)).count() == 0


def test_sniffs(spark):
    rows = [("\x00\x01\x02a", "QUJD" * 20), ("a\n\t", "short="), ("", "plain words with blanks " * 4), (" \n", None)]
    frame = spark.createDataFrame(rows, "a string, b string")
    found = [(r[0], r[1]) for r in frame.select(B.is_binary(F.col("a")), B.is_base64(F.col("b"))).collect()]
    assert [f[0] for f in found] == [True, False, False, False]
    assert [bool(f[1]) for f in found] == [True, False, False, False]


def test_batch_validation(spark):
    rows = (
        [(1, None, None, None)]
        + [(2, i, f"{i}", b"x") for i in range(51)]
        + [(3, 0, "a", b"x" * 600_000), (3, 1, "b", b"\xff")]
        + [(4, 0, "a", b"\xff"), (4, 1, "b", b"x" * 600_000)]
        + [(5, i, f"{i}", "é".encode()) for i in range(50)]
    )
    frame = spark.createDataFrame(rows, "batch_id long, entry_index int, path string, content binary")
    found = {r["batch_id"]: (r["n_files"], r["error_code"]) for r in B.validate_batches(frame, B.MAX_FILES, B.MAX_FILE_BYTES).collect()}
    assert found == {
        1: (0, "INVALID_REQUEST"), 2: (51, "FILE_LIMIT_EXCEEDED"), 3: (2, "FILE_SIZE_EXCEEDED"),
        4: (2, "INVALID_ENCODING"), 5: (50, None),
    }


def test_requests(spark):
    bodies = [
        (1, '{"files":[{"path":"a.php","content":"x"},{"content":"y"},{"path":"c"}]}'),
        (2, '{"files":[]}'), (3, '{"files":"no"}'), (4, "{}"),
    ]
    frame = spark.createDataFrame(bodies, "batch_id long, body string")
    rows = [tuple(r) for r in A.parse_batches(frame).orderBy("batch_id", "entry_index").collect()]
    assert rows[:3] == [(1, 0, "a.php", "x"), (1, 1, "unknown", "y"), (1, 2, "c", "")]
    assert rows[3:] == [(2, None, None, None), (3, None, None, None), (4, None, None, None)]
    snippets = spark.createDataFrame(
        [(1, '{"code":"x","file_path":"a.php"}'), (2, '{"code":"0"}'), (3, '{"code":""}'), (4, "{}")],
        "request_id long, body string",
    )
    rows = [tuple(r) for r in A.parse_snippets(snippets).orderBy("request_id").collect()]
    assert rows[0] == (1, "a.php", "x", None)
    assert all(r[3] == "MISSING_REQUIRED_FIELD" and r[1] == "unknown" for r in rows[1:])


def test_first_files_cut_before_the_shuffle(spark):
    rows = [(1, i, f"f{i}") for i in range(200)] + [(2, 0, "g")]
    frame = spark.createDataFrame(rows, "run_id long, entry_index int, path string")
    kept = B.first_files(frame, 50)
    assert kept.where("run_id = 1").agg(F.count("*"), F.max("entry_index")).first() == (50, 49)
    assert kept.count() == 51
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


def test_results_round_trip(spark, tmp_path):
    files = spark.createDataFrame([(1, 'a"b.php', "<?php exec('x $q');\nrand();"), (1, "b.js", "")], "run_id long, path string, content string")
    analyzed = R.analyze_files(files)
    O.write_results(O.export_results(analyzed), str(tmp_path / "out"))
    document = json.loads(O.export_results(analyzed).where("path <> 'b.js'").first()["value"])
    assert [i["ruleId"] for i in document["issues"]] == ["INSECURE_RANDOM", "COMMAND_INJECTION", "SHORT_VARIABLE_NAME", "MISSING_STRICT_TYPES"]
    assert document["summary"]["totalIssues"] == 4 and document["score"] == 83
    back = O.issue_rows(O.read_results(spark, str(tmp_path / "out")), keep=())
    rows = {(r["file_path"], r["rule_id"], r["line_start"]) for r in back.collect()}
    assert rows == {
        ('a"b.php', "INSECURE_RANDOM", 2), ('a"b.php', "COMMAND_INJECTION", 1),
        ('a"b.php', "SHORT_VARIABLE_NAME", 1), ('a"b.php', "MISSING_STRICT_TYPES", 1),
    }


def test_key_spelling_never_touches_values(spark):
    body = json.dumps({"FILEPATH": 'a,"File_Path":b', "Issues": [{"Line": 3, "MESSAGE": '{"Line":9}', "RULE_ID": "R"}]})
    frame = spark.createDataFrame([(body,)], "value string")
    row = O.issue_rows(O.parse_results(frame), keep=()).first()
    assert row["file_path"] == 'a,"File_Path":b'
    assert (row["line_start"], row["message"], row["rule_id"], row["category"]) == (3, '{"Line":9}', "R", "General")


def test_snapshots(spark):
    rows = [(1, f"f{i}.php", i, f"text {i}", "low", i, 2 * i) for i in range(120)]
    rows += [(1, "f0.php", 500, "last", "high", 7, 8)]
    files = spark.createDataFrame(
        rows, "run_id long, path string, entry_index int, content string, quality_level string, function_count int, lines_of_code int"
    )
    packed = N.pack_snapshots(files)
    assert packed.count() == 4
    assert packed.select(F.max(F.size("file_metrics"))).first()[0] <= 50
    back = {r["path"]: r for r in N.snapshot_files(N.parse_documents(N.to_document(packed))).collect()}
    assert len(back) == 120
    assert (back["f0.php"]["content"], back["f0.php"]["quality_level"]) == ("last", "high")
    assert back["f7.php"]["lines_of_code"] == 14


def test_last_entries_within_and_across_parts(spark):
    """The last entry of a path wins in its part and over parts; a part without any is left out; repeated rows count once."""
    rows = [(1, "a", 0, "a0"), (1, "b", 1, "b1"), (1, "a", 2, "a2"), (1, "b", 70, "b70"), (1, "c", 60, "c60"), (1, "c", 120, "c120"),
            (1, "b", 70, "b70"), (2, "a", 0, "other run"), (1, "d", 3, None)]
    schema = "run_id long, path string, entry_index int, content string"
    files = spark.createDataFrame(rows, schema).selectExpr("*", "'low' AS quality_level", "1 AS function_count", "2 AS lines_of_code")
    for keys in (None, files.select("run_id", "path", "entry_index")):
        packed = N.pack_snapshots(files, 50, keys)
        got = {(r["run_id"], r["part"]): r["file_contents"] for r in packed.collect()}
        assert got == {(1, 0): {"a": "a2", "d": None}, (1, 1): {"b": "b70"}, (1, 2): {"c": "c120"}, (2, 0): {"a": "other run"}}
    assert N.pack_snapshots(files.limit(0)).collect() == []


def test_old_and_broken_snapshots(spark):
    old = '{"a.php":{"ComplexityLevel":"low","FunctionCount":1,"LinesOfCode":2}}'
    frame = spark.createDataFrame([(1, old), (2, "{broken"), (3, None)], "run_id long, metrics_json string")
    rows = {r["run_id"]: r for r in N.parse_documents(frame).collect()}
    assert rows[1]["file_metrics"]["a.php"]["LinesOfCode"] == 2 and rows[1]["file_contents"] == {}
    assert rows[2]["file_metrics"] == {} == rows[2]["file_contents"]
    assert rows[3]["file_metrics"] == {}


def test_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    folder = str(tmp_path / "runs")
    old = spark.range(100).select("id", F.lit("old").alias("status"))
    O.write_bucketed(old, folder, "id", 8)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "runs").rglob("*.parquet")}
    new = spark.createDataFrame([(3, "new"), (1000, "new")], "id long, status string")
    for _ in range(2):
        O.upsert(spark, folder, new, "id", 8)
        rows = {r["id"]: r["status"] for r in spark.read.parquet(folder).collect()}
        assert len(rows) == 101 and rows[3] == rows[1000] == "new" and rows[4] == "old"
    kept = [p for p in before if p.exists()]
    assert 5 <= len({p.parent for p in kept}) <= 7


def test_run_summary_counts_files_without_issues(spark):
    files = spark.createDataFrame([(1, "a.js", "rand("), (1, "b.js", ""), (2, "c.js", "x")], "run_id long, path string, content string")
    rows = {r["run_id"]: r for r in S.run_summary(R.analyze_files(files)).collect()}
    assert (rows[1]["files_analyzed"], rows[1]["total_issues"], str(rows[1]["average_score"])) == (2, 1, "97.50")
    assert rows[1]["summary"] == "Analyzed 2 files. Score: 97.50/100. Issues: 1"
    empty = S.overall_summary(R.analyze_files(files.where("run_id = 9"))).first()
    assert tuple(map(float, empty)) == (0, 0, 0)


def test_metric_text(spark, tmp_path):
    samples = spark.createDataFrame([("m_total", {"b": "2", "a": "1"}, "3"), ("up", {}, "1")], "name string, labels map<string,string>, value string")
    lines = X.to_text(samples, {"m_total": "Help.", "up": "Up."}, {"m_total": "counter", "up": "gauge"})
    X.write_text(lines, str(tmp_path / "m"))
    text = [r["value"] for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert text == ["# HELP m_total Help.", "# TYPE m_total counter", 'm_total{a="1",b="2"} 3', "# HELP up Up.", "# TYPE up gauge", "up 1"]


def test_analysis_job_writes_a_store(spark, tmp_path):
    from codegauge.plans.analysis import analyze_to_store, summarize_store

    files = spark.createDataFrame(
        [(1, "a.php", "<?php rand();"), (1, "b.js", "ok"), (2, "c.js", "mt_rand(1)")],
        "run_id long, path string, content string",
    )
    for _ in range(2):
        tables = analyze_to_store(files, str(tmp_path / "store"))
        assert {tuple(r) for r in summarize_store(tables).collect()} == {(1, 2, 2), (2, 1, 1)}
        assert tables["analysis_issues"].select("id").distinct().count() == 3
        assert "content" not in tables["file_metrics"].columns


def test_written_tables_go_to_the_shared_folder(spark):
    from codegauge.workspace import SETTING, shared_folder

    one, two = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert one.startswith(spark.conf.get(SETTING)) and one != two


def test_the_store_grows(spark, tmp_path):
    from codegauge.plans.analysis import ISSUES, RUNS, analyze_to_store, summarize_store

    schema = "run_id long, path string, content string"
    jobs = [
        [(1, "a.php", "<?php rand(1);"), (2, "b.php", "<?php rand(1);")], [(3, "c.php", "<?php rand(1);")],
            [(2, "b.js", "ok")],  # run 2 again, now without issues
    ]
    for job in jobs:
        tables = analyze_to_store(spark.createDataFrame(job, schema), str(tmp_path / "store"), buckets=4)
    assert {r["run_id"] for r in tables[RUNS].collect()} == {1, 2, 3}
    assert {r["run_id"] for r in tables[ISSUES].collect()} == {1, 3}
    assert {tuple(r) for r in summarize_store(tables).collect()} == {(1, 2, 2), (2, 0, 0), (3, 2, 2)}


def test_upsert_scans_only_touched_buckets(spark, tmp_path):
    folder = str(tmp_path / "runs")
    O.write_bucketed(spark.range(64).select("id", F.lit("old").alias("status")), folder, "id", 8)
    bucket = spark.range(3, 4).select(F.pmod(F.xxhash64("id"), F.lit(8))).first()[0]
    pruned = spark.read.parquet(folder).where(F.col("bucket").isin([bucket]))
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert f"bucket={bucket}" in pruned.select("_metadata.file_path").first()[0]
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_stored_archives_of_one_source_are_many(spark):
    from suite.ingest import _stored_archives

    rows = [("crawl", k, f"crawl/{k}.txt", f"text {k}") for k in range(200)] + [("wiki", k, f"wiki/{k}.txt", "w") for k in range(200, 210)]
    files = spark.createDataFrame(rows, "run_id string, entry_index int, path string, content string")
    got = _stored_archives(files).collect()
    names = {r["archive"]: zipfile.ZipFile(io.BytesIO(r["content"])).namelist() for r in got}
    assert len(got) == len(names) == 6 and max(map(len, names.values())) == 40
    assert sorted(n for v in names.values() for n in v) == sorted(f"root/{p}" for _, _, p, _ in rows)
