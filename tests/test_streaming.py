"""The streaming jobs over several micro-batches, restarts included."""

import base64

import pytest
from pyspark.sql import functions as F

from codegauge.operators import ratelimit as K
from codegauge.operators import rules as R
from codegauge.operators.catalog import Pattern, Rule
from codegauge.operators.scoring import run_summary
from codegauge.streaming import counters, intake, limits, status
from codegauge.streaming.tables import run_to_table, stream_table, write_batches


def folder_of(frames, tmp_path, name):
    """One parquet file per frame, written in order."""
    folder = str(tmp_path / name)
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_analysis_survives_a_restart_and_a_bad_batch(spark, tmp_path):
    schema = "run_id long, entry_index int, path string, content string"
    first = spark.createDataFrame([(1, 0, "a.php", "<?php rand();"), (1, 1, "b.js", "x")], schema)
    second = spark.createDataFrame([(2, 0, "c.php", "<?php exec('a $bb');")], schema)
    source = folder_of([first], tmp_path, "files")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for more in (None, second):
        if more is not None:
            more.coalesce(1).write.mode("append").parquet(source)
        files = stream_table(spark, source, first.schema, 1)
        intake.start_analysis(files, out, checkpoint).awaitTermination()
    rules = ["path", "line_number", "rule_id", "message", "run_id"]
    got = spark.read.parquet(f"{out}/issues").select(*rules)
    expected = R.detect(first.unionByName(second)).select(*rules)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    states = intake.run_states(spark, out).select("run_id", "status", "files_analyzed")
    assert sorted(map(tuple, states.collect())) == [(1, "completed", 2), (2, "completed", 1)]


def test_a_file_that_cannot_be_read_fails_its_run_alone(spark, tmp_path):
    schema = "run_id long, path string, content string"
    rows = [[(1, "a.php", "<?php rand();"), (2, "b.php", None)], [(2, "c.php", "<?php rand();"), (1, "d.js", "x")]]
    source = folder_of([spark.createDataFrame(r, schema) for r in rows], tmp_path, "files")
    out = str(tmp_path / "out")
    files = stream_table(spark, source, spark.createDataFrame(rows[0], schema).schema, 1)
    intake.start_analysis(files, out, str(tmp_path / "c")).awaitTermination()
    states = {r["run_id"]: r for r in intake.run_states(spark, out).collect()}
    whole = {r["run_id"]: r for r in run_summary(R.analyze_files(spark.createDataFrame([r for b in rows for r in b if r[2]], schema))).collect()}
    assert states[1]["status"] == "completed" and states[2]["status"] == "failed"
    for name in ("files_analyzed", "total_issues", "average_score"):
        assert [states[k][name] for k in (1, 2)] == [whole[k][name] for k in (1, 2)]
    assert states[1]["summary"] == whole[1]["summary"] and "1 files" in states[2]["summary"]


def test_a_failing_batch_is_repeated_not_lost(spark, tmp_path):
    schema = "run_id long, path string, content string"
    batches = [spark.createDataFrame([(i, "a.php", text)], schema) for i, text in ((1, "x"), (2, "y"))]
    source = folder_of(batches, tmp_path, "files")
    broken = Rule("BROKEN", "info", "style", "", "", (Pattern(("x",), "("),))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")
    for rules in ((broken,), R.DEFAULT_RULES):
        files = stream_table(spark, source, batches[0].schema, 1)
        query = intake.start_analysis(files, out, checkpoint, rules)
        if rules == (broken,):
            with pytest.raises(Exception):  # noqa: B017
                query.awaitTermination()
        else:
            query.awaitTermination()
    got = sorted((r["run_id"], r["status"]) for r in intake.run_states(spark, out).collect())
    assert got == [(1, "completed"), (2, "completed")]


def base64_files(stream):
    return stream.withColumn("content", F.to_binary("content", F.lit("base64")).cast("string"))


def test_a_run_whose_analysis_raises_fails_alone(spark, tmp_path):
    schema = "run_id long, path string, content string"
    code = lambda text: base64.b64encode(text.encode()).decode()
    many = [(k, "a.php", code("<?php rand();")) for k in range(10, 13)]
    rows = [
        [(1, "a.php", code("<?php rand();")), (2, "b.php", "***"), (2, "c.php", code("x")), (3, "d.php", None), *many],
        [(2, "e.php", code("<?php rand();")), (1, "f.js", code("x")), (None, "g.js", "***"), (4, "h.js", "*")],
    ]
    source = folder_of([spark.createDataFrame(r, schema) for r in rows], tmp_path, "files")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")
    start = lambda: intake.start_analysis(
        stream_table(spark, source, spark.createDataFrame(rows[0], schema).schema, 1), out, checkpoint, prepare=base64_files
    )
    start().awaitTermination()
    states = {r["run_id"]: r for r in intake.run_states(spark, out).collect()}
    assert {k for k, r in states.items() if r["status"] == "failed"} == {2, 3, 4, None}
    assert states[1]["files_analyzed"] == 2 and all(states[k]["files_analyzed"] == 1 for k in range(10, 13))
    assert states[2]["files_analyzed"] == 1 and states[2]["summary"].startswith("Analysis failed: [CONVERSION_INVALID_INPUT]")
    assert states[3]["summary"] == "1 files could not be read" and states[4]["average_score"] == 0
    # a restart takes what is new and changes nothing else
    before = sorted(map(repr, states.values()))
    spark.createDataFrame([(5, "i.php", code("<?php"))], schema).coalesce(1).write.mode("append").parquet(source)
    start().awaitTermination()
    after = {r["run_id"]: r for r in intake.run_states(spark, out).collect()}
    assert after.pop(5)["status"] == "completed" and sorted(map(repr, after.values())) == before


def test_failing_runs_are_few_halvings_away(spark):
    files = spark.range(40).selectExpr("id AS run_id", "'a.php' AS path", "if(id % 30 = 7, '*', 'eA==') AS content")
    assert sorted(r for r, _ in intake.failing_runs(files, R.DEFAULT_RULES, base64_files)) == [7, 37]
    assert intake.failing_runs(files.where("run_id < 7"), R.DEFAULT_RULES, base64_files) == []


def test_admission_equals_the_batch_form(spark, tmp_path):
    rows = [("a" if i % 3 else "b", i, 10**15 + i * 700_000) for i in range(400)]
    frame = spark.createDataFrame(rows, "client_id string, event_id long, t long").select(
        "client_id", "event_id", F.timestamp_micros("t").alias("ts")
    )
    parts = [frame.where((F.col("event_id") >= a) & (F.col("event_id") < a + 100)) for a in range(0, 400, 100)]
    source = folder_of(parts, tmp_path, "requests")
    stream = limits.admission_stream(stream_table(spark, source, frame.schema, 1), 3, 6)
    got = {(r["event_id"], r["admitted"]) for r in run_to_table(spark, stream, "t").collect()}
    expected = {(r["event_id"], r["admitted"]) for r in K.admission(frame, 3, 6).collect()}
    assert got == expected and len({a for _, a in got}) == 2


def test_runs_time_out(spark, tmp_path):
    def at(minute):
        return f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"

    rows = [
        [(1, "queued", at(0)), (2, "running", at(1)), (3, "running", at(2))],
        [(1, "running", at(3)), (2, "completed", at(8))],
        [(4, "running", at(70))],
        [(5, "queued", at(71)), (1, "running", at(72))],
    ]
    frames = [
        spark.createDataFrame(r, "run_id long, status string, ts string").withColumn("ts", F.to_timestamp("ts")) for r in rows
    ]
    source = folder_of(frames, tmp_path, "events")
    events = stream_table(spark, source, frames[0].schema, 1)
    got = run_to_table(spark, status.watch_runs(events, "5 minutes"), "watch")
    found = {(r["run_id"], r["status"], r["summary"], str(r["ts"])) for r in got.collect()}
    assert found == {
        (2, "completed", "", "2024-01-01 00:08:00"),
        (1, "failed", "timed out", "2024-01-01 00:10:00"),
        (3, "failed", "timed out", "2024-01-01 00:12:00"),
    }


def test_runs_time_out_without_a_call_per_run(spark, tmp_path):
    def at(minute):
        return f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"

    many = [(k, "queued", at(0)) for k in range(100, 2100)]
    rows = [
        [(1, "queued", at(0)), (2, "running", at(1)), (3, "running", at(2)), (None, "queued", at(0)), (6, "queued", at(4)), *many],
        [(1, "running", at(3)), (2, "failed", at(9)), (2, "completed", at(8)), (6, "queued", None)],
        [(2, "failed", at(9)), (4, "running", at(70))],
        [(5, "queued", at(71)), (1, "running", at(72)), (7, "completed", at(20)), (8, "completed", at(66))],
    ]
    frames = [
        spark.createDataFrame(r, "run_id long, status string, ts string").withColumn("ts", F.to_timestamp("ts")) for r in rows
    ]
    source, out = folder_of(frames, tmp_path, "events"), str(tmp_path / "watch")
    events = stream_table(spark, source, frames[0].schema, 1)
    status.watch_to_table(events, out, "5 minutes").awaitTermination()
    got = spark.read.parquet(f"{out}/out").where("run_id IS NULL OR run_id < 100")
    found = sorted((str(r["run_id"]), r["status"], r["summary"], str(r["ts"])) for r in got.collect())
    assert found == [  # 7 is late; 2 is reported once
        ("1", "failed", "timed out", "2024-01-01 00:10:00"),
        ("2", "completed", "", "2024-01-01 00:08:00"),
        ("3", "failed", "timed out", "2024-01-01 00:12:00"),
        ("6", "failed", "timed out", "2024-01-01 00:14:00"),
        ("8", "completed", "", "2024-01-01 01:06:00"),
        ("None", "failed", "timed out", "2024-01-01 00:10:00"),
    ]
    assert spark.read.parquet(f"{out}/out").where("run_id >= 100 AND summary = 'timed out'").count() == 2000


def test_status_keeps_the_first_terminal_state(spark):
    rows = [(1, "queued", 1), (1, "running", 2), (1, "failed", 3), (1, "completed", 4), (2, "queued", 1), (2, "running", 5)]
    events = spark.createDataFrame(rows, "run_id long, status string, ts long")
    assert {tuple(r) for r in status.latest_status(events).collect()} == {(1, "failed", 3), (2, "running", 5)}


def test_new_submissions_across_batches(spark, tmp_path):
    def rows(*keys):
        data = [(1, "b", k, f"2024-01-{d:02d} 00:00:00") for k, d in keys]
        frame = spark.createDataFrame(data, "repository_id long, base_commit_sha string, head_commit_sha string, created_at string")
        return frame.withColumn("created_at", F.to_timestamp("created_at"))

    batches = [rows(("x", 1), ("x", 1), ("y", 2)), rows(("z", 9), ("old", 9)), rows(("x", 20), ("w", 21))]
    source = folder_of(batches, tmp_path, "submissions")
    history = rows(("old", 1))
    out = str(tmp_path / "out")
    stream = stream_table(spark, source, batches[0].schema, 1)
    fresh, unknown = intake.new_submissions(spark, stream, history, "1 day", out)
    write_batches(fresh, out, str(tmp_path / "c"), unknown).awaitTermination()
    found = [r["head_commit_sha"] for r in spark.read.parquet(out).collect()]
    assert sorted(found) == ["w", "x", "y", "z"]


def test_live_counters(spark, tmp_path):
    frames = [spark.createDataFrame([("A", 0.5), ("b", 20.0)], "kind string, v double"), spark.createDataFrame([("a", 3.0)], "kind string, v double")]
    source = folder_of(frames, tmp_path, "samples")
    counts = counters.live_counts(stream_table(spark, source, frames[0].schema, 1), "kind")
    written = run_to_table(spark, counts, "c", mode="complete")
    last = written.groupBy("kind").agg(F.max_by("n", "batch_id").alias("n"))
    assert {tuple(r) for r in last.collect()} == {("a", 2), ("b", 1)}
    assert written.select("batch_id").distinct().count() == 2


@pytest.mark.parametrize("streaming", [False, True])
def test_request_rates(spark, tmp_path, streaming):
    rows = spark.createDataFrame([("a", 86405), ("a", 86415), ("a", 86470)], "client_id string, t long").select("client_id", F.timestamp_seconds("t").alias("ts"))
    frame = rows
    if streaming:
        frame = stream_table(spark, folder_of([rows], tmp_path, "r"), rows.schema)
    rates = limits.request_rates(frame, 60, 30)
    found = run_to_table(spark, rates, "rates", mode="update") if streaming else rates
    got = {(str(r["window_start"])[11:], r["n"]) for r in found.collect()}
    assert got == {("23:59:30", 2), ("00:00:00", 2), ("00:00:30", 1), ("00:01:00", 1)}
