"""Reports, ordered groups, limits, audits and text functions on small rows."""

import random
from collections import deque

import math

import pytest
from pyspark.sql import functions as F

from codegauge.functions import labels
from codegauge.functions import text as T
from codegauge.operators import audit as L
from codegauge.operators import joins as J
from codegauge.operators import ordered as G
from codegauge.operators import ratelimit as K
from codegauge.operators import reports as P
from codegauge.operators import scoring as S


def one(spark, column, *values):
    """The column evaluated on a row whose columns are v0, v1, ..."""
    names = ", ".join(f"v{i} string" for i in range(len(values)))
    return spark.createDataFrame([tuple(values)], names).select(column).first()[0]


def issues(spark):
    rows = [
        (1, "test.php", 10, "High", "Security", "SQL risk", "R1", 1),
        (1, "app.js", 3, "Critical", "style", "Deep nesting detected (level 5).", "R2", 2),
        (1, "app.js", 9, "info", "style", "Deep nesting detected (level 5).", "R2", 3),
        (1, "app.js", 9, "info", "", "other", None, 4),
    ]
    return spark.createDataFrame(rows, "run_id long, path string, line_number int, severity string, category string, message string, rule_id string, id long")


def test_filter_and_search(spark):
    rows = issues(spark)
    assert P.filter_issues(rows, severity="Critical").count() == 1
    assert P.filter_issues(rows, search="sql").count() == 1
    assert P.filter_issues(rows, search="r2").count() == 2
    assert P.filter_issues(rows, category="STYLE", search="NESTING").count() == 2
    assert P.filter_issues(rows).count() == 4
    assert P.issues_of_file(rows, "APP.js").count() == 3
    assert {r[0] for r in P.categories(rows).collect()} == {"Security", "style"}
    assert {r["id"] for r in G.once_per_message(rows).collect()} == {1, 2, 4}


@pytest.mark.parametrize("score, band", [(90, "green"), (80, "green"), (75, "yellow"), (50, "yellow"), (40, "red")])
def test_bands(spark, score, band):
    assert one(spark, labels.score_band(F.col("v0").cast("int")), str(score)) == band


@pytest.mark.parametrize("score, level", [(49, "very_high"), (69, "high"), (84, "medium"), (85, "low")])
def test_quality_levels(spark, score, level):
    assert one(spark, S.quality_level(F.col("v0").cast("int")), str(score)) == level


@pytest.mark.parametrize(
    "url, owner, name",
    [
        ("https://github.com/owner/repo", "owner", "repo"),
        ("https://github.com/owner/repo.git", "owner", "repo"),
        (" HTTP://GitHub.com/owner/repo.git// ", "owner", "repo"),
        ("owner/repo", "owner", "repo"),
        ("https://github.com/owner/repo/.git", "repo", ""),
        ("repo", None, None),
    ],
)
def test_repository_urls(spark, url, owner, name):
    assert one(spark, T.repo_owner(F.col("v0")), url) == owner
    assert one(spark, T.repo_name(F.col("v0")), url) == name


def test_text_functions(spark):
    v = F.col("v0")
    assert one(spark, T.snake_to_camel(v), "my_HTTP_call_x") == "myHTTPCallX"
    assert one(spark, T.snake_to_camel(v), "_a_b") == "aB"
    assert one(spark, T.display_repo_name(v), "x") == "x"
    assert one(spark, T.display_repo_name(v), None) == ""
    assert one(spark, T.redact_tokens(v), "a ghp_" + "A1" * 18 + " github_pat_x_1!") == "a [REDACTED_TOKEN] [REDACTED_TOKEN]!"
    assert one(spark, T.redact_log(v), 'Token = abc, "password": "x y" ' + "a" * 40) == 'Token: [REDACTED], "password": "[REDACTED]" [REDACTED]'
    assert one(spark, T.redact_query(v, True), "?githubToken=a&githubToken=b") == "?githubToken=[REDACTED]&githubToken=b"
    assert one(spark, T.truncate(v, 3, "..."), "abcd") == "abc..."
    assert one(spark, T.truncate(v, 4, "..."), "abcd") == "abcd"
    assert one(spark, T.score_from_summary(v), "Score: 87.50/100") == 87
    assert one(spark, T.score_from_summary(v), None) == 0
    assert one(spark, T.infer_category(v), "Bad FORMAT and slow") == "Performance"
    assert float(one(spark, T.round2(F.lit(2.345)), "")) == 2.35


def test_histogram_and_quantile(spark):
    samples = spark.createDataFrame([("a", 0.5), ("a", 3.0), ("a", 5.0), ("b", 500.0)], "k string, v double")
    buckets = P.duration_histogram(samples, "v", ["k"])
    by_key = {}
    for r in buckets.orderBy("k", "le").collect():
        by_key.setdefault(r["k"], []).append(r["n"])
    assert by_key["a"] == [1, 1, 2, 3, 3, 3, 3, 3, 3] and by_key["b"] == [0] * 8 + [1]
    q = {r["k"]: r["quantile"] for r in P.histogram_quantile(buckets, 0.95, ["k"]).collect()}
    assert q["a"] == pytest.approx(4 + 4 * (0.95 * 3 - 2)) and q["b"] == 128
    single = P.duration_histogram(spark.createDataFrame([(6.0,)], "v double"), "v")
    assert P.histogram_quantile(single).first()[0] == pytest.approx(7.8)
    none = P.duration_histogram(spark.createDataFrame([], "v double"), "v")
    assert P.histogram_quantile(none).first()[0] != P.histogram_quantile(none).first()[0]


@pytest.mark.parametrize("values", [
    [k / 1000 for k in range(1001)], [1.7e15 + k * 3 for k in range(500)], [5.0] * 40 + [6.0], [7.0], [1e-300, 1.0, 1e300, -1e300],
    [-float(2**k) for k in range(60)] + [0.0] * 9,
])
def test_exact_quantile(spark, values):
    frame = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    for q in (0.0, 0.5, 0.95, 1.0):
        rank = (len(values) - 1) * q
        a, b = sorted(values)[math.floor(rank)], sorted(values)[math.ceil(rank)]
        assert P.exact_quantile(frame, "v", q).first()[0] == pytest.approx(a + (b - a) * (rank - math.floor(rank)))
    assert P.exact_quantile(frame.limit(0), "v").first()[0] is None


def test_folder_rollup(spark):
    rows = [(1, "src/a/x.php", "major"), (1, "src/a/x.php", "info"), (1, "SRC/a/X.php", "minor"), (1, "y.php", "odd")]
    found = spark.createDataFrame(rows, "run_id long, path string, severity string")
    files = spark.createDataFrame([(1, "src/a/x.php"), (1, "src/z.php"), (1, "y.php")], "run_id long, path string")
    tree = {r["path"]: r for r in P.folder_rollup(files, found).collect()}
    assert tree[""]["issue_count"] == 4 and tree[""]["max_severity"] == "major" and tree[""]["parent_path"] is None
    assert tree["src"]["issue_count"] == 3 and tree["src"]["type"] == "folder" and tree["src"]["parent_path"] == ""
    assert tree["src/z.php"]["issue_count"] == 0 and tree["src/z.php"]["max_severity"] == "none"
    assert tree["y.php"]["issue_count"] == 1 and tree["y.php"]["max_severity"] == "none"
    assert [r["name"] for r in P.in_tree_order(P.folder_rollup(files, found)).where("parent_path = ''").collect()] == ["src", "y.php"]


def test_exact_quantile_narrows(spark, monkeypatch):
    """Ranks among ties, heavy tails and both signs, with a sketch so coarse that rounds are needed."""
    monkeypatch.setattr(P, "FEW", 3)
    monkeypatch.setattr(P, "SKETCH", 10)
    rng = random.Random(5)
    values = [rng.choice([7.0, 7.0, rng.gauss(0, 1), 10 ** rng.uniform(-300, 300), -rng.random()]) for _ in range(400)]
    frame = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    for q in (0.0, 0.33, 0.5, 0.951, 1.0):
        rank = (len(values) - 1) * q
        a, b = sorted(values)[math.floor(rank)], sorted(values)[math.ceil(rank)]
        assert P.exact_quantile(frame, "v", q).first()[0] == pytest.approx(a + (b - a) * (rank - math.floor(rank)))


def test_whole_tree_order(spark):
    """Against a walk down the tree; one run and one folder hold most files, names tie in locale order."""
    rng = random.Random(3)
    paths = {(1, f"big/f{k}.php") for k in range(400)}
    for _ in range(300):
        depth = rng.randint(1, 4)
        paths.add((rng.choice([1, 1, 1, 2]), "/".join(rng.choice(["a", "B", "b", "é", "f", "Z", "a.b", "a b"]) for _ in range(depth))))
    files = spark.createDataFrame(sorted(paths), "run_id long, path string")
    issues = spark.createDataFrame([], "run_id long, path string, severity string")
    nodes = P.in_tree_order(P.folder_rollup(files, issues)).collect()
    # the siblings' order is Spark's own collation, taken as a list of names
    names = {n["name"] for n in nodes}
    listed = spark.createDataFrame([(n,) for n in names], "name string")
    place = {r["name"]: k for k, r in enumerate(listed.orderBy(F.collate("name", "UNICODE"), "name").collect())}
    for run in (1, 2):
        below = {}
        for n in nodes:
            if n["run_id"] == run and n["depth"]:
                below.setdefault((n["parent_path"], n["depth"]), []).append(n)
        shown = []

        def walk(path, depth, shown=shown, below=below):
            inside = sorted(below.get((path, depth + 1), []), key=lambda n: (n["type"] != "folder", place[n["name"]]))
            for k, n in enumerate(inside, 1):
                assert n["position"] == k
                shown.append(n)
                if n["type"] == "folder":
                    walk(n["path"], depth + 1)

        walk("", 0)
        assert [n["tree_position"] for n in shown] == list(range(2, len(shown) + 2))
        root = next(n for n in nodes if n["run_id"] == run and n["depth"] == 0)
        assert (root["tree_position"], root["position"]) == (1, 1)


def test_a_tree_of_small_runs_needs_no_ranges(spark):
    """Both ways of numbering give the same rows, together and alone; runs may be null, paths odd and repeated."""
    rng = random.Random(4)
    paths = [(rng.choice([1, 2, 2, 2, 3, None]), "/".join(rng.choice(["a", "B", "b", "\u00e9", "Z.b"]) for _ in range(rng.randint(1, 4)))) for _ in range(150)]
    paths += [(4, ""), (4, "x//y"), (2, "a"), (2, "a/b"), (None, "q/r")]
    rows = [(run, path, rng.choice(["critical", "minor", None])) for run, path in paths * 2]
    issues = spark.createDataFrame(rows, "run_id long, path string, severity string")
    expected = P.in_tree_order(P.folder_rollup(issues, issues))
    key = lambda frame: sorted(map(repr, frame.select(expected.columns).collect()))
    for large in (10**6, 60, 0):
        tree = P.folder_tree(issues, issues, large)
        assert tree.dtypes == expected.dtypes and key(tree) == key(expected)
    plan = P.folder_tree(issues, issues)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "numbered" not in plan
    # summed and numbered where the run's files were dealt to: no exchange stands above that by run
    assert plan.index("hashpartitioning(run_id") < plan.index("REPARTITION_BY_NUM") and plan.index("Exchange") == plan.index("Exchange hashpartitioning(run_id")


def test_lines_with_issues(spark):
    files = spark.createDataFrame([(1, "a", "x\ny\nz")], "run_id long, path string, content string")
    found = spark.createDataFrame([(1, "a", 2, "Minor"), (1, "a", 2, "Medium"), (1, "a", 3, "odd")], "run_id long, path string, line_number int, severity string")
    rows = [(r["line"], r["issue_count"], r["mark"]) for r in J.lines_with_issues(files, found).orderBy("line_number").collect()]
    assert rows == [("x", 0, None), ("y", 2, "major"), ("z", 1, "other")]


def test_lines_of_long_and_odd_files(spark):
    """Marks before, behind and far outside a file, repeated files, nulls, and 100,000 lines all marked or one in ten."""
    long = "\n".join(str(k) for k in range(100_000))
    files = spark.createDataFrame(
        [(1, "long", long), (1, "tenth", long), (1, "twice", "p\n"), (1, "twice", "q"), (1, "null", None), (2, "empty", "")],
        "run_id long, path string, content string",
    )
    ids = spark.range(1, 100_001)
    found = ids.selectExpr("1L AS run_id", "'long' AS path", "id AS line_number", "'Minor' AS severity")
    found = found.union(ids.where("id % 10 = 0").selectExpr("1L", "'tenth'", "id", "'Minor'"))
    odd = [(1, "twice", 2, "Minor"), (1, "twice", 0, "Minor"), (1, "twice", -5, "Minor"), (1, "twice", 2**40, "Minor"),
           (1, "twice", None, "Minor"), (1, "null", 1, "Minor"), (1, "gone", 1, "Minor"), (2, "empty", 1, "Minor")]
    got = J.lines_with_issues(files, found.union(spark.createDataFrame(odd, "run_id long, path string, line_number long, severity string")))
    per_file = got.groupBy("path").agg(F.count("*").alias("n"), F.sum("issue_count").alias("marked"), F.count("mark").alias("m"),
                                       F.count_if((F.col("issue_count") > 0) & (F.col("line") != (F.col("line_number") - 1).cast("string"))).alias("moved"))
    rows = {r["path"]: tuple(r)[1:] for r in per_file.where("path <> 'twice' AND path <> 'empty'").collect()}
    assert rows == {"long": (100_000, 100_000, 100_000, 0), "tenth": (100_000, 10_000, 10_000, 0)}
    small = sorted((r["path"], r["line_number"], r["line"], r["issue_count"]) for r in got.where("path IN ('twice', 'empty')").collect())
    assert small == [("empty", 1, "", 1), ("twice", 1, "p", 0), ("twice", 1, "q", 0), ("twice", 2, "", 1)]


def test_neighbours_of_a_hot_group(spark):
    """One group holds most rows and spans many chunks."""
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(9)}", rng.randrange(300), i) for i in range(2000)]
    frame = spark.createDataFrame(rows, "k string, line int, id int")
    got = G.with_neighbours(frame, ["k"], ["line", "id"], "id", F.floor(F.col("line") / 16)).collect()
    groups = {}
    for k, line, i in sorted(rows):
        groups.setdefault(k, []).append(i)
    assert len(got) == len(rows)
    for r in got:
        ids = groups[r["k"]]
        at = ids.index(r["id"])
        assert (r["position"], r["group_size"]) == (at + 1, len(ids))
        assert (r["next_id"], r["previous_id"]) == (ids[(at + 1) % len(ids)], ids[at - 1])


def test_neighbours_of_ordinary_and_hot_groups(spark, monkeypatch):
    """Ordinary groups are shuffled once for one window, hot ones are cut into chunks; both give the same."""
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}", rng.choice([None, *range(50)]), i) for i in range(3000)]
    frame = spark.createDataFrame([*rows, (None, 1, 9000), (None, 2, 9001)], "k string, line int, id int")
    chunk = F.struct("line", F.floor(F.col("id") / 500))
    plain = G.with_neighbours(frame, ["k"], ["line", "id"], "id", chunk)
    assert plain._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    groups = {}
    for k, _, i in sorted(rows, key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2])):
        groups.setdefault(k, []).append(i)
    want = [(i, at + 1, len(ids), ids[(at + 1) % len(ids)], ids[at - 1]) for ids in groups.values() for at, i in enumerate(ids)]
    columns = ("id", "position", "group_size", "next_id", "previous_id")
    assert sorted(map(tuple, plain.select(*columns).collect())) == sorted(want)
    lined = F.floor(F.col("line") / 16)  # rows without a line have no chunk, yet count
    some = G.with_neighbours(frame, ["k"], ["line", "id"], "id", lined).select(*columns).collect()
    with_line = {i for _, line, i in rows if line is not None}
    assert sorted(map(tuple, some)) == sorted(w for w in want if w[0] in with_line)
    monkeypatch.setattr(G, "WHOLE_GROUP", 500)
    assert sorted(G.with_neighbours(frame, ["k"], ["line", "id"], "id", lined).select(*columns).collect()) == sorted(some)
    cut = G.with_neighbours(frame, ["k"], ["line", "id"], "id", chunk)
    assert [(f.name, f.dataType) for f in cut.schema] == [(f.name, f.dataType) for f in plain.schema]
    assert "Join" in cut._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, cut.select(*columns).collect())) == sorted(want)


def requests_of(seed):
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(1500):
        t += rng.choice([0, 1, 2, 5, 40, 130]) * 100_000
        rows.append(("hot" if rng.random() < 0.6 else f"c{rng.randrange(4)}", i, t))
    return rows


def admitted(rows, limits):
    """The limiter request by request."""
    history, result = {}, {}
    for client, i, t in rows:
        kept = history.setdefault(client, deque())
        ok = all(sum(1 for a in kept if t - a <= w * 1_000_000) < most for most, w in limits)
        if ok:
            kept.append(t)
        result[i] = ok
    return result


@pytest.mark.parametrize("seed, limit, seconds, hour", [(1, 5, 6, None), (2, 1, 2, None), (3, 4, 5, 30), (4, 1000, 6, None)])
def test_admission(spark, seed, limit, seconds, hour):
    rows = requests_of(seed)
    frame = spark.createDataFrame(rows, "client_id string, event_id int, t long").select(
        "client_id", "event_id", F.timestamp_micros("t").alias("ts")
    )
    got = {r["event_id"]: r["admitted"] for r in K.admission(frame, limit, seconds, hour).collect()}
    expected = admitted(rows, [(limit, seconds)] + ([(hour, 3600)] if hour else []))
    assert got == expected
    assert limit == 1000 or not all(expected.values())


def test_sliding_count(spark):
    rows = requests_of(7)
    frame = spark.createDataFrame(rows, "client_id string, event_id int, t long").select(
        "client_id", "event_id", F.timestamp_micros("t").alias("ts")
    )
    got = {r["event_id"]: r["n"] for r in G.sliding_count(frame, "client_id", "ts", 3).collect()}
    for client, i, t in rows[::50]:
        assert got[i] == sum(1 for c, _, u in rows if c == client and t - 3_000_000 <= u <= t)
    assert len(got) == len(rows)


def test_client_key(spark):
    key = K.client_key(F.col("v0"), F.col("v1"))
    assert one(spark, key, "1.2.3.4", None) == "1.2.3.4"
    assert one(spark, key, None, "7") == "unknown:user:7"
    assert one(spark, key, "1.2.3.4", "") == "1.2.3.4"


def test_submission_decisions(spark):
    known = [(1, "b", "h1", 10, "completed", 5), (1, "b", "h2", 11, "completed", 0), (1, "b", "h3", 12, "queued", 0), (1, "b", "h4", 13, "failed", 3), (1, "b", "h4", 14, "completed", 3)]
    runs = spark.createDataFrame(known, "repository_id long, base_commit_sha string, head_commit_sha string, id long, status string, files_analyzed int")
    asked = spark.createDataFrame([(1, "b", f"h{i}") for i in range(1, 6)], "repository_id long, base_commit_sha string, head_commit_sha string")
    rows = {r["head_commit_sha"]: (r["decision"], r["known_run_id"]) for r in J.submission_decision(asked, runs).collect()}
    assert rows == {"h1": ("reuse", 10), "h2": ("replace", 11), "h3": ("reuse", 12), "h4": ("replace", 13), "h5": ("new", None)}
    reused = {r["head_commit_sha"]: r["reused_run_id"] for r in J.completed_lookup(asked, runs).collect()}
    assert reused == {"h1": 10, "h2": 11, "h3": None, "h4": None, "h5": None}


def test_audits(spark):
    users = spark.createDataFrame([(1, "a@x"), (2, "a@x")], "id long, email string")
    repos = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "id long, user_id long")
    runs = spark.createDataFrame([(1, 1), (2, 2)], "id long, repository_id long")
    found = spark.createDataFrame([(1, 1), (2, 2)], "id long, run_id long")
    assert L.duplicate_keys(users, ["email"]).first() == ("a@x", 2)
    assert [r["id"] for r in L.orphans(repos, "user_id", users).collect()] == [2]
    tables = {"users": users, "repositories": repos, "analysis_runs": runs, "analysis_issues": found}
    left = L.cascade_delete(tables, "users", F.col("id") == 1)
    assert {n: sorted(r["id"] for r in t.collect()) for n, t in left.items()} == {
        "users": [2], "repositories": [2, 3], "analysis_runs": [2], "analysis_issues": [2],
    }
    rows = spark.createDataFrame([(1, None, "abc"), (2, "x", "abcd"), (3, "y", "a")], "id long, status string, name string")
    broken = {(r["id"], r["column"], r["problem"]) for r in L.violations(rows, ["status"], {"name": 3}).collect()}
    assert broken == {(1, "status", "missing"), (2, "name", "longer than 3")}
