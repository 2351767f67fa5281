"""Reports over stored runs, issues and samples.

All groupings are on few keys and pre-aggregated per task; what is kept whole is
bounded by the number of keys, never by the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codegauge.functions.labels import SEVERITIES, TERMINAL, rank_name, renamed_severity
from codegauge.functions.text import duration_seconds
from codegauge.operators.joins import files_with_issue_counts
from codegauge.operators.ordered import numbered
from codegauge.workspace import shared_folder

# Histogram bounds and how many recent durations are kept.
DURATION_BOUNDS = tuple(float(2**i) for i in range(8))
RECENT_FOR_MEAN = 100
RECENT_KEPT = 1000

# A quantile is first looked for with an error of one in SKETCH ranks, then among FEW values.
SKETCH = 20_000
FEW = 50_000

# A run's tree of up to so many nodes is numbered in one task.
LARGE_TREE = 100_000


def filter_issues(
    issues: DataFrame, severity: str = "all", category: str = "all", search: str = ""
) -> DataFrame:
    """Severity and category in any case, ``all`` for no filter; text in path, message or rule."""
    if severity.lower() != "all":
        issues = issues.where(F.lower("severity") == severity.lower())
    if category.lower() != "all":
        issues = issues.where(F.lower("category") == category.lower())
    if search:
        text = F.lit(search.lower())
        hit = F.lit(False)
        for c in ("path", "message", "rule_id"):
            hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), text)
        issues = issues.where(hit)
    return issues


def issues_of_file(issues: DataFrame, path: str) -> DataFrame:
    return issues.where(F.lower("path") == path.lower())


def finished(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status").isin(*TERMINAL))


def recent_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    """The latest runs, newest first."""
    return runs.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def recent_runs_per(runs: DataFrame, key: str, n: int = 20) -> DataFrame:
    """The latest runs of each owner; cut per task before the shuffle."""
    order = Window.partitionBy(key).orderBy(F.desc("created_at"), F.desc("id"))
    ranked = runs.withColumn("recency", F.row_number().over(order))
    return ranked.where(F.col("recency") <= n)


def period_metrics(runs: DataFrame, cutoff: Column, status: str = "completed") -> DataFrame:
    """Runs of a status since a time: count, mean seconds, files, issues, mean score."""
    seconds = F.coalesce(duration_seconds(F.col("created_at"), F.col("completed_at")), F.lit(0.0))
    kept = runs.where((F.col("created_at") >= cutoff) & (F.col("status") == status))
    return kept.agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.coalesce(F.avg(seconds), F.lit(0.0)).alias("average_duration"),
        F.coalesce(F.sum("files_analyzed"), F.lit(0)).alias("total_files"),
        F.coalesce(F.sum("total_issues"), F.lit(0)).alias("total_issues"),
        F.coalesce(F.avg(F.col("average_score").cast("double")), F.lit(0.0)).alias("average_score"),
    )


def issue_distribution(issues: DataFrame, cutoff: Column | None = None) -> DataFrame:
    """Issues by severity and category since a time, keyed ``severity:category``."""
    kept = issues if cutoff is None else issues.where(F.col("created_at") >= cutoff)
    counted = kept.groupBy("severity", "category").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.concat_ws(":", "severity", "category").alias("key"), "n")


def merge_counts(*counts: DataFrame) -> DataFrame:
    """Sum of counts (key, n) over the union of keys; the inputs must count different rows."""
    merged = counts[0]
    for other in counts[1:]:
        merged = merged.unionByName(other)
    return merged.groupBy("key").agg(F.sum("n").alias("n"))


def count_by(rows: DataFrame, *labels: str) -> DataFrame:
    """Counter with lower-cased labels."""
    keys = [F.lower(label).alias(label) for label in labels]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def severity_counters(issues: DataFrame) -> DataFrame:
    """All four severities with their counts, 0 included; unknown ones are not counted."""
    counted = issues.agg(
        *[F.count_if(F.lower("severity") == s).alias(s) for s in SEVERITIES]
    )
    pairs = F.array(
        *[F.struct(F.lit(s).alias("severity"), F.col(s).alias("n")) for s in SEVERITIES]
    )
    return counted.select(F.inline(pairs))


def run_totals(runs: DataFrame) -> DataFrame:
    """Runs processed and files analysed."""
    return runs.agg(
        F.count(F.lit(1)).alias("analyses_processed"),
        F.coalesce(F.sum("files_analyzed"), F.lit(0)).alias("files_analyzed"),
    )


def duration_histogram(
    samples: DataFrame,
    value: str,
    labels: Sequence[str] = (),
    bounds: Sequence[float] = DURATION_BOUNDS,
) -> DataFrame:
    """Cumulative buckets: rows (labels, le, n); the last bound is infinite.

    One aggregation with a counter per bound; the samples are read once.
    """
    columns = [F.count_if(F.col(value) <= b).alias(f"__{i}") for i, b in enumerate(bounds)]
    counted = samples.groupBy(*labels).agg(*columns, F.count(value).alias("__all"))
    buckets = [
        F.struct(F.lit(float(b)).alias("le"), F.col(f"__{i}").alias("n"))
        for i, b in enumerate(bounds)
    ] + [F.struct(F.lit(float("inf")).alias("le"), F.col("__all").alias("n"))]
    return counted.select(*labels, F.inline(F.array(*buckets)))


def histogram_totals(samples: DataFrame, value: str, labels: Sequence[str] = ()) -> DataFrame:
    return samples.groupBy(*labels).agg(
        F.count(value).alias("count"), F.coalesce(F.sum(value), F.lit(0.0)).alias("sum")
    )


def histogram_quantile(buckets: DataFrame, q: float = 0.95, labels: Sequence[str] = ()) -> DataFrame:
    """Quantile from cumulative buckets, linear inside the bucket.

    The window runs over the handful of buckets of a label set. In the infinite
    bucket the highest finite bound is returned; no samples give NaN.
    """
    order = Window.partitionBy(*labels).orderBy("le")
    whole = Window.partitionBy(*labels)
    shaped = buckets.withColumns(
        {
            "__below": F.coalesce(F.lag("n").over(order), F.lit(0)),
            "__from": F.coalesce(F.lag("le").over(order), F.lit(0.0)),
            "__total": F.max("n").over(whole),
        }
    )
    rank = F.col("__total") * q
    share = (rank - F.col("__below")) / (F.col("n") - F.col("__below"))
    inside = F.col("__from") + (F.col("le") - F.col("__from")) * share
    at = F.when(F.col("le") == float("inf"), F.col("__from")).otherwise(inside)
    reached = shaped.where((F.col("n") >= rank) & (F.col("__total") > 0))
    found = reached.groupBy(*labels).agg(F.min_by(at, F.col("le")).alias("quantile"))
    if not labels:
        return found.select(F.coalesce("quantile", F.lit(float("nan"))).alias("quantile"))
    every = buckets.select(*labels).distinct()
    return every.join(found, list(labels), "left").withColumn(
        "quantile", F.coalesce("quantile", F.lit(float("nan")))
    )


def _value_at(values: DataFrame, rank: int, n: int) -> float:
    """The value with this rank (from 0) among the ``n`` values of the column ``v``.

    A sketch names two values that most likely lie just below and just above the rank, and one
    count of the rows below, at, between and above them tells where it is. The rows there, of
    a large table about 4 in ``SKETCH``, are treated likewise until they are few enough to be
    looked at. The counts are exact, so a poor sketch costs rounds and never the result.
    """
    while n > FEW:
        near = 2 / SKETCH
        share = rank / (n - 1)
        ends = F.percentile_approx("v", [max(0.0, share - near), min(1.0, share + near)], SKETCH)
        low, high = values.agg(ends.alias("ends")).first()["ends"]
        v = F.col("v")
        parts = [v < low, v == low, (v > low) & (v < high), (v == high) & (v > low), v > high]
        counts = values.agg(*(F.count_if(part).alias(str(k)) for k, part in enumerate(parts))).first()
        for part, held, value in zip(parts, counts, (None, low, None, high, None), strict=True):
            if rank < held:
                break
            rank -= held
        if value is not None:
            return value
        values, n = values.where(part), held
    few = values.groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect()  # at most FEW rows
    for r in sorted(few, key=lambda r: r["v"]):
        if rank < r["n"]:
            return r["v"]
        rank -= r["n"]
    raise ValueError("fewer values than before: the samples changed while they were read")


def exact_quantile(samples: DataFrame, value: str, q: float = 0.95) -> DataFrame:
    """Exact quantile (linear between neighbours) in a few passes, whatever the spread of values.

    No value is sorted and few are gathered: a pass that counts, one that sketches, one that
    counts around the sketch's answer, one over the few rows that are left, and one for the next
    value. Missing values are left out; without values the quantile is NULL.
    """
    values = samples.select(F.col(value).cast("double").alias("v")).where(
        F.col("v").isNotNull() & ~F.isnan("v")
    )
    n = values.count()
    found = None
    if n:
        place = (n - 1) * q
        rank = math.floor(place)
        found = _value_at(values, rank, n)
        if place > rank:
            upto = F.count_if(F.col("v") <= found).alias("upto")
            after = F.min(F.when(F.col("v") > found, F.col("v"))).alias("after")
            around = values.agg(upto, after).first()
            if around["upto"] == rank + 1:
                found += (around["after"] - found) * (place - rank)
    return samples.sparkSession.createDataFrame([(found,)], "quantile double")


def share_of_total(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Sum per key and its percent of the total; the total is taken over the few sums."""
    summed = counts.groupBy(key).agg(F.sum(n).alias(n))
    total = F.sum(n).over(Window.partitionBy())
    return summed.withColumn("percent", F.round(F.col(n) * 100.0 / total, 4))


def renamed_severity_totals(issues: DataFrame) -> DataFrame:
    """Totals under the names critical, high, medium and low."""
    counted = issues.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(renamed_severity(F.col("severity")).alias("severity")).agg(
        F.sum("n").alias("n")
    )


def recent_samples(samples: DataFrame, time: str, tie: str, n: int = RECENT_KEPT) -> DataFrame:
    """The last n samples; each task hands over n rows at most."""
    return samples.orderBy(F.desc(time), F.desc(tie)).limit(n)


def mean_of_recent(
    samples: DataFrame, value: str, time: str, tie: str, n: int = RECENT_FOR_MEAN
) -> DataFrame:
    return recent_samples(samples, time, tie, n).agg(F.avg(value).alias("mean"))


def oldest(rows: DataFrame, time: str, tie: str) -> DataFrame:
    """The first row by time."""
    rest = [c for c in rows.columns if c not in (time, tie)]
    first = F.min(F.struct(time, tie, *rest)).alias("first")
    return rows.agg(first).select("first.*").select(*rows.columns)


def first_match(rows: DataFrame, condition: Column, key: str = "id") -> DataFrame:
    """The matching row with the lowest key, or none."""
    return rows.where(condition).orderBy(key).limit(1)


def row_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"))


def known_files(*sources: DataFrame) -> DataFrame:
    """Distinct (run_id, path) of several tables, blank paths dropped.

    Most rows differ, so they are dealt to a given number of partitions first and compared
    there: no task holds more than its share, where comparing them before and after the
    exchange would hold them three times, in tasks as long as packed sizes make them.
    """
    merged = None
    for source in sources:
        paths = source.select("run_id", "path").where(F.col("path") != "")
        merged = paths if merged is None else merged.unionByName(paths)
    tasks = int(merged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return merged.repartition(tasks, "run_id", "path").distinct()


def categories(issues: DataFrame) -> DataFrame:
    return issues.select("category").where(F.col("category") != "").distinct()


def folder_rollup(files: DataFrame, issues: DataFrame) -> DataFrame:
    """Issue count and highest severity of every folder and file of a run.

    Issues are counted per file before the paths are spread over their prefixes,
    and the sums are pre-aggregated again, so the root of a large run is cheap.
    """
    return _rolled(_spread(files, issues))


def _spread(files: DataFrame, issues: DataFrame, tasks: int | None = None) -> DataFrame:
    """A row per file and prefix of its path, with the file's issues; dealt to ``tasks`` by run, if given."""
    counted = files_with_issue_counts(files.select("run_id", "path").distinct(), issues)
    if tasks:
        counted = counted.repartition(tasks, "run_id")
    parts = F.split("path", "/", -1)
    depths = F.sequence(F.lit(0), F.size(parts))
    return counted.select(
        "run_id", "issue_count", "max_rank", F.size(parts).alias("n"), parts.alias("parts"),
        F.explode(depths).alias("depth"),
    ).select(
        "run_id",
        F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("path"),
        "depth",
        F.when(F.col("depth") == F.col("n"), "file").otherwise("folder").alias("type"),
        "issue_count",
        "max_rank",
    )


def _rolled(spread: DataFrame) -> DataFrame:
    """One row per folder and file of the rows that ``_spread`` makes."""
    rolled = spread.groupBy("run_id", "path", "depth", "type").agg(
        F.sum("issue_count").alias("issue_count"), F.max("max_rank").alias("max_rank")
    )
    parent = F.when(F.col("depth") > 1, F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    return rolled.select(
        "run_id",
        "path",
        F.when(F.col("depth") > 0, F.coalesce(parent, F.lit(""))).alias("parent_path"),
        F.when(F.col("depth") == 0, "root")
        .otherwise(F.substring_index("path", "/", -1))
        .alias("name"),
        "depth",
        "type",
        "issue_count",
        rank_name(F.col("max_rank")).alias("max_severity"),
    )


def in_tree_order(tree: DataFrame) -> DataFrame:
    """Adds the order in which a tree is shown: folders first, then by name in locale order.

    ``position`` counts (from 1) within the parent, ``tree_position`` over the whole tree of a
    run with every folder before what it holds. Both are numbered over ranges of the order, so
    neither a folder with most files nor a run with most folders is one task.
    """
    whole = numbered(tree.withColumn("__levels", _levels()), ["run_id"], ["__levels"], "tree_position")
    order = _sibling_order()
    siblings = whole.drop("__levels").withColumns(order)
    return numbered(siblings, ["run_id", "parent_path"], [*order, "name"], "position").drop(*order)


def _sibling_order() -> dict[str, Column]:
    """What the order of siblings compares before their names."""
    return {"__file": F.col("type") != "folder", "__shown": F.collate("name", "UNICODE")}


def _levels() -> Column:
    """What the order of a tree compares: a struct per level of the path."""
    last_is_file = F.when(F.col("type") == "file", F.col("depth"))
    names = F.slice(F.split("path", "/", -1), 1, F.col("depth"))
    # a level is shown by whether it is a file, its name in locale order, its name
    return F.transform(
        names,
        lambda name, k: F.struct(
            F.coalesce(k + 1 == last_is_file, F.lit(False)).alias("file"),
            F.collate(name, "UNICODE").alias("shown"),
            name.alias("name"),
        ),
    )


def folder_tree(files: DataFrame, issues: DataFrame, large: int = LARGE_TREE) -> DataFrame:
    """The rows of ``folder_rollup`` in the order of ``in_tree_order``.

    Runs whose trees have at most ``large`` nodes are dealt to a given number of partitions by
    run, where they are summed and numbered without another exchange. The nodes are bounded by
    the lengths of the paths, so larger runs, usually none, are known before; their trees are
    numbered over ranges.
    """
    spark = files.sparkSession
    nodes = F.sum(1 + F.coalesce(F.size(F.split("path", "/", -1)), F.lit(1)))
    sizes = files.groupBy("run_id").agg(nodes.alias("n")).where(F.col("n") > large)
    folder = shared_folder(spark, "large-runs")
    sizes.select(F.col("run_id").alias("__large")).write.parquet(folder)
    runs = spark.read.schema(sizes.select(F.col("run_id").alias("__large")).schema).parquet(folder)
    some = not runs.isEmpty()

    def of(frame: DataFrame, how: str) -> DataFrame:
        return frame.join(runs, F.col("run_id").eqNullSafe(F.col("__large")), how) if some else frame

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = _spread(of(files, "left_anti"), of(issues, "left_anti"), tasks)
    whole = Window.partitionBy("run_id").orderBy("__levels")
    siblings = Window.partitionBy("run_id", "parent_path").orderBy(*_sibling_order().values(), "name")
    tree = _rolled(spread).withColumn("__levels", _levels()).withColumn("tree_position", F.row_number().over(whole).cast("long"))
    tree = tree.drop("__levels").withColumn("position", F.row_number().over(siblings).cast("long"))
    if some:
        tree = tree.unionByName(in_tree_order(folder_rollup(of(files, "left_semi"), of(issues, "left_semi"))))
    return tree
