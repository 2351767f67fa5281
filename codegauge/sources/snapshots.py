"""Snapshots of a run: its file metrics and texts, as maps and as JSON.

A run of any size is stored as parts of at most ``files_per_part`` consecutive
files (by ``entry_index``), so no run has to fit into one row. A run within the
usual file limit is one part and its document is the whole snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegauge.operators.selection import MAX_FILES

# Key names of the document.
METRICS_KEY = "file_metrics"
CONTENTS_KEY = "file_contents"
_METRICS_MAP = "map<string,struct<ComplexityLevel:string,FunctionCount:int,LinesOfCode:int>>"
_CONTENTS_MAP = "map<string,string>"


def last_per_path(files: DataFrame) -> DataFrame:
    """The last entry of each path in a run wins; pre-aggregated per task."""
    rest = [c for c in files.columns if c not in ("run_id", "path")]
    chosen = F.max_by(F.struct(*rest), "entry_index").alias("chosen")
    return files.groupBy("run_id", "path").agg(chosen).select("run_id", "path", "chosen.*")


def pack_snapshots(files: DataFrame, files_per_part: int = MAX_FILES, keys: DataFrame | None = None) -> DataFrame:
    """Rows (run_id, path, entry_index, content, quality_level, function_count,
    lines_of_code) to one row per run and part with two maps.

    The last entry of each path is decided on the keys alone; its mark is sent to the part
    of that entry, and texts are shuffled once, straight to their part. ``keys`` may name a
    cheaper table of the same rows' run_id, path and entry_index (before an analysis, say).
    """
    part = F.floor(F.col("entry_index") / files_per_part).cast("int").alias("part")
    metrics = F.struct(
        F.col("quality_level").alias("ComplexityLevel"),
        F.col("function_count").alias("FunctionCount"),
        F.col("lines_of_code").alias("LinesOfCode"),
    )

    def entry(is_last: int, metrics: Column, content: Column) -> Column:
        # sorted, the mark of a path's last entry comes right behind that entry
        return F.struct(
            "path", "entry_index", F.lit(is_last).alias("is_last"), metrics.alias("metrics"), content.alias("content")
        ).alias("entry")

    rows = files.select("run_id", part, entry(0, metrics, F.col("content")))
    kinds = rows.schema["entry"].dataType
    last = (files if keys is None else keys).groupBy("run_id", "path").agg(F.max("entry_index").alias("entry_index"))
    marks = last.select("run_id", part, entry(1, F.lit(None).cast(kinds["metrics"].dataType), F.lit(None).cast("string")))
    packed = rows.unionByName(marks).groupBy("run_id", "part").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    is_mark = lambda e: e["is_last"] == 1
    packed = packed.withColumn(
        "entries",
        F.filter("entries", lambda e, i: ~is_mark(e) & F.coalesce(is_mark(F.get("entries", i + 1)), F.lit(False))),
    )

    def as_map(field: str) -> Column:
        return F.map_from_entries(
            F.transform("entries", lambda e: F.struct(e["path"], e[field]))
        )

    return packed.select(
        "run_id", "part", as_map("metrics").alias(METRICS_KEY), as_map("content").alias(CONTENTS_KEY)
    ).where(F.size(METRICS_KEY) > 0)


def to_document(packed: DataFrame) -> DataFrame:
    """The two maps as one JSON document."""
    body = F.to_json(F.struct(METRICS_KEY, CONTENTS_KEY))
    return packed.select("run_id", "part", body.alias("metrics_json"))


def parse_documents(documents: DataFrame) -> DataFrame:
    """JSON documents back to the two maps.

    A document without the metrics key is an old one: the whole of it is the
    metrics map. What cannot be parsed gives empty maps.
    """
    text = F.col("metrics_json")
    new = F.from_json(text, f"{METRICS_KEY} {_METRICS_MAP}, {CONTENTS_KEY} {_CONTENTS_MAP}")
    is_new = F.get_json_object(text, f"$.{METRICS_KEY}").isNotNull()
    old = F.from_json(text, _METRICS_MAP)
    no_metrics = F.from_json(F.lit("{}"), _METRICS_MAP)
    no_contents = F.from_json(F.lit("{}"), _CONTENTS_MAP)
    kept = [c for c in documents.columns if c != "metrics_json"]
    return documents.select(
        *kept,
        F.coalesce(F.when(is_new, new[METRICS_KEY]).otherwise(old), no_metrics).alias(METRICS_KEY),
        F.coalesce(new[CONTENTS_KEY], no_contents).alias(CONTENTS_KEY),
    )


def snapshot_files(parsed: DataFrame) -> DataFrame:
    """Parsed snapshots as rows: one per file that has metrics."""
    rows = parsed.select(
        "run_id", F.explode(METRICS_KEY).alias("path", "m"), F.col(CONTENTS_KEY).alias("texts")
    )
    return rows.select(
        "run_id",
        "path",
        F.col("m.ComplexityLevel").alias("quality_level"),
        F.col("m.FunctionCount").alias("function_count"),
        F.col("m.LinesOfCode").alias("lines_of_code"),
        F.try_element_at("texts", F.col("path")).alias("content"),
    )
