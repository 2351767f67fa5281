"""Severity ranks, score bands, file classes and other fixed labels."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Severities, ranks, points, bands, classes.
# ---------------------------------------------------------------------------
SEVERITIES = ("critical", "major", "minor", "info")
SEVERITY_RANK = {"critical": 4, "major": 3, "minor": 2, "info": 1, "none": 0}
SEVERITY_POINTS = {"critical": 10, "major": 5, "minor": 2, "info": 1}
LEVEL_POINTS = {"very_high": 20, "high": 10, "medium": 5}
RENAMED = {"critical": "critical", "major": "high", "minor": "medium", "info": "low"}
LINE_MARKS = (("critical", ("critical",)), ("major", ("major", "medium")), ("minor", ("minor", "low")))
FILE_CLASSES = {
    "script": ("js", "jsx", "ts", "tsx"),
    "markup": ("html", "css"),
    "data": ("json", "yml", "yaml", "xml"),
    "php": ("php",),
    "python": ("py",),
    "image": ("png", "jpg", "jpeg", "svg"),
}
OTHER_CLASS = "other"
TERMINAL = ("completed", "failed")
IN_PROGRESS = ("running", "queued")


def _lookup(key: Column, table: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])[key]


def severity_rank(severity: Column) -> Column:
    """4 to 1 for the known severities, any case; 0 for all others."""
    return F.coalesce(_lookup(F.lower(severity), SEVERITY_RANK), F.lit(0))


def rank_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in reversed(SEVERITY_RANK)]), rank.cast("int") + 1)


def renamed_severity(severity: Column) -> Column:
    return F.coalesce(_lookup(F.lower(severity), RENAMED), F.lower(severity))


def line_rank(severity: Column) -> Column:
    """Rank used to mark a source line: critical 3, major/medium 2, minor/low 1, other 0."""
    result = F
    for i, (_, names) in enumerate(LINE_MARKS):
        result = result.when(F.lower(severity).isin(*names), len(LINE_MARKS) - i)
    return result.otherwise(0)


def line_mark(rank: Column) -> Column:
    names = ["other"] + [name for name, _ in reversed(LINE_MARKS)]
    return F.element_at(F.array(*[F.lit(n) for n in names]), rank.cast("int") + 1)


def score_band(score: Column) -> Column:
    return F.when(score < 50, "red").when(score < 80, "yellow").otherwise("green")


def file_class(path: Column) -> Column:
    """Class by the text after the last dot of the name (the whole name without a dot)."""
    ext = F.lower(F.substring_index(path, ".", -1))
    result = F
    for name, exts in FILE_CLASSES.items():
        result = result.when(ext.isin(*exts), name)
    return result.otherwise(OTHER_CLASS)
