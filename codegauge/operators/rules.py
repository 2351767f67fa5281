"""Run a rule table over files: one pass, no shuffle.

All hits of a file are built in one array column next to its metrics, so the
severity counts and the score of a file need no grouping at all. Hits carry only
the place of their rule in the table; texts are filled in when hits are exploded.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegauge.functions.bytesview import byte_view
from codegauge.functions.labels import SEVERITIES
from codegauge.functions.matching import (
    MARK,
    has_all,
    has_indented_line,
    marked,
    marked_hits,
)
from codegauge.functions.text import snake_to_camel
from codegauge.operators import metrics as M
from codegauge.operators import scoring, structural
from codegauge.operators.catalog import DEFAULT_RULES, SHORT_NAMES_ALLOWED, Rule

HIT_TYPE = (
    "struct<rule_order:int,pattern_order:int,match_index:int,line:int,text:string,number:int>"
)

WORKING_COLUMNS = ("__view", "__low", "__functions", "__classes", "__indented")
METRIC_COLUMNS = (
    "cyclomatic_complexity", "code_length", "lines_of_code",
    "function_count", "class_count", "complexity_level",
)
# What a rule without patterns asks for besides the text.
METRIC_OF_RULE = {
    "HIGH_COMPLEXITY": "cyclomatic_complexity",
    "FUNCTION_TOO_LONG": "lines_of_code",
    "FILE_TOO_LONG": "lines_of_code",
}
TEST_OF_RULE = {
    "FUNCTION_TOO_LONG": "__functions",
    "MISSING_DOCUMENTATION": "__functions",
    "MISSING_CLASS_DOCUMENTATION": "__classes",
    "INCONSISTENT_INDENTATION": "__indented",
    "DEEP_NESTING": "__indented",
}
COUNT_COLUMNS = tuple(f"{s}_count" for s in SEVERITIES)


def _view() -> Column:
    return F.col("__view")


def _lowered() -> Column:
    return F.col("__low")


# Names that a pattern rule captures but does not report.
_SKIP = {
    "NAMING_CONVENTION_CLASS": lambda name: F.rlike(name, F.lit("^[A-Z][a-zA-Z0-9]*$")),
    "SHORT_VARIABLE_NAME": lambda name: name.isin(*SHORT_NAMES_ALLOWED),
}


def _structural(rule_id: str) -> Column | None:
    lines, functions, classes, indented = (
        F.col(c) for c in ("lines_of_code", "__functions", "__classes", "__indented")
    )
    builders = {
        "FUNCTION_TOO_LONG": lambda: structural.long_functions(_view(), lines, functions),
        "FILE_TOO_LONG": lambda: structural.long_file(lines),
        "HIGH_COMPLEXITY": lambda: structural.high_complexity(F.col("cyclomatic_complexity")),
        "MISSING_DOCUMENTATION": lambda: structural.undocumented_functions(
            _view(), functions & F.contains(_lowered(), F.lit("public"))
        ),
        "MISSING_CLASS_DOCUMENTATION": lambda: structural.undocumented_classes(_view(), classes),
        "INCONSISTENT_INDENTATION": lambda: structural.mixed_indentation(_view(), indented),
        "DEEP_NESTING": lambda: structural.deep_nesting(_view(), indented),
        "LINE_TOO_LONG": lambda: structural.long_lines(_view()),
        "MISSING_STRICT_TYPES": lambda: structural.missing_strict_types(F.col("path"), _view()),
        "UNUSED_IMPORT": lambda: structural.unused_imports(_view()),
        "TRAILING_WHITESPACE": lambda: structural.trailing_whitespace(_view()),
    }
    return builders[rule_id]() if rule_id in builders else None


def _placed(rule_order: Column, pattern_order: Column, i: Column, h: Column) -> Column:
    return F.struct(
        rule_order.alias("rule_order"),
        pattern_order.alias("pattern_order"),
        i.alias("match_index"),
        h["line"].alias("line"),
        h["text"].alias("text"),
        h["number"].alias("number"),
    )


def _structural_hits(rules: Sequence[Rule]) -> list[Column]:
    arrays = []
    for order, rule in enumerate(rules):
        if rule.on and not rule.patterns:
            built = _structural(rule.rule_id)
            if built is None:
                raise ValueError(f"rule {rule.rule_id} has no patterns")
            at = F.lit(order)
            arrays.append(F.transform(built, lambda h, i: _placed(at, F.lit(0), i, h)))
    return arrays


def _pattern_hits(rules: Sequence[Rule]) -> list[Column]:
    """Hits of all pattern rules: mark the text per pattern, then locate the marks once.

    Patterns are grouped by their first token, so a text without it skips the
    whole group with one literal test; the other tokens are tested per pattern.
    """
    entry_type = "struct<rule:int,pattern:int,text:string>"
    groups: dict[str, list[Column]] = {}
    for order, rule in enumerate(rules):
        for k, p in enumerate(rule.patterns if rule.on else ()):
            first, *others = p.tokens or ("",)
            shape = (p.lead, p.body, p.trail, p.flags)
            text = F.when(has_all(_lowered(), others), marked(_view(), *shape))
            entry = F.struct(F.lit(order).alias("rule"), F.lit(k).alias("pattern"), text.alias("text"))
            groups.setdefault(first, []).append(entry)
    if not groups:
        return []
    nothing = F.array().cast(f"array<{entry_type}>")
    candidates = F.concat(
        *[
            F.when(F.contains(_lowered(), F.lit(first)), F.array(*entries)).otherwise(nothing)
            for first, entries in groups.items()
        ]
    )
    hits = F.flatten(
        F.transform(
            F.filter(candidates, lambda e: F.contains(e["text"], F.lit(MARK))),
            lambda e: F.transform(
                marked_hits(e["text"]), lambda h, i: _placed(e["rule"], e["pattern"], i, h)
            ),
        )
    )
    for order, rule in enumerate(rules):
        if rule.on and rule.rule_id in _SKIP:
            skip, at = _SKIP[rule.rule_id], order
            hits = F.filter(hits, lambda h: (h["rule_order"] != at) | ~skip(h["text"]))
    return [hits]


@lru_cache(maxsize=32)
def _hits(application: str, rules: tuple[Rule, ...]) -> Column:
    """The expression of a rule table; built once per application, since it is large."""
    arrays = _pattern_hits(rules) + _structural_hits(rules)
    return F.concat(*arrays) if arrays else F.array().cast(f"array<{HIT_TYPE}>")


def hits_of_rules(hits: Column, orders: Sequence[int]) -> Column:
    return F.filter(hits, lambda h: h["rule_order"].isin(*orders))


def _computed_once(frame: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that are evaluated exactly once per row.

    The values come out of a one-row generator. A later filter on them stays
    above it (through a plain projection the optimizer would push the filter
    down and compute the expression a second time), while filters on the other
    columns still reach the scan.
    """
    if not columns:
        return frame
    values = F.struct(*[c.alias(n) for n, c in columns.items()])
    rows = frame.select("*", F.explode(F.array(values)).alias("__computed"))
    return rows.withColumns({n: F.col("__computed")[n] for n in columns}).drop("__computed")


def _measured(files: DataFrame, asked: Collection[str] | None = None) -> DataFrame:
    """Files plus the view and the tests and metrics that are asked for, or all."""
    viewed = files.withColumns(
        {"__view": byte_view(F.col("content")), "__low": F.lower(F.col("content"))}
    )
    # Tests that several metrics and rules share.
    tests = {
        "__functions": F.contains(_lowered(), F.lit("function")),
        "__classes": F.contains(_lowered(), F.lit("class")),
        "__indented": has_indented_line(_view()),
    }
    tested = _computed_once(viewed, {n: t for n, t in tests.items() if asked is None or n in asked})
    metrics = {
        "cyclomatic_complexity": M.cyclomatic_complexity(_view()),
        "code_length": M.code_length(_view()),
        "lines_of_code": M.lines_of_code(_view()),
        "function_count": M.function_count(_view(), F.col("__functions")),
        "class_count": M.class_count(_view(), F.col("__classes")),
    }
    return _computed_once(tested, {n: m for n, m in metrics.items() if asked is None or n in asked})


def with_metrics(files: DataFrame) -> DataFrame:
    """Files plus their metrics (and the working columns)."""
    return _measured(files).withColumn(
        "complexity_level", M.complexity_level(F.col("cyclomatic_complexity"))
    )


def file_metrics(files: DataFrame) -> DataFrame:
    return with_metrics(files).drop(*WORKING_COLUMNS, "content")


def analyze_files(files: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """One row per file: metrics, ``hits``, counts per severity, total and score.

    ``files`` needs ``path`` and ``content``; all its other columns but the
    content are kept.
    """
    hits = _hits(files.sparkSession.sparkContext.applicationId, tuple(rules))
    with_hits = _computed_once(with_metrics(files), {"hits": hits})
    by_severity = {s: [i for i, r in enumerate(rules) if r.severity == s] for s in SEVERITIES}
    counted = with_hits.drop(*WORKING_COLUMNS, "content").withColumns(
        {
            f"{s}_count": F.size(hits_of_rules(F.col("hits"), own)) if own else F.lit(0)
            for s, own in by_severity.items()
        }
        | {"total_issues": F.size("hits")}
    )
    return scoring.with_score(counted)


def issue_texts(hit: dict[str, Column], rules: Sequence[Rule]) -> dict[str, Column]:
    """The texts of a hit, given its fields. No join: the rule table is literal arrays."""

    def by_rule(values: Sequence[str]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), hit["rule_order"] + 1)

    per_pattern = [
        F.array(*[F.lit(r.message_of(p)) for p in range(max(1, len(r.patterns)))]) for r in rules
    ]
    template = F.element_at(
        F.element_at(F.array(*per_pattern), hit["rule_order"] + 1), hit["pattern_order"] + 1
    )
    message = F.replace(
        F.replace(template, F.lit("{text}"), hit["text"]),
        F.lit("{number}"),
        hit["number"].cast("string"),
    )
    plain = by_rule([r.fix for r in rules])
    shows_name = hit["rule_order"].isin(*[i for i, r in enumerate(rules) if "{camel}" in r.fix])
    named = F.replace(plain, F.lit("{camel}"), snake_to_camel(hit["text"]))
    fix = F.when(shows_name, named).otherwise(plain)
    return {
        "severity": by_rule([r.severity for r in rules]),
        "category": by_rule([r.category for r in rules]),
        "message": message,
        "rule_id": by_rule([r.rule_id for r in rules]),
        "suggested_fix": fix,
    }


def issues_of(
    analyzed: DataFrame,
    rules: Sequence[Rule] = DEFAULT_RULES,
    keep: Sequence[str] = ("run_id", "path"),
) -> DataFrame:
    """One row per hit with the texts of its rule."""
    rows = analyzed.select(*keep, F.inline("hits"))
    fields = ("rule_order", "pattern_order", "match_index", "line", "text", "number")
    texts = issue_texts({f: F.col(f) for f in fields}, rules)
    return rows.select(
        *keep,
        F.col("line").alias("line_number"),
        *[c.alias(n) for n, c in texts.items()],
        "rule_order",
        "pattern_order",
        "match_index",
    )


def issues_by_severity(
    analyzed: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES
) -> DataFrame:
    """Per file a map with all four severities, each with its own issues (bounded by the file)."""
    fields = ("rule_order", "pattern_order", "match_index", "line", "text", "number")

    def issue(h: Column) -> Column:
        texts = issue_texts({f: h[f] for f in fields}, rules)
        return F.struct(h["line"].alias("line_number"), *[c.alias(n) for n, c in texts.items()], h["pattern_order"].alias("pattern_order"))

    entries = []
    for s in SEVERITIES:
        own = [i for i, r in enumerate(rules) if r.severity == s]
        entries += [F.lit(s), F.transform(hits_of_rules(F.col("hits"), own), issue)]
    return analyzed.select("run_id", "path", F.create_map(*entries).alias("by_severity"))


def detect(
    files: DataFrame,
    rules: Sequence[Rule] = DEFAULT_RULES,
    keep: Sequence[str] = ("run_id", "path"),
) -> DataFrame:
    """Files to issue rows; the union of all switched-on rules in one scan.

    Of the metrics and shared tests only those are computed that a rule asks for.
    """
    on = {r.rule_id for r in rules if r.on and not r.patterns}
    asked = {c for needs in (METRIC_OF_RULE, TEST_OF_RULE) for rule_id, c in needs.items() if rule_id in on}
    hits = _hits(files.sparkSession.sparkContext.applicationId, tuple(rules))
    return issues_of(_computed_once(_measured(files, asked), {"hits": hits}), rules, keep)
