"""Rules that need more than a pattern: lengths, nesting, documentation, imports.

Each function returns an array of hits for one file and is empty where the rule
does not fire. Expensive parts sit behind a cheap test on the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codegauge.functions.bytesview import WORD_END, WORD_START, newlines
from codegauge.functions.matching import (
    HITS,
    MARK,
    STOP,
    hit,
    hits_at_marks,
    line_starts_with,
    marked_hits,
    no_hits,
)
from codegauge.operators.catalog import (
    DOC_WINDOW,
    INDENT_WIDTH,
    MAX_COMPLEXITY,
    MAX_FILE_LINES,
    MAX_FUNCTION_LINES,
    MAX_LINE_BYTES,
    MAX_NESTING,
)

_OPEN_FUNCTIONS = "array<struct<name:string,line:int,at:int,depth:int>>"


def long_functions(view: Column, lines: Column, possible: Column) -> Column:
    """Functions whose body spans more than the allowed newlines.

    Headers get a marker where they start and one with the name before their
    brace; then one pass over braces, newlines and markers counts the open braces and
    keeps the functions that are open, each with the depth of its brace, so braces of
    other kinds cost nothing however many stay open. A function ends at its own
    closing brace or at the end of the text. Braces in quotes count, as do braces of
    functions nested inside.
    """
    header = r"(?id)(?<start>function\s+)(?<name>\w+)(?<args>\s*\([^)]*\)\s*)\{"
    marked = F.regexp_replace(
        view, header, f"{MARK}${{start}}${{name}}${{args}}{STOP}${{name}}{STOP}{{"
    )
    tokens = F.regexp_extract_all(marked, F.lit(rf"{MARK}|{STOP}\w+{STOP}\{{|[{{}}\n]"), F.lit(0))
    start = F.struct(
        F.lit(0).alias("nl"),
        F.lit(0).alias("header"),
        F.lit(0).alias("depth"),
        F.array().cast(_OPEN_FUNCTIONS).alias("open"),
        no_hits().alias("ended"),
    )
    state_type = (
        f"struct<nl:int,header:int,depth:int,open:{_OPEN_FUNCTIONS},ended:{HITS}>"
    )

    def opened(state: Column, name: Column) -> Column:
        entry = F.struct(
            name.alias("name"), state["header"].alias("line"), state["nl"].alias("at"),
            (state["depth"] + 1).alias("depth"),
        )
        return F.concat(state["open"], F.array(entry).cast(_OPEN_FUNCTIONS))

    def closed(state: Column, entries: Column) -> Column:
        return F.transform(
            F.filter(entries, lambda e: state["nl"] - e["at"] > MAX_FUNCTION_LINES),
            lambda e: hit(e["line"], e["name"], state["nl"] - e["at"]),
        )

    def step(state: Column, token: Column) -> Column:
        count = F.size(state["open"])
        is_header = F.startswith(token, F.lit(STOP))
        last = F.try_element_at(state["open"], F.lit(-1))
        ends = (token == "}") & (count > 0) & (last["depth"] == state["depth"])
        top = F.slice(state["open"], F.greatest(count, F.lit(1)), 1)
        rest = F.slice(state["open"], 1, F.greatest(count - 1, F.lit(0)))
        return F.struct(
            F.when(token == "\n", state["nl"] + 1).otherwise(state["nl"]).alias("nl"),
            F.when(token == MARK, state["nl"] + 1).otherwise(state["header"]).alias("header"),
            F.when((token == "{") | is_header, state["depth"] + 1)
            .when(token == "}", F.greatest(state["depth"] - 1, F.lit(0)))
            .otherwise(state["depth"])
            .alias("depth"),
            F.when(is_header, opened(state, F.regexp_extract(token, r"\w+", 0)))
            .when(ends, rest)
            .otherwise(state["open"])
            .alias("open"),
            F.when(ends, F.concat(state["ended"], closed(state, top)))
            .otherwise(state["ended"])
            .alias("ended"),
        ).cast(state_type)

    hits = F.aggregate(
        tokens,
        start.cast(state_type),
        step,
        lambda state: F.concat(state["ended"], closed(state, state["open"])),
    )
    in_order = F.array_sort(hits)
    long_enough = (lines > MAX_FUNCTION_LINES + 1) & possible
    return F.when(long_enough, in_order).otherwise(no_hits())


def long_file(lines: Column) -> Column:
    return F.when(lines > MAX_FILE_LINES, F.array(hit(F.lit(1), None, lines))).otherwise(no_hits())


def high_complexity(complexity: Column) -> Column:
    return F.when(
        complexity > MAX_COMPLEXITY, F.array(hit(F.lit(1), None, complexity))
    ).otherwise(no_hits())


def _undocumented(view: Column, test: Column, pattern: str) -> Column:
    """Matches of a pattern (its group ``name`` is reported) without a doc block nearby.

    The window is the 200 bytes before the match; for a match in the first 200
    bytes it is always the first 200 bytes of the file, so it may reach past the
    match. The look-behind hands out the window of each later match.
    """
    n = DOC_WINDOW
    marked = F.regexp_replace(
        view, f"(?id)(?<all>{pattern})", f"{MARK}${{name}}{STOP}${{all}}"
    )
    before = (
        rf"(?id)(?={pattern})(?:(?<=((?s:.{{{n}}})))|(?<!(?s:.{{{n}}}))){pattern}"
    )
    # The named group of the first look-ahead is group 1, the window group 2.
    windows = F.regexp_extract_all(view, F.lit(before.replace("(?<name>", "(", 2)), F.lit(2))
    documented = F.transform(
        windows,
        lambda w: F.rlike(
            F.when(w == "", F.substring(view, 1, n)).otherwise(w), F.lit(r"(?s)/\*\*.*?\*/")
        ),
    )
    paired = F.arrays_zip(marked_hits(marked).alias("hit"), documented.alias("doc"))
    missing = F.transform(F.filter(paired, lambda p: ~p["doc"]), lambda p: p["hit"])
    return F.when(test, missing).otherwise(no_hits())


def undocumented_functions(view: Column, possible: Column) -> Column:
    pattern = r"public\s+function\s+(?<name>\w+)\s*\([^)]*\)"
    test = possible & F.rlike(view, F.lit(r"(?i)public\s+function\s+\w+\s*\("))
    return _undocumented(view, test, pattern)


def undocumented_classes(view: Column, possible: Column) -> Column:
    pattern = r"class\s+(?<name>\w+)"
    test = possible & F.rlike(view, F.lit(r"(?i)class\s+\w"))
    return _undocumented(view, test, pattern)


def mixed_indentation(view: Column, indented: Column) -> Column:
    """First line at which a line led by 4 spaces and one led by a tab were both seen."""

    def first_line(lead: str) -> Column:
        return newlines(F.split(view, f"(?dm)^{lead}", 2)[0]) + 1

    spaces, tab = "    ", "\t"
    both = indented & line_starts_with(view, tab) & line_starts_with(view, spaces)
    at = F.greatest(first_line(spaces), first_line(tab))
    return F.when(both, F.array(hit(at))).otherwise(no_hits())


def _line_hits(view: Column, test: Column, start: str, number) -> Column:
    """Hits on the lines that begin with a pattern, with a measured number."""

    def of_mark(at: Column, piece: Column) -> Column:
        return hit(at, None, number(F.substring_index(piece, "\n", 1)))

    def of_line(line: Column, i: Column) -> Column:
        fires = F.startswith(line, F.lit(MARK))
        return F.when(fires, F.array(hit(i + 1, None, number(F.substring(line, F.lit(2), F.length(line)))))).otherwise(no_hits())

    marked = F.regexp_replace(view, f"(?dm)^{start}", MARK + "$0")
    return F.when(test, hits_at_marks(marked, of_mark, of_line)).otherwise(no_hits())


def deep_nesting(view: Column, indented: Column) -> Column:
    """Lines whose leading whitespace is worth more than the allowed levels."""
    blanks = " \t\r\x00\x0B"
    least = (MAX_NESTING + 1) * INDENT_WIDTH
    test = indented & F.rlike(view, F.lit(rf"(?dm)^[{blanks}]{{{least}}}"))

    def indent(line: Column) -> Column:
        return F.length(line) - F.length(F.ltrim(line, F.lit(blanks)))

    return _line_hits(
        view, test, f"[{blanks}]{{{least}}}", lambda line: F.floor(indent(line) / INDENT_WIDTH)
    )


def long_lines(view: Column) -> Column:
    test = (F.length(view) > MAX_LINE_BYTES) & F.rlike(
        view, F.lit(rf"(?dm)^[^\n]{{{MAX_LINE_BYTES + 1}}}")
    )
    return _line_hits(view, test, rf"[^\n]{{{MAX_LINE_BYTES + 1}}}", F.length)


def trailing_whitespace(view: Column) -> Column:
    # A line holds no newline, so the rest of the white space is what can end it.
    test = F.rlike(view, F.lit(r"(?d)[ \t\x0B\f\r](?:\n|\z)"))

    def of_line(line: Column, i: Column) -> Column:
        return F.when(F.rlike(line, F.lit(r"[ \t\x0B\f\r]\z")), hit(i + 1))

    found = F.filter(F.transform(F.split(view, "\n", -1), of_line), lambda h: h.isNotNull())
    return F.when(test, found).otherwise(no_hits())


def missing_strict_types(path: Column, view: Column) -> Column:
    declared = F.rlike(view, F.lit(r"(?i)declare\s*\(\s*strict_types\s*=\s*1\s*\)\s*;"))
    return F.when(
        F.endswith(path, F.lit(".php")) & ~declared, F.array(hit(F.lit(1)))
    ).otherwise(no_hits())


def unused_imports(view: Column) -> Column:
    """Imports whose short name occurs nowhere but straight after ``use`` and one blank.

    The words of the file are listed once (each maximal word not preceded by
    ``use`` and one white space); an import is unused if its alias, or else the
    last part of its name, is not among them.
    """
    test = line_starts_with(view, "use") & F.rlike(view, F.lit(r"(?dm)^use\s"))
    statement = r"(?dm)(?<all>^use\s+(?<full>[\w\\]+)(?:\s+as\s+(?<alias>\w+))?\s*;)"
    imports = marked_hits(
        F.regexp_replace(view, statement, f"{MARK}${{full}}|${{alias}}{STOP}${{all}}"),
        word=f"[^{STOP}]*",
    )
    words = F.regexp_extract_all(view, F.lit(rf"(?=\w){WORD_START}(?<!use\s)\w+{WORD_END}"), F.lit(0))

    def named(h: Column) -> Column:
        parts = F.split(h["text"], r"\|")
        short = F.when(parts[1] != "", parts[1]).otherwise(
            F.element_at(F.split(parts[0], r"\\", -1), -1)
        )
        return F.struct(h["line"].alias("line"), parts[0].alias("full"), short.alias("short"))

    listed = F.transform(imports, named)
    unused = F.array_except(F.transform(listed, lambda i: i["short"]), words)
    hits = F.transform(
        F.filter(listed, lambda i: (i["short"] != "") & F.array_contains(unused, i["short"])),
        lambda i: hit(i["line"], i["full"]),
    )
    return F.when(test, hits).otherwise(no_hits())
