"""Per-file metrics over the byte view; every one is a map-side expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codegauge.functions.bytesview import WORD_START, line_count

# The keywords that open a decision point, and the level bounds.
DECISION_KEYWORDS = ("if", "elseif", "else", "switch", "case", "while", "for", "foreach", "catch")
LEVEL_BOUNDS = ((10, "low"), (20, "medium"), (50, "high"))
TOP_LEVEL = "very_high"

# Everything that cannot hold a decision point is matched (and skipped) first:
# text outside the code tags, comments, here-documents and quoted strings. The
# quantifiers are possessive, so long literals need no stack.
_OUTSIDE = r"(?:\A|\?>)(?:(?!<\?(?:php(?=\s|\z)|=)).)*+(?:<\?(?:php|=)|\z)"
_BLOCK_COMMENT = r"/\*.*?(?:\*/|\z)"
_LINE_COMMENT = r"(?://|#(?!\[))(?:(?!\?>)[^\n])*+"
_BREAK = r"(?:\r\n|\n|\r)"
_HEREDOC = (
    r"<<<[ \t]*[\x22\x27]?(?<tag>[a-z_][a-z0-9_]*)[\x22\x27]?" + _BREAK
    + r"(?:[ \t]*|.*?" + _BREAK + r"[ \t]*)\k<tag>(?![a-z0-9_])"
)
_SINGLE = r"\x27(?:[^\x27\\]|\\.)*+(?:\x27|\z)"
# An expression in braces may hold quotes of its own.
_INSERTED = r"\{\$[^{}\n]*+\}"
_DOUBLE = rf"\x22(?:[^\x22\\{{]|\\.|{_INSERTED}|\{{)*+(?:\x22|\z)"
_SHELL = rf"\x60(?:[^\x60\\{{]|\\.|{_INSERTED}|\{{)*+(?:\x60|\z)"
_KEYWORD = (
    # The first letters are tested first, then what stands before.
    r"(?=[cefisw])(?<![a-z0-9_\x80-\xff\$\\])(?<!->)(?:" + "|".join(DECISION_KEYWORDS) + r")(?![a-z0-9_\x80-\xff\\])"
)
# One look at a character tells whether any part can begin there; only the first may begin anywhere.
_DECISION = (
    r"(?isd)(?:\A|(?=[?/#<\x27\x22\x60&|cefisw]))(?:"
    + "|".join([_OUTSIDE, _BLOCK_COMMENT, _LINE_COMMENT, _HEREDOC, _SINGLE, _DOUBLE, _SHELL])
    + "|(?<point>" + _KEYWORD + r"|&&|\|\|))"
)
# The here-document tag is group 1, the decision point group 2.
_POINT_GROUP = 2


def cyclomatic_complexity(view: Column) -> Column:
    """1 + decision keywords and boolean operators in code; text without code tags is 1."""
    points = F.filter(
        F.regexp_extract_all(view, F.lit(_DECISION), F.lit(_POINT_GROUP)), lambda x: x != ""
    )
    return F.when(F.contains(view, F.lit("<?")), 1 + F.size(points)).otherwise(1).cast("int")


def code_length(view: Column) -> Column:
    return F.length(view).cast("long")


def lines_of_code(view: Column) -> Column:
    return line_count(view)


def function_count(view: Column, possible: Column) -> Column:
    pattern = rf"(?i)(?=f){WORD_START}function\s+\w+\s*\("
    return F.when(possible, F.regexp_count(view, F.lit(pattern))).otherwise(0).cast("int")


def class_count(view: Column, possible: Column) -> Column:
    pattern = rf"(?i)(?=c){WORD_START}class\s+\w+"
    return F.when(possible, F.regexp_count(view, F.lit(pattern))).otherwise(0).cast("int")


def complexity_level(complexity: Column) -> Column:
    level = F
    for bound, name in LEVEL_BOUNDS:
        level = level.when(complexity <= bound, name)
    return level.otherwise(TOP_LEVEL)
