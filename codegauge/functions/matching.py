"""Locate regex matches by line with built-in expressions only.

A match is reported at the line where its reported part begins. One
``regexp_replace`` puts a marker character in front of that part. Of a few markers
the newlines before each are counted; with more, the marked text is split into
lines and the markers of each line are listed. The work is linear in the text for
any number of matches. The marker is outside Latin-1, so
it cannot occur in a byte view.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from codegauge.functions.bytesview import newlines

MARK = "\uE000"
STOP = "\uE001"
FEW = 16  # so many markers are looked up one by one, more of them line by line

HIT = "struct<line:int,text:string,number:int>"
HITS = f"array<{HIT}>"


def no_hits() -> Column:
    return F.array().cast(HITS)


def hit(line: Column, text: Column | None = None, number: Column | None = None) -> Column:
    return F.struct(
        line.cast("int").alias("line"),
        (F.lit("") if text is None else text).cast("string").alias("text"),
        (F.lit(0) if number is None else number).cast("int").alias("number"),
    )


def hits_at_marks(marked_text: Column, of_mark: Callable, of_line: Callable) -> Column:
    """Hits of a marked text: ``of_mark`` (line number, text up to the next marker) makes the
    hit of one of few markers, ``of_line`` (line, its place) all hits of a line where there are many.
    """

    def of_text(text: Column, pieces: Column) -> Column:
        def of_piece(piece: Column, k: Column) -> Column:
            before = F.call_function("substring_index", text, F.lit(MARK), (k + 1).cast("int"))
            return of_mark(newlines(before) + 1, piece)

        count = F.size(pieces) - 1
        few = F.transform(F.slice(pieces, F.lit(2), count), of_piece)
        many = F.flatten(F.transform(F.split(text, "\n", -1), of_line))
        return F.when(count <= FEW, few).otherwise(many)

    # Arrays of one element hold the text and its pieces, so that each is computed once.
    listed = F.transform(
        F.array(marked_text),
        lambda text: F.transform(F.array(F.split(text, MARK, -1)), lambda pieces: of_text(text, pieces)),
    )
    return F.flatten(F.flatten(listed))


def marked_hits(marked_text: Column, word: str = r"\w*") -> Column:
    """All markers of a marked text as (line, word that follows the marker)."""

    def of_line(line: Column, i: Column) -> Column:
        found = F.transform(
            F.regexp_extract_all(line, F.lit(f"{MARK}({word})"), F.lit(1)), lambda t: hit(i + 1, t)
        )
        return F.when(F.contains(line, F.lit(MARK)), found).otherwise(no_hits())

    return hits_at_marks(marked_text, lambda line, piece: hit(line, F.regexp_extract(piece, f"^({word})", 1)), of_line)


def marked(text: Column, lead: str, body: str, trail: str, flags: str = "") -> Column:
    """Text with a marker in front of the body of each match of lead+body+trail."""
    if not lead:
        return F.regexp_replace(text, f"(?d{flags}){body}{trail}", MARK + "$0")
    # Named groups, so capturing groups inside the parts do not matter.
    pattern = f"(?d{flags})(?<lead>{lead})(?<rest>{body}{trail})"
    return F.regexp_replace(text, pattern, "${lead}" + MARK + "${rest}")


def has_all(lowered: Column, tokens: Iterable[str]) -> Column:
    """Cheap literal tests, tried in order."""
    test = F.lit(True)
    for token in tokens:
        test = test & F.contains(lowered, F.lit(token))
    return test


def line_starts_with(text: Column, lead: str) -> Column:
    """Whether some line of the text starts with a literal."""
    return F.startswith(text, F.lit(lead)) | F.contains(text, F.lit("\n" + lead))


def has_indented_line(text: Column) -> Column:
    """Whether some line starts with a blank byte (white space that ends no line, or NUL)."""
    return F.rlike(text, F.lit(r"(?:\A|\n)[ \t\r\x00\x0B]"))
