"""One character per byte, so lengths and offsets in expressions are byte-exact.

The analysis works on bytes: ``length`` of the byte view is the size in bytes,
``\\w`` and ``\\s`` see single bytes, and the bytes of a multi-byte letter are
never word characters. Patterns run on the view must follow three rules: start
with ``(?d)`` so that only a newline ends a line, spell word boundaries as the
look-arounds below (``\\b`` would treat Latin-1 letters as word characters), and
never match the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_START = r"(?<![A-Za-z0-9_])"
WORD_END = r"(?![A-Za-z0-9_])"


def byte_view(content: Column) -> Column:
    """Text as Latin-1 characters, one per UTF-8 byte (invalid bytes included)."""
    return F.decode(content.cast("binary"), "ISO-8859-1")


def newlines(text: Column) -> Column:
    """Number of newline characters."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def line_count(text: Column) -> Column:
    """Lines of a text: newlines + 1, so empty text is one line."""
    return (newlines(text) + 1).cast("int")


def line_of(text: Column, offset: Column) -> Column:
    """1-based line that holds a 0-based byte offset of a byte view."""
    return (newlines(F.substring(text, F.lit(1), offset)) + 1).cast("int")
