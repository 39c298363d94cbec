"""Scalar functions over source text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends as Python's ``splitlines`` knows them.
LINE_END = "\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029]"


def line_count(text: Column) -> Column:
    """Lines of a text; a last line without an end counts, what follows a last end does not."""
    open_end = (text != "") & ~F.substring(text, -1, 1).rlike(f"^(?:{LINE_END})$")
    return (F.regexp_count(text, F.lit(LINE_END)) + open_end.cast("int")).cast("long")


def marker_count(text: Column, word: str) -> Column:
    """Occurrences of a marker as a whole word, in either case."""
    return F.regexp_count(text, F.lit(rf"(?iU)\b{word}\b")).cast("long")


def source_text(content: Column) -> Column:
    """Bytes as text: invalid UTF-8 replaced, all line ends of the platform's kinds as newlines."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), F.lit("\r\n|\r"), F.lit("\n"))
