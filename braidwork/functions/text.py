"""Text functions with Unicode line and space rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every line terminator, CRLF as one.
TERMINATOR = "(?:\r\n|[\n\u000b\f\r\u001c-\u001e\u0085  ])"
_SPACE = "[\\s\u001c-\u001f]"


def unix_lines(text: Column) -> Column:
    """The text with one final terminator taken off and every other one as a line feed."""
    return F.regexp_replace(F.regexp_replace(text, TERMINATOR + r"\z", ""), TERMINATOR, "\n")


def lines(text: Column) -> Column:
    """The lines of a text; an empty text has none, and a final terminator opens none."""
    return F.when(F.length(text) > 0, F.split(unix_lines(text), "\n", -1)).when(text.isNotNull(), F.array().cast("array<string>"))


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def heading_title(line: Column) -> Column:
    """A heading line without its leading # and spaces."""
    return strip(F.regexp_replace(line, r"\A[# ]+", ""))


def any_case(pattern: str) -> str:
    """A pattern for rlike that ignores case and takes all Unicode white space for \\s."""
    return "(?iU)" + pattern.replace(r"\s", _SPACE)


def preview(text: Column, length: int) -> Column:
    return F.left(text, F.lit(length))


def default_if_empty(text: Column, default: str) -> Column:
    """The default in place of null and of an empty text."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def render(template: str, **values: Column) -> Column:
    """The template with each {name} replaced literally, in one pass: braces and names in values are left alone."""
    parts = re.split(r"\{(" + "|".join(map(re.escape, values)) + r")\}", template) if values else [template]
    return F.concat(*(values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)))
