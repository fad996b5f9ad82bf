"""Slices of source text by byte and by line, and cleaning of comments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line boundaries besides line feed and carriage return (fixed values of Python's splitlines).
OTHER_BREAKS = "\x0b\x0c\x1c\x1d\x1e\x85  "
_BREAK = "\\r\\n|[\\n\\r" + "".join(f"\\x{{{ord(c):x}}}" for c in OTHER_BREAKS) + "]"


def check_range(start: int, end: int, strict: bool = False) -> None:
    """A range may be empty in the service and not in the tool (``strict``)."""
    if start > end or (strict and start >= end):
        raise ValueError(f"start {start} must not lie {'at or ' if strict else ''}after end {end}")


def text_of(content: Column) -> Column:
    """Strict UTF-8: invalid bytes are an error."""
    return F.validate_utf8(content.cast("string"))


def try_text_of(content: Column) -> Column:
    """UTF-8, or null where the bytes are invalid."""
    return F.try_validate_utf8(content.cast("string"))


def byte_slice(content: Column, start: Column | int, end: Column | int, strict: bool = True) -> Column:
    """Bytes [start, end) as text, clamped to the content."""
    if isinstance(start, int) and isinstance(end, int):
        check_range(start, end)
    low = F.greatest(F.lit(start) if isinstance(start, int) else start, F.lit(0))
    high = F.least(F.lit(end) if isinstance(end, int) else end, F.octet_length(content))
    part = F.substring(content, low + 1, F.greatest(high - low, F.lit(0)))
    return text_of(part) if strict else try_text_of(part)


def lines(text: Column) -> Column:
    """Lines as Python's ``splitlines`` has them: every Unicode line boundary ends one, a final boundary begins none."""
    parts = F.split(text, _BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def line_slice(text: Column, start: int, end: int) -> Column:
    """Lines start..end (from 1, both included), clamped to the text and joined by line feeds."""
    check_range(start, end)
    all_ = lines(text)
    low = max(start, 1)
    return F.when(text.isNotNull(), F.array_join(F.slice(all_, F.lit(low), F.greatest(F.least(F.lit(end), F.size(all_)) - low + 1, F.lit(0))), "\n"))


def line_count(text: Column) -> Column:
    return F.size(lines(text))


def clean_comment(comment: Column) -> Column:
    """Text of a C comment: without its marks, each line trimmed and without its leading star."""
    s = F.trim(comment, F.lit(" \t\r\n"))
    block = F.when(s.startswith("/*") & s.endswith("*/"), F.substring(s, F.lit(3), F.greatest(F.length(s) - 4, F.lit(0))))
    body = block.when(s.startswith("//"), F.substring(s, F.lit(3), F.length(s))).otherwise(s)

    def line(x: Column) -> Column:
        t = F.trim(x, F.lit(" \t\r"))
        return F.when(t.startswith("* "), F.substring(t, F.lit(3), F.length(t))).when(t.startswith("*"), F.substring(t, F.lit(2), F.length(t))).otherwise(t)

    return F.trim(F.array_join(F.transform(F.split(body, "\n", -1), line), "\n"), F.lit(" \t\r\n"))


def clean_docstring(doc: Column) -> Column:
    """Text of a Python string literal without its quotes; prefixed literals stay as they are."""
    s = F.trim(doc, F.lit(" \t\r\n"))
    out = s
    for mark in ("'", '"', "'''", '"""'):
        n = len(mark)
        long_enough = F.length(s) >= 2 * n
        out = F.when(s.startswith(mark) & s.endswith(mark) & long_enough, F.trim(F.substring(s, F.lit(n + 1), F.length(s) - 2 * n), F.lit(" \t\r\n"))).otherwise(out)
    return out
