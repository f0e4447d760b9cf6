"""Whitespace, lines and other small text helpers as Column functions.

Whitespace means every Unicode space plus the four information separators; the engine's own
``trim`` knows only the blank.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Every whitespace character, as text and for use inside [...].
WHITESPACE = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                               *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_REST = r"\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
WS = rf"\t-\r{_REST}"
SPACE = rf"[{WS}]"                       # any whitespace
BLANK = rf"[\t\x0B-\r{_REST}]"          # whitespace inside a line
NONSPACE = rf"[^{WS}]"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def gsub(text: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(replacement))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def collapse(text: Column) -> Column:
    """Strip, and turn every run of whitespace into one blank."""
    return gsub(strip(text), rf"{SPACE}+", " ")


def collapse_lines(text: Column) -> Column:
    """Collapse whitespace inside each line and drop empty lines."""
    joined = gsub(text, rf"(?<!{BLANK}){BLANK}*+\n{SPACE}*+", "\n")
    return strip(gsub(joined, rf"{BLANK}+", " "))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def unlines(parts: Column) -> Column:
    return F.array_join(parts, "\n")


def each_line(text: Column, rule: Callable[[Column], Column]) -> Column:
    return unlines(F.transform(lines(text), rule))


def quoted(text: Column) -> Column:
    """A data value as a literal inside a pattern."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def as_replacement(text: Column) -> Column:
    """A data value as a literal inside a replacement."""
    return gsub(text, r"([\\$])", r"\\$1")
