"""Text made from answers and hits: links, headlines, reports."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from placesearch.functions.text import SPACE, WHITESPACE, bind, gsub, lines, strip, unlines

RULE = "-" * 50
# noncharacters: they never occur in interchanged text
_STEP, _EDGE = "\ufdd1", "\ufdd2"


# letters whose simple capital and small forms Python knows only as several letters
_ODD = {"\u0130": "i"}
# an automaton looks for more names than these at once
_FEW_NAMES = 8


class _Letters(dict):
    """One letter for all its cases; filled as letters are met, so it is as small as the alphabet."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        capital = c.upper() if len(c.upper()) == 1 else c
        small = capital.lower() if len(capital.lower()) == 1 else capital
        self[code] = _ODD.get(c, small)
        return self[code]


class _Words(dict):
    """Whether a letter belongs to a word."""

    def __missing__(self, c: str) -> bool:
        kind = unicodedata.category(c)
        self[c] = c.isalpha() or kind in ("Nl", "Nd", "Mn", "Mc", "Me", "Pc") or c in "\u200c\u200d"
        return self[c]


_LETTERS, _WORDS = _Letters(), _Words()


def _fold(text: str) -> str:
    """The text without cases, letter by letter, so that places stay the same."""
    return text.lower() if text.isascii() else text.translate(_LETTERS)


def _mentions(text: str, folded: str, name: str, whole: bool, start: int = 0) -> Iterator[tuple[int, int]]:
    """Places of a folded name outside bold marks; ``whole``: as a word of its own."""
    def bound(at: int) -> bool:
        return (at > 0 and _WORDS[text[at - 1]]) != (at < len(text) and _WORDS[text[at]])

    at = folded.find(name, start)
    while at >= 0:
        end = at + len(name)
        if (not (text.endswith("**", 0, at) or text.startswith("**", end))
                and (not whole or (bound(at) and bound(end)))):
            yield at, end
            at = folded.find(name, end)
        else:
            at = folded.find(name, at + 1)


def _present(folded: str, names: list[str]) -> set[str]:
    """The folded names that occur in a text; many are looked for in one pass by an automaton."""
    if len(names) <= _FEW_NAMES:
        return {n for n in names if n in folded}
    finder = ahocorasick.Automaton()
    for n in names:
        finder.add_word(n, n)
    finder.make_automaton()
    return {n for _, n in finder.iter(folded)}


def link_names(text: str, hits: list[tuple[str, str]]) -> str:
    """One text with the mentions of ``(name, url)`` marked; see ``link_entities``."""
    first_url: dict[str, str] = {}
    for name, url in hits:
        if (name or "").strip(WHITESPACE):
            first_url.setdefault(name, url or "")
    entries = sorted(first_url.items(), key=lambda e: -len(e[0]))
    folded = _fold(text)
    # a name with a star may come to be by the marking itself
    there = _present(folded, [_fold(n) for n, _ in entries])
    held = {}
    for i, (name, url) in enumerate(entries):
        low = _fold(name)
        if low not in there and "*" not in low:
            continue
        whole = not any(c in WHITESPACE for c in name.strip(WHITESPACE))
        place = next(_mentions(text, folded, low, whole), None)
        if place is None:
            continue
        bold, low_bold = f"**{name}**", f"**{low}**"
        first, low_first = bold, low_bold
        if url:
            first = low_first = _EDGE + _STEP * (i + 1) + _EDGE
            held[first] = f"[**{name}**]({url if url.startswith('http') else 'https://' + url})"
        at, end = place
        text, folded = text[:at] + first + text[end:], folded[:at] + low_first + folded[end:]
        parts, low_parts, done = [], [], 0
        for at, end in _mentions(text, folded, low, whole, at + len(first)):
            parts += [text[done:at], bold]
            low_parts += [folded[done:at], low_bold]
            done = end
        if parts:
            text = "".join([*parts, text[done:]])
            folded = "".join([*low_parts, folded[done:]])
    for mark, link in held.items():
        text = text.replace(mark, link)
    return text


@F.pandas_udf(T.StringType())
def _linked(texts: pd.Series, names: pd.Series, urls: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or n is None else link_names(t, list(zip(n, u)))
                      for t, n, u in zip(texts, names, urls)], dtype=object)


def link_entities(text: Column, hits: Column) -> Column:
    """First mention of each name becomes a bold link, or bold without a URL; later ones bold.

    ``hits``: ``ARRAY<STRUCT<name, url>>``.  Longer names go first.  Case does not matter, bold text
    is left alone, and nothing inside a new link is touched again.  Names are looked for as they are,
    all in one pass where there are many, so no pattern is made of a name.
    """
    return _linked(text, F.transform(hits, lambda h: h["name"]), F.transform(hits, lambda h: h["url"]))


def _clean_title(title: Column) -> Column:
    bare = F.replace(gsub(title, rf"^#+{SPACE}+", ""), F.lit("**"), F.lit(""))
    return gsub(bare, rf"(?i)^(?:Title:|Catchy Title:|Headline:){SPACE}*", "")


def standardize_headline(text: Column) -> Column:
    """What stands before the first list item or paragraph break becomes one ``###`` title."""
    def numbered(rows: Column) -> Column:
        return F.transform(rows, lambda line, i: F.struct(i.alias("i"), strip(line).alias("s"),
                                                          line.alias("line")))

    def separator(rows: Column, start: Column) -> Column:
        marks = F.filter(rows, lambda r: (r["i"] > start) & (
            F.startswith(r["s"], F.lit("*")) | F.startswith(r["s"], F.lit("-"))
            | ((r["s"] == "") & (F.coalesce(F.get(rows, r["i"] + 1)["s"], F.lit("")) != ""))))
        return F.get(marks, F.lit(0))["i"]

    def one_line(rows: Column, start: Column) -> Column:
        def fix(r: Column) -> Column:
            title = _clean_title(r["s"])
            header = F.startswith(r["s"], F.lit("# ")) | F.startswith(r["s"], F.lit("## "))
            return (F.when((r["i"] == start) & (title != ""), F.concat(F.lit("### "), title))
                    .when((r["i"] > start) & header, gsub(r["line"], rf"^#+{SPACE}+", "### "))
                    .otherwise(r["line"]))

        return unlines(F.transform(rows, fix))

    def several(rows: Column, start: Column, sep: Column) -> Column:
        head = F.filter(rows, lambda r: (r["i"] >= start) & (r["i"] < sep) & (r["s"] != ""))
        title = strip(_clean_title(F.array_join(F.transform(head, lambda r: r["s"]), " ")))
        rest = F.transform(F.filter(rows, lambda r: r["i"] >= sep), lambda r: r["line"])
        return F.concat(F.lit("### "), title, F.lit("\n\n"), unlines(rest))

    def whole(rows: Column) -> Column:
        start = F.get(F.filter(rows, lambda r: r["s"] != ""), F.lit(0))["i"]
        return bind(F.struct(start.alias("start"), separator(rows, start).alias("sep")),
                    lambda at: F.when(at["start"].isNull(), text)
                    .when(at["sep"].isNull(), one_line(rows, at["start"]))
                    .otherwise(several(rows, at["start"], at["sep"])))

    return bind(numbered(lines(text)), whole)


def join_contents(contents: Column) -> Column:
    return F.array_join(contents, "\n\n")


def results_report(query: Column, contents: Column) -> Column:
    """A header and every result with its number and a rule."""
    results = F.transform(contents, lambda text, i: F.concat(
        F.lit("Result "), (i + 1).cast("string"), F.lit(":\n"), text, F.lit(f"\n{RULE}\n\n")))
    return F.concat(F.lit("Search query: "), query, F.lit("\n\n"), F.array_join(results, ""))


def results_markdown(contents: Column) -> Column:
    """The results as shown on a page."""
    return F.array_join(F.transform(contents, lambda text, i: F.concat(
        F.lit("## Result "), (i + 1).cast("string"), F.lit(":\n\n"), text, F.lit("\n\n---"))),
        "\n")


def summary_report(query: Column, summary: Column, label: bool = True) -> Column:
    return F.concat(F.lit("Search query: "), query, F.lit("\n\n"),
                    F.lit("SUMMARY:\n\n" if label else ""), summary)
