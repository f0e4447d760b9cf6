"""Links, headlines and reports."""

import pytest
from pyspark.sql import functions as F

from placesearch.functions import answers as a

HITS = "array<struct<name:string,url:string>>"


@pytest.fixture
def link(spark):
    def run(text, hits):
        df = spark.createDataFrame([(text, hits)], f"t string, h {HITS}")
        return df.select(a.link_entities(F.col("t"), F.col("h")).alias("r")).first().r
    return run


@pytest.mark.parametrize("text, hits, wanted", [
    ("Joe and joe", [("Joe", "j.com")], "[**Joe**](https://j.com) and **Joe**"),
    ("Joe", [("Joe", "http://j.com")], "[**Joe**](http://j.com)"),
    ("Joe, Joe", [("Joe", None)], "**Joe**, **Joe**"),
    ("**Joe** Joey", [("Joe", "j.com")], "**Joe** Joey"),
    ("Joe's Diner by Joe", [("Joe", "j.com"), ("Joe's Diner", "d.com")],
     "[**Joe's Diner**](https://d.com) by [**Joe**](https://j.com)"),
    ("at com", [("Big Com", "big.com"), ("com", "x.org")], "at [**com**](https://x.org)"),
    ("Big Com", [("Big Com", "big.com"), ("com", "x.org")], "[**Big Com**](https://big.com)"),
    ("A+B $5 \\E x", [("A+B $5 \\E", "u.com")], "[**A+B $5 \\E**](https://u.com) x"),
    ("none", [("Zed", "z.com"), ("", "e.com"), (None, "n.com"), (" ", "s.com")], "none"),
    ("Joe", [("Joe", "a.com"), ("Joe", "b.com")], "[**Joe**](https://a.com)"),
    ("l'ÉTÉ", [("été", "e.com")], "l'[**été**](https://e.com)"),
    ("x", [], "x")])
def test_link_entities(link, text, hits, wanted):
    assert link(text, hits) == wanted


def test_many_names_are_found_in_one_pass():
    names = [f"Place {chr(97 + i % 26)}{i}" for i in range(300)]
    text = " ".join(f"see {n.upper()} or {n}." for n in names[::7])
    hits = [(n, f"{i}.com" if i % 2 else None) for i, n in enumerate(names)]
    assert a.link_names(text, hits) == " ".join(
        f"see {f'[**{n}**](https://{i * 7}.com)' if i * 7 % 2 else f'**{n}**'} or **{n}**." for i, n in enumerate(names[::7]))
    assert a.link_names(text, hits[:3] * 4) == a.link_names(text, hits[:3])


@pytest.mark.parametrize("text, hits, wanted", [
    ("a b cdef", [("a b", "x.com"), ("b cdef", "y.com")], "a [**b cdef**](https://y.com)"),
    ("Joe XJoe X", [("Joe X", None)], "**Joe X**Joe X"),
    ("Joe XJoe X", [("Joe X", "x.com")], "[**Joe X**](https://x.com)**Joe X**"),
    ("Big Joe Inn", [("Joe", None), ("Big Joe Inn", None)], "**Big **Joe** Inn**"),
    ("Stra\u00dfe stra\u00dfe", [("Stra\u00dfe", "s.com")], "[**Stra\u00dfe**](https://s.com) **Stra\u00dfe**"),
    ("Joe's, joe", [("Joe", "a.com"), ("joe", "b.com")], "[**Joe**](https://a.com)'s, **Joe**"),
    (None, [("a", "b")], None), ("a", None, None)])
def test_names_that_touch_or_overlap(link, text, hits, wanted):
    assert link(text, hits) == wanted


@pytest.mark.parametrize("text, wanted", [
    ("# Title: Pie\nmore", "### Pie\nmore"), ("**Pie**\n# Sub\n## Two\n### Three\n # odd",
                                             "### Pie\n### Sub\n### Two\n### Three\n # odd"),
    ("\n\n## Pie\n\nText\n* a", "### Pie\n\n\nText\n* a"),
    ("Catchy Title: A\nB\n* x\n* y", "### A B\n\n* x\n* y"), ("A\n**bold** next", "### A\n\n**bold** next"),
    ("A\n- x", "### A\n\n- x"), ("A\n\n\nB", "### A\n\n\nB"), (" \n ", " \n "), ("", ""),
    ("HEADLINE:  a", "### a"), ("A\n\n", "### A\n\n")])
def test_headline(one, text, wanted):
    assert one(a.standardize_headline, text) == wanted


def test_reports(one):
    rule = "-" * 50
    texts = ["one", "two"]
    assert one(lambda c: a.results_report(F.lit("q"), c), texts, "array<string>") == (
        f"Search query: q\n\nResult 1:\none\n{rule}\n\nResult 2:\ntwo\n{rule}\n\n")
    assert one(a.join_contents, texts, "array<string>") == "one\n\ntwo"
    assert one(lambda t: a.summary_report(F.lit("q"), t), "s") == "Search query: q\n\nSUMMARY:\n\ns"
    assert one(lambda t: a.summary_report(F.lit("q"), t, False), "s") == "Search query: q\n\ns"
