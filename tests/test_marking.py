"""Layout rules on hand-worked lines."""

import pytest

from placesearch.functions import marking as m
from placesearch.functions.text import collapse_lines, strip
from placesearch.operators import textrecords as rec


@pytest.mark.parametrize("text, wanted", [
    ("\t a\n\u00a0b \n\n\u3000c", "a\nb \n\nc"), ("\x1c\x1fa", "a"), ("", ""), (" \n ", "\n")])
def test_left_trim(one, text, wanted):
    assert one(m.left_trim_lines, text) == wanted


def test_strip_cuts_all_whitespace(one):
    text = "\u2003\x1d a b \u00a0\x85\n"
    assert one(strip, text) == text.strip() == "a b"


def test_collapse_lines(one):
    assert one(collapse_lines, " a \t b \n \n\n  c\u00a0d ") == "a b\nc d"


def test_state_lines(one):
    text = "Texas\nTEXAS \nTexas toast\n  New Mexico\nDistrict of Columbia\nPuerto Rico\ntexas"
    assert one(m.drop_state_lines, text) == "Texas toast\nPuerto Rico\ntexas"


@pytest.mark.parametrize("text, wanted", [
    ("? BBQ", "BBQ"), ("?\n BBQ", "?\n BBQ"), ("? bbq", "? bbq"), ("a ? B", "a ? B"),
    ("??A", "??A"), ("?  A\n?B", "A\nB")])
def test_question_prefix(one, text, wanted):
    assert one(m.strip_question_prefix, text) == wanted


@pytest.mark.parametrize("line, url", [
    ("www.a.com", "www.a.com"), (" www.a.com/x/y_1.html/ ", "www.a.com/x/y_1.html"),
    ("a.com", None), ("ab.com", "ab.com"), ("see www.a.com", None), ("www.a.com//", None),
    ("www.a.coop", "www.a.coop"), ("x" * 41 + ".com", None),
    ("go to cornelldairybar.cfm now", "gotocornelldairybar.cfmnow")])
def test_urls(one, line, url):
    assert one(m.mark_urls, line) == (f"|URL start| {url} |URL end|\n" if url else line)


def found(one, text):
    return one(lambda t: m.tagged_values(m.mark_addresses(t), "address"), text)


@pytest.mark.parametrize("text, wanted", [
    ("MIKE'S KITCHEN 170 Randall St. (at the\nVFW Post 239) Cranston, RI",
     ["170 Randall St. (at the VFW Post 239) Cranston, RI"]),
    ("SUGAR'S 1799 State Rd. 68 Embudo, NM (rear  lot) more",
     ["1799 State Rd. 68 Embudo, NM (rear lot)"]),
    ("CHOPE'S N. 16145 S. Hwy. 28 La Mesa, NM", ["N. 16145 S. Hwy. 28 La Mesa, NM"]),
    ("along US 17, SC", []), ("BIG Route 66 Town, OK", ["Route 66 Town, OK"]),
    ("BIG A Exit 9 Town, OK", ["Exit 9 Town, OK"]), ("Small 12 Main, TX", []),
    ("ALL 12 Main | St, TX", []), ("ALL 12 Main St", []),
    ("|URL end|\n\n5 Elm, ME ALL 6 Oak, NH 7", ["5 Elm, ME", "6 Oak, NH"]),
    ("x 605 8th Ave. S. Nashville, Tennessee", ["605 8th Ave. S. Nashville, TN"]),
    ("at Highway 75 S. \nLe Mars, IA", ["Highway 75 S. Le Mars, IA"])])
def test_addresses(one, text, wanted):
    assert found(one, text) == wanted


def test_address_text_around_is_kept(one):
    text = "ABC 1 A St. B, TX tail"
    assert one(m.mark_addresses, text) == \
        "ABC\n|address start| 1 A St. B, TX |address end|\n tail"


def test_long_address_is_not_cut(one):
    middle = "word " * 400
    assert found(one, f"DINER 12 {middle}Town, TX") == [f"12 {middle}Town, TX"]


def test_phones_hours_cost(one):
    assert one(m.mark_phones, " 203-555-0101 or so") == "|phone start| 203-555-0101 |phone end|\n or so"
    assert one(m.mark_phones, "call 203-555-0101") == "call 203-555-0101"
    assert one(m.mark_hours, "BLD daily $$ $") == "|hours start| BLD daily $$ |hours end|\n $"
    assert one(m.mark_hours, "(summer only) L $$$$") == "|hours start| (summer only) L $$$ |hours end|\n$"
    assert one(m.mark_hours, "Big $") == "Big $"
    assert one(m.mark_cost, "|hours start| LD | $$ |hours end|") == \
        "|hours start| LD  |hours end|\n|cost start| $$ |cost end|\n"
    assert one(m.mark_cost, " $$$ \n$$$$") == "|cost start| $$$ |cost end|\n$$$$"


@pytest.mark.parametrize("line, is_title", [
    ("K. LAMAY'S", True), ("B.J.", False), ("BBQ 101", True), ("A 1", False), ("A.1 STOP", True),
    ("21", False), ("21 CLUB", True), ("JOE'S", True), ("JOEs", False), ("J漢O", False),
    ("A|B CD", False), ("ÉÀ", True), ("  TWO WORDS ", True), ("--", False)])
def test_titles(one, line, is_title):
    wanted = f"|title start| {line.strip()} |title end|" if is_title else line
    assert one(m.mark_titles, line) == wanted


def test_content_blocks_and_spacing(one):
    text = "\na\n\nb\n|x|\n \n|y| z\nc"
    assert one(m.mark_remaining_content, text) == \
        "|content start| a\n\nb |content end|\n|x|\n|y| z\n|content start| c |content end|"
    t = "|title start|"
    assert one(m.title_spacing, f"\n\n{t} A\nx\n\n\n{t} B{t} C") == f"\n{t} A\nx\n\n{t} B\n\n{t} C"
    assert one(m.title_spacing, "none") == "none"


def marked(spark, *fields):
    text = "\n".join(f"|{f} start| {v} |{f} end|" for f, v in fields)
    return spark.createDataFrame([("d", text)], "doc_id string, text string")


def test_fields_before_the_first_title(spark):
    df = marked(spark, ("content", "intro"), ("title", "A"), ("address", "1 X, TX"),
                ("phone", "1"), ("phone", "2"), ("content", "a  b\n\n c"), ("content", "d"))
    row = rec.extract_records(df).first()
    assert (row.title, row.phone, row.content, row.URL) == ("A", "2", "intro a b\nc d", None)
    errors = [(r.seq, r.title, r.error) for r in rec.validate_records(df).orderBy("seq").collect()]
    assert errors == [(1, "Unknown Title", "does not start with title"), (2, "A", "duplicate field")]


def test_records_need_title_and_address(spark):
    df = marked(spark, ("title", "A"), ("content", "x"), ("title", "B"), ("URL", "u"),
                ("phone", "p"), ("hours", "h"), ("address", "late"), ("content", "y"))
    assert [r.title for r in rec.extract_records(df).collect()] == ["B"]
    assert [r.error for r in rec.validate_records(df).orderBy("seq").collect()] == \
        ["missing address", "missing address"]


def test_no_fields_no_records(spark):
    df = spark.createDataFrame([("d", "plain")], "doc_id string, text string")
    assert rec.extract_records(df).count() == rec.validate_records(df).count() == 0


def test_marking_needs_no_shuffle(spark):
    df = spark.createDataFrame([("d", "plain")], "doc_id string, text string")
    plan = rec.extract_records(rec.mark_texts(df))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("segments", [3, 2_000, 100_000])
def test_long_paths(spark, segments):
    """A pattern that recursed once per segment would end the JVM."""
    from pyspark.sql import functions as F
    line = "www.place.com" + "/ab" * segments
    df = spark.createDataFrame([(line,), (line + "/",), (line + "//x",)], "t string")
    got = [r.u for r in df.select(m.mark_urls(F.col("t")).alias("u")).collect()]
    tag = f"|URL start| {line} |URL end|\n"
    assert got == [tag, tag, line + "//x"]
    assert df.select(m.mark_document(F.col("t")).alias("m")).count() == 3
