import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from compare import compare, duck
from placesearch.llm import quality_rules as Q

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n_words int, row string"


def test_sql(spark):
    ok, note = compare(duck(SMALL), Q.op11_quality_rules(spark, SMALL), Q.SQL["op11_quality_rules"])
    assert ok, note


def plain(text):
    """The base measures, word by word."""
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if count[w] > 1 for j in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), sum(c in Q.SYMBOLS for c in text), len(lines) - len(set(lines)),
            len(repeated), len(words) < 50 or 100 * len(repeated) > 50 * len(words))


def texts():
    draw = random.Random(4)
    word = lambda n: "".join(draw.choice("abcdé") for _ in range(draw.randint(1, n)))
    some = [" ".join(word(2) for _ in range(n)) for n in (0, 1, 2, 3, 4, 60, 400)]
    some += [" ".join([*(word(6) for _ in range(40)), "x y z w"] * 3), "a a a a", "a b a b a b", "   x",
             "# $ %\n\n#\n#\n \n| <>&*", "\n\n\n", " a\t\x0b\x0cb\r\nc\n", "\U0001f600 \U0001f600 " * 30, "THE the The " * 20,
             None, "", "the and of to in " + " ".join(word(9) for _ in range(200))]
    return some


@pytest.mark.parametrize("few", [0, Q.FEW_FOUND])
def test_measures_equal_plain_counting(spark, monkeypatch, few):
    monkeypatch.setattr(Q, "FEW_FOUND", few)
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, 7, "k") for i, t in rows] + [(None, "a b", 7, "k")] * 2, DOCS)
    got = {r.doc_id: r for r in Q.judge(docs).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                     "n_repeat_words", "base_failed", "kept").collect()}
    for i, text in rows:
        assert tuple(got[i])[1:7] == plain(text), (i, text)
        assert not (got[i].base_failed and got[i].kept)
    assert got[None].n_words == 2


def test_a_very_long_text(spark):
    """Both ways to find repeated windows agree with plain counting."""
    draw = random.Random(1)
    long = " ".join("".join(draw.choice("abcdefg") for _ in range(2)) for _ in range(60_000))
    docs = spark.createDataFrame([(1, long + "\n" + "w1 w2 w3 " * 3, 0, "")], DOCS)
    row = Q.judge(docs).first()
    assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words,
            row.base_failed) == plain(docs.first().text)


GOOD = " ".join(f"the word{i} of page{i} and thing{i}" for i in range(20))


@pytest.mark.parametrize("text, broken", [
    (GOOD, []), (GOOD.replace("word", "###"), ["symbols"]), (" ".join(f"{i} {i}1 the" for i in range(60)), ["letters"]),
    (" ".join(f"tok{i} pog{i}" for i in range(60)), ["stop_words"]),
    ("\n".join([GOOD, *["the same line of it"] * 9]), ["repeated_lines"]),
    ("\n".join(f"- the item{i} of page{i}" for i in range(40)), ["bullets"]),
    ("\n".join(f"the item{i} of page{i} ..." for i in range(40)), ["cut_lines"]),
    (" ".join(f"{'x' * 30}{i} the" for i in range(60)), ["word_length"]), ("a b", ["length", "word_length"])])
def test_each_rule(spark, text, broken):
    row = Q.judge(spark.createDataFrame([(1, text, 0, "")], DOCS)).first()
    assert [b for b in row.broken if b != "stop_words" or broken == ["stop_words"]] == broken


def test_a_table_of_rules_decides(spark):
    docs = spark.createDataFrame([(1, GOOD, 0, ""), (2, "### " * 80, 0, "")], DOCS)
    assert [r.doc_id for r in Q.keep_good(docs).collect()] == [1]
    assert Q.keep_good(docs).columns == docs.columns
    assert Q.keep_good(docs, (Q.Rule("none", "n_words", None, None),)).count() == 1         # the base still holds
    assert Q.keep_good(docs, (Q.Rule("short", "n_words", None, 10),)).count() == 0
    assert Q.judge(docs.limit(0)).count() == 0


def test_one_narrow_pass_without_python(spark):
    plan = Q.op11_quality_rules(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan and plan.count("FileScan") == 1
