import math
import random
import re
from collections import Counter

import pytest

from compare import compare, duck
from placesearch.llm import lexical_search as L

SMALL = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def test_sql(spark):
    ok, note = compare(duck(SMALL), L.op13_lexical_search(spark, SMALL), L.SQL["op13_lexical_search"])
    assert ok, note


def brute(docs, items, k):
    terms = lambda t: TERM.findall((t or "").translate(ASCII))
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    found = []
    for item, text in dict.fromkeys(items):
        scored = []
        for row, (i, bag) in enumerate(bags):
            m = 100 - 75 + (75 * sum(bag.values()) * n_docs) // length
            score = sum(weight[t] * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in terms(text) if t in bag)
            if score > 0:
                scored.append((-score, i is None, i or 0, row))
        found += [(item, rank + 1, None if none else i, -s) for rank, (s, none, i, _) in enumerate(sorted(scored)[:k])]
    return sorted(found, key=str)


def rows(found):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(2)
    words = [f"W{i}" for i in range(300)] + ["été", "ÉTÉ", "naïve", "x1"]
    pick = lambda n: " ".join(words[int(draw.paretovariate(0.7)) % len(words)] for _ in range(n))
    docs = [(i, pick(draw.randint(0, 60))) for i in range(700)]
    copied = pick(30)
    docs += [(1000 + i, copied) for i in range(200)]                            # a group of copies: ties
    docs += [(5, copied), (5, copied), (2000, None), (2001, ""), (2002, ".,;"), (None, copied), (2003, pick(20_000))]
    items = [(i, pick(draw.randint(1, 25))) for i in range(12)]
    items += [(50, copied), (50, copied), (50, "w1 W1 w2"), (51, None), (52, ""), (53, "nowhere"), (None, copied[:40])]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"BLOCK": 4, "SEEDS": 3, "RAREST": 1}, {"SHARD": 1, "VOCABULARY": 60}, {"SEEDS": 2, "BLOCK": 10_000}])
def test_equals_brute_force(spark, corpus, monkeypatch, options):
    for name, value in options.items():
        monkeypatch.setattr(L, name, value)
    docs, items = corpus
    table = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in docs], "doc_id long, text string, term string, row int, block int")
    asked = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, q int")
    assert rows(L.search(table, asked)) == brute(docs, items, 10)


def test_empty_tables_and_other_ids(spark, corpus):
    docs, items = corpus
    table = spark.createDataFrame([(f"a{i}", t) for i, t in docs[:40]], "doc_id string, text string")
    asked = spark.createDataFrame(items[:3], "item_id long, text string")
    assert L.search(table.limit(0), asked).count() == L.search(table, asked.limit(0)).count() == 0
    assert L.search(table.filter("text = ''"), asked).dtypes == L.search(table, asked).dtypes
    assert {r.doc_id[0] for r in L.search(table, asked).collect()} == {"a"}


def test_bounds_reject_most_documents(spark, monkeypatch):
    """Candidates and unpacked documents are few against all pairs of items and documents."""
    kept, real = {}, L.land
    monkeypatch.setattr(L, "land", lambda df, name: kept.setdefault(name, []).append(real(df, name)) or kept[name][-1])
    L.op13_lexical_search(spark, "/root/testdata/sf0.01").count()
    pairs = 1000 * 40
    assert kept["candidates"][0].count() < pairs / 2
    assert kept["candidates"][1].count() < pairs / 5 and kept["scored"][0].count() < pairs / 20


def test_no_python_in_the_plan(spark):
    plan = L.op13_lexical_search(spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
