import random
import re

import numpy as np
import pytest

from placesearch.llm import minhash as M
from placesearch.llm.components import components


def shingles(text, size):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if w else set()


def brute(rows, size):
    sets = {i: shingles(t, size) for i, t in rows}
    least = {i: i for i in sets}
    ids = list(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in ids:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return {(i, len(sets[i]), least[i], least[i] == i) for i in ids}


def varied(draw, words, changes):
    w = list(words)
    for _ in range(changes):
        w[draw.randrange(len(w))] = f"n{draw.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("size,block", [(2, 512), (5, 3)])
def test_against_brute_force(spark, size, block):
    """Groups of near copies around a text, chains, short texts, empty ones."""
    draw = random.Random(7)
    rows, i = [], 0
    for g in range(6):
        words = [f"w{g}x{draw.randrange(60)}" for _ in range(draw.choice([30, 80, 200]))]
        for n in range(25):
            rows.append((i, varied(draw, words, draw.randrange(0, max(2, len(words) // 12)))))
            i += 1
    for t in ("", None, " \t", "One", "one", "ONE two", "one two", "Ä x", "ä x", "a b c d e", "A b c d e f"):
        rows.append((i, t))
        i += 1
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, node long, key string")
    found = M.near_duplicates(df, size, block=block)
    assert {tuple(r) for r in found.collect()} == brute(rows, size)


def test_open_buckets_are_compared_in_blocks(spark):
    """The block comparison alone finds every link between different components."""
    draw = np.random.default_rng(1)
    rows, sets = [], []
    for n in range(14):
        base = np.random.default_rng(n // 2).integers(0, 2**60, 300)
        items = np.unique(np.append(base, draw.integers(0, 2**60, 20))).astype(np.int64)
        bits = M._packed(M._minima(M.words.mix(items.view(np.uint64)), 200))
        rows.append((n % 3, n, n, [int(x) for x in bits]))
        sets.append((n, len(items), [int(x) for x in items]))
    df = spark.createDataFrame(rows + [(n % 2 + 5, n, n, rows[n][3]) for n in range(14)],
                               "key long, node long, label long, bits array<long>")
    items = spark.createDataFrame(sets, "node long, n long, items array<long>")
    found = M._links_in_blocks(df, items, 0.64, 200, 80, 3)
    assert sorted(tuple(sorted(r)) for r in found.collect()) == [(n, n + 1) for n in range(0, 14, 2)]


def test_defined_results(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "x y z"), (2, "a b c"), (3, "x y z"), (None, "a b c"), (4, "q")],
                               "doc_id long, text string")
    found = sorted(((r.doc_id, r.component_id, r.kept) for r in M.near_duplicates(df, 2).collect()), key=str)
    assert found == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, None, True),
                            (4, 4, True)], key=str)
    assert M.near_duplicates(df.limit(0)).count() == 0
    out = M.drop_near_duplicates(df.withColumnRenamed("doc_id", "doc_id"), 2)
    assert out.columns == df.columns and out.count() == 4


def test_estimate(spark):
    from pyspark.sql import functions as F
    draw = np.random.default_rng(5)
    pool = draw.integers(0, 2**63, 1300).astype(np.uint64)
    a, b = pool[:1150], pool[150:]
    packed = [[int(x) for x in M._packed(M._minima(x, 200))] for x in (a, b)]
    row = spark.createDataFrame([tuple(packed)], "a array<long>, b array<long>").select(
        M.estimate(F.col("a"), F.col("b"), 200).alias("e"), M.estimate(F.col("a"), F.col("a"), 200).alias("s")).first()
    assert abs(row.e - 1000 / 1300) < 0.1 and row.s == 1.0


def test_components_of_a_chain_and_a_star(spark):
    links = [(n, n + 1) for n in range(10, 40)] + [(100, n) for n in range(101, 180)] + [(5, 5)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{n: 10 for n in range(10, 41)}, **{n: 100 for n in range(100, 180)}}


def test_few_links_meet_without_an_exchange(spark, monkeypatch):
    from pyspark.sql import functions as F

    from placesearch.llm import components as C
    links = [(n, n + 1) for n in range(10, 30)] + [(100, n) for n in range(101, 140)]
    frame = spark.createDataFrame(links, "u long, v long").select(F.col("v").alias("u"), F.col("u").alias("v"))
    plan = C._small_star(C._large_star(frame.coalesce(1), True), True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    # more links are dealt out
    monkeypatch.setattr(C, "_FEW", 0)
    found = {r.node: r.component for r in C.components(frame.toDF("a", "b")).collect()}
    assert found == {**{n: 10 for n in range(10, 31)}, **{n: 100 for n in range(100, 140)}}
