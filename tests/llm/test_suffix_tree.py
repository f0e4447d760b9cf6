import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from placesearch.llm import suffix_tree as S

SMALL = "/root/testdata/sf0.001"


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w] + [None]


def base(rows, train):
    c = Counter(t for _, x in train for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return {i: (len(tokens(x)), sum(t in c for t in tokens(x)), n,
                sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(x))) for i, x in rows}


@pytest.mark.parametrize("frequent", [20, 100_000])
def test_base_scores(spark, frequent):
    """Also where most words are looked up in the table."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 10]
    want = base(rows, train)
    found = S.score_texts(docs, docs.filter(S.fold(10) != 0), frequent).collect()
    assert len(found) == len(rows)
    for r in found:
        n, known, total, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(score, rel=1e-9)
        assert r.score < 0


def plain(train, seen):
    """The whole tree in dictionaries: a function that gives the chance of a symbol after others."""
    rows = [tokens(x) for x in train]
    count = Counter(t for row in rows for t in row)
    total, distinct = sum(count.values()), len(count)
    discount = min(0.9, max(sum(n == 1 for t, n in count.items() if t is not None), 1) / distinct)
    follow = {1: defaultdict(Counter), 2: defaultdict(Counter)}
    for row in rows:
        for k, t in enumerate(row):
            follow[1][(row[k - 1] if k else None,)][t] += 1
            if k:
                follow[2][(row[k - 2] if k > 1 else None, row[k - 1])][t] += 1
    size = {(t,): n for t, n in count.items()}
    for (a,), after in follow[1].items():
        size.update({(a, b): n for b, n in after.items() if b is not None})
    kept = {}

    def chance(context, t):
        if not context:
            return max(count[t] - discount, 0.05) / total if t in count else max(discount * distinct / total, 1e-300)
        if context not in kept:
            return chance(context[1:], t)
        listed, n, pooled = kept[context]
        below = chance(context[1:], t)
        return (listed[t] + 8 * below) / (n + 8) if t in listed else pooled * below

    def smooth(context, t):
        """As in a state for the context, also where it is not kept."""
        return (follow[1][context][t] + 8 * chance((), t)) / (size[context] + 8) if context else chance((), t)

    for depth in (1, 2):
        for context, after in follow[depth].items():
            n = size[context]
            listed = {t: k for t, k in after.items() if k >= 2}
            if n < seen or not listed:
                continue
            q = {t: smooth(context[1:], t) for t in listed}
            rest = n - sum(listed.values())
            gain = sum(k * math.log(k / q[t]) for t, k in listed.items()) - n * math.log(n)
            gain += rest * math.log(rest / max(1 - sum(q.values()), 1e-9)) if rest > 0 else 0
            if gain > 0.5 * len(listed) * math.log(n):
                left = rest / max(1 - sum(chance(context[1:], t) for t in listed), 1e-9)
                kept[context] = listed, n, (left + 8) / (n + 8)

    def score(x):
        row, got = tokens(x), 0.0
        for k, t in enumerate(row):
            context = (row[k - 1] if k else None,)
            longer = (row[k - 2] if k > 1 else None, row[k - 1]) if k else None
            got += math.log10(chance(longer if longer in kept else context, t))
        return got
    return kept, score


@pytest.mark.parametrize("frequent", [20, 100_000])
def test_scores_are_those_of_a_plain_tree(spark, frequent):
    """However few weights a task knows, and with no context lost."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    kept, score = plain([r.text for r in rows], 8)
    assert {len(context) for context in kept} == {1, 2}
    found = {r.doc_id: r.score for r in S.score_texts(docs, docs, frequent, seen=8).collect()}
    for r in rows:
        assert found[r.doc_id] == pytest.approx(score(r.text), rel=1e-9)


def test_contexts_are_kept_where_they_tell_something(spark):
    """After "b", "c" always follows; after "a" anything does."""
    draw = random.Random(4)
    texts = [" ".join(sum((["a", draw.choice("klmn"), "b", "c"] if draw.random() < .5 else [draw.choice("klmn")]
                           for _ in range(60)), [])) for _ in range(40)]
    learn = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame([(1, "b c"), (2, "c k"), (3, "b"), (4, "c")], "doc_id long, text string")
    kept, score = plain(texts, 8)
    assert ("b",) in kept
    for r in S.score_texts(asked, learn, seen=8).collect():
        assert r.score == pytest.approx(score({1: "b c", 2: "c k", 3: "b", 4: "c"}[r.doc_id]), rel=1e-9)


def test_a_full_filter_of_keys_and_ids_of_text_change_no_score(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    docs = docs.unionByName(docs)
    want = sorted((r.doc_id, round(r.score, 6), r.n_known) for r in S.score_texts(docs, docs, 20).collect())
    monkeypatch.setattr(S, "_CELLS", 1 << 10)
    assert sorted((r.doc_id, round(r.score, 6), r.n_known) for r in S.score_texts(docs, docs, 20).collect()) == want


def test_held_out_texts_are_scored_better_than_by_the_unigram_model(spark):
    found = S.op4_suffix_tree(spark, "/root/testdata/sf0.01").filter("held_out").agg(
        F.sum("score"), F.sum("base_score")).first()
    assert found[0] > 0.9 * found[1]


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (1, None, 1), (2, " \n", 2), (None, "new words", 3), (4, "w " * 400_000, 4)],
                               "doc_id long, text string, row int")
    learn = spark.createDataFrame([(1, "w x"), (2, None)], "doc_id long, text string")
    got = S.score_texts(df, learn).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 1, 3, 400_001] and all(r.score < 0 for r in got)
    assert {r.train_tokens for r in got} == {4}
    assert S.score_texts(df.limit(0), learn).count() == 0
    assert all(r.score < 0 for r in S.score_texts(df, learn.limit(0)).collect())


def test_keys_are_found_by_their_upper_bits():
    draw = np.random.default_rng(4)
    for size in (0, 1, 2, 3, 1000, 4097):
        known = np.unique(draw.integers(0, 1 << 64, size, dtype=np.uint64))
        if size > 3:
            known[-1] = (1 << 64) - 1
        keys = np.concatenate([known, draw.integers(0, 1 << 64, 500, dtype=np.uint64), np.array([0, (1 << 64) - 1], np.uint64)])
        at, hit = S._find(known, S._starts(known), keys)
        assert hit.tolist() == np.isin(keys, known).tolist() and (known[at[hit]] == keys[hit]).all()
