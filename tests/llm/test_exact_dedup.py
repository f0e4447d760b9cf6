import hashlib
import random
import re
from collections import defaultdict

import pytest

from placesearch.llm import exact_dedup as E

KINDS = "doc_id long, text string, _h string, key string, row string"


def brute(rows):
    """doc_id, keep_id, group_size, kept, sha of each row; of repeated rows one stays."""
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (i, _), n in zip(rows, norm):
        groups[n].append(i)
    seen, out = set(), []
    for (i, _), n in zip(rows, norm):
        ids = [x for x in groups[n] if x is not None]
        keep = min(ids) if ids else None
        kept = i == keep and (i, n) not in seen
        seen.add((i, n))
        out.append((i, keep, len(groups[n]), kept, hashlib.sha256(n.encode()).hexdigest()))
    return out


def order(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("bits", [64, 2])
def test_against_brute_force(spark, bits):
    """Also where nearly all blocks share a hash: names still stand for contents."""
    draw = random.Random(3)
    texts = ["", None, " ", "a", "a ", "a\t\n b", "a b", "é" * 9, "😀x" * 5]
    texts += ["".join(draw.choice("ab") for _ in range(draw.randint(0, 40))) for _ in range(120)]
    rows = [(i, draw.choice(texts)) for i in range(300)] + [(5, "a b"), (5, "a b"), (None, "a b"),
                                                            (None, "only"), (None, "only")]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], KINDS)
    found = E.exact_duplicates(df, block=4, bits=bits).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert order(tuple(r) for r in found) == order(brute(rows))


def test_long_text_and_empty_table(spark):
    long = "ab c" * 200_000
    df = spark.createDataFrame([(1, long), (2, long + "d"), (3, long.replace(" ", "\n"))], "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in E.exact_duplicates(df).collect()}
    assert kept == {1: True, 2: True, 3: False}
    assert E.exact_duplicates(df.limit(0)).count() == 0
    assert E.drop_exact_duplicates(df.limit(0)).count() == 0


def test_drop_keeps_columns_and_one_row(spark):
    df = spark.createDataFrame([(1, "a", "p", "q", "r"), (1, "a", "p", "q", "r"), (2, "a ", "s", "t", "u"),
                                (3, None, None, None, None)], KINDS)
    out = E.drop_exact_duplicates(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 3]
