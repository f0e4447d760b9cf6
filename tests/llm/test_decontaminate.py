import random

import pytest

from compare import compare, duck
from placesearch.llm import decontaminate as D

SMALL = "/root/testdata/sf0.001"


def test_sql(spark):
    ok, note = compare(duck(SMALL), D.op3_decontamination(spark, SMALL), D.SQL["op3_decontamination"])
    assert ok, note


@pytest.fixture(scope="module")
def planted(spark):
    draw = random.Random(1)
    item = [f"b{draw.randrange(500)}" for _ in range(40)]
    fill = lambda n: [f"c{draw.randrange(500)}" for _ in range(n)]
    swapped = [w if k % 9 else "zz" for k, w in enumerate(item)]
    gone = item[:20] + item[22:]
    rows = [(1, fill(300)), (2, fill(50) + item + fill(50)), (3, fill(5) + swapped + fill(9)), (4, gone),
            (5, fill(80) + item[10:32] + fill(80)), (6, item[:6] + fill(30) + item[20:26]),
            (7, [w.upper() + "," for w in item]), (8, sum(([w, "q"] for w in item), []))]
    bench = [(1, " ".join(item)), (2, " ".join(fill(30))), (3, "too short an item"), (4, None), (1, " ".join(item))]
    docs = spark.createDataFrame([(i, " ".join(w), "k", 1) for i, w in rows] + [(9, None, "k", 1), (10, "", "k", 1)] +
                                 [(None, " ".join(item), "k", 1)],
                                 "doc_id long, text string, key string, hash int")
    return docs, spark.createDataFrame(bench, "item_id long, text string")


def test_substitutions_are_tolerated_and_clean_texts_left_alone(planted):
    found = {(r.doc_id, r.item_id) for r in D.overlaps(*planted).collect()}
    assert found == {(i, 1) for i in (2, 3, 4, 5, 7, None)}


def test_drop(planted):
    out = D.drop_contaminated(*planted)
    assert out.columns == planted[0].columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 6, 8, 9, 10]


def test_items_in_blocks_give_the_same(planted, monkeypatch):
    whole = sorted(map(str, D.overlaps(*planted).collect()))
    monkeypatch.setattr(D, "BLOCK_SEEDS", 50)
    assert sorted(map(str, D.overlaps(*planted).collect())) == whole


def test_empty_tables(planted):
    docs, bench = planted
    assert D.overlaps(docs.limit(0), bench).count() == 0
    assert D.overlaps(docs, bench.limit(0)).count() == 0


def test_no_python_in_the_plan(planted):
    plan = D.overlaps(*planted)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("length", [12, 14, 16])
def test_a_short_passage_counts_wherever_it_stands(spark, length):
    draw = random.Random(7)
    item = [f"b{k}" for k in range(50)]
    fill = lambda n: [f"c{draw.randrange(500)}" for _ in range(n)]
    within = item[15:15 + length]
    changed = [w if k != length // 2 else "zz" for k, w in enumerate(item[15:15 + length])]
    rows = [(1, fill(80) + within + fill(80)), (2, within + fill(80)), (3, fill(80) + item[:length] + fill(80)),
            (4, fill(40) + item[15:23] + fill(80)), (5, fill(200)), (6, fill(30) + changed + fill(30))]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    found = {r.doc_id: r.matched for r in D.overlaps(
        docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert {1, 2, 3} <= set(found) <= {1, 2, 3, 6} and found[1] >= length


def test_items_of_equal_text_are_looked_up_as_one(planted, monkeypatch):
    docs, bench = planted
    copies = bench.filter("item_id = 1").distinct().crossJoin(bench.sparkSession.range(20).toDF("c"))
    many = copies.selectExpr("item_id + c AS item_id", "text")
    made = []
    monkeypatch.setattr(D, "_block_overlaps", lambda tokens, texts, f=D._block_overlaps: made.append(
        texts.count()) or f(tokens, texts))
    one = {tuple(r)[:2] + tuple(r)[3:] for r in D.overlaps(docs, bench.filter("item_id = 1")).collect()}
    found = D.overlaps(docs, many).collect()
    assert made == [1, 1]
    assert len(found) == 20 * len(one) and {tuple(r)[:2] + tuple(r)[3:] for r in found} == one
    assert {r.item_id for r in found} == set(range(1, 21))


def test_a_block_is_over_before_the_next(planted, monkeypatch):
    docs, bench = planted
    monkeypatch.setattr(D, "BLOCK_SEEDS", 50)
    plan = D.overlaps(docs, bench)._jdf.queryExecution().toString()
    assert "_seed" not in plan


def test_texts_under_one_id_are_each_compared_with_themselves(spark):
    draw = random.Random(3)
    item = [f"b{draw.randrange(500)}" for _ in range(40)]
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item[:30])), (None, " ".join(item))],
                                  "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(item))], "doc_id long, text string")
    found = {r.item_id: r for r in D.overlaps(docs, bench).collect()}
    alone = [D.overlaps(docs, spark.createDataFrame([(1, " ".join(t))], "item_id long, text string")).first()
             for t in (item, item[:30])]
    assert set(found) == {1} and found[1].hits == sum(r.hits for r in alone)


def test_drop_looks_equal_items_up_as_one(planted, monkeypatch):
    docs, bench = planted
    many = bench.crossJoin(bench.sparkSession.range(20).toDF("c")).selectExpr("item_id + 10 * c AS item_id", "text")
    made = []
    monkeypatch.setattr(D, "_block_overlaps", lambda tokens, texts, f=D._block_overlaps: made.append(
        texts.count()) or f(tokens, texts))
    out = D.drop_contaminated(docs, many)
    assert sorted(r.doc_id for r in out.collect()) == [1, 6, 8, 9, 10] and made == [2]
    assert "item_id" not in out._jdf.queryExecution().toString()
