"""Places in query text."""

import json
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from placesearch.functions import geo
from placesearch.functions.lexicon import BROAD_REGIONS, REGION_ALIASES, STATE_NAMES, state_aliases
from placesearch.operators import geofilter as gf


@pytest.mark.parametrize("text, codes", [
    ("west virginia bbq", ["VA", "WV"]), ("la tacos", ["LA"]), ("in Hawaii", ["HI"]),
    ("Where is some great BBQ in Texas?", ["TX"]), ("TX BBQ FTW", ["TX"]), ("or in me hi", []),
    ("New York State or Kansas", ["KS", "NY"]), ("arkansas", ["AR"]), ("dc", []),
    ("LONE STAR state", ["TX"]), ("mass. of Masses", ["MA"]), ("ok,co;ma", ["CO", "MA", "OK"]),
    ("allay", []), ("Washington DC", ["WA"])])
def test_states(one, text, codes):
    assert one(geo.state_codes, text) == codes


@pytest.mark.parametrize("text, regions, broad", [
    ("southeast", [], ["AL", "FL", "GA", "KY", "LA", "MS", "SC", "TN"]),
    ("New England and the south", ["New England"], []), ("Northeast", ["New England"], []),
    ("Mid-West and mid atlantic", ["Mid-Atlantic", "Midwest"], []),
    ("Pacific Northwest", [], ["ID", "OR", "WA"]), ("the southwestern", [], []),
    ("Highlighted eateries on the West Coast", ["West Coast"], []),
    ("Unique seafood restaurants on the East Coast", [], sorted(BROAD_REGIONS["east coast"]))])
def test_regions(one, text, regions, broad):
    assert one(geo.region_names, text) == regions
    assert one(geo.broad_states, text) == broad


def test_phrases_that_start_alike_mean_the_same():
    for lexicon in (state_aliases(), REGION_ALIASES):
        for a in lexicon:
            for b in lexicon:
                if b.startswith(a + " ") or b.startswith(a + "-"):
                    assert lexicon[a] == lexicon[b]
    assert len(STATE_NAMES) == 53 and "dc" not in state_aliases()


def test_city_condition(one):
    kind = "array<struct<city:string,state:string>>"
    assert one(geo.city_condition, [], kind) is None and one(geo.city_condition, None, kind) is None
    same = [("Austin", "TX"), ("austin", "tx")]
    assert json.loads(one(geo.city_condition, same, kind)) == \
        {"$and": [{"City": "Austin"}, {"State": "TX"}]}
    assert json.loads(one(geo.city_condition, [("Austin", "TX"), ("Chicago", None)], kind)) == \
        {"$or": [{"$and": [{"City": "Austin"}, {"State": "TX"}]}, {"City": "Chicago"}]}
    assert json.loads(one(geo.city_condition, [('O"Fallon', "")], kind)) == {"City": 'O"Fallon'}


def test_dedupe_and_combine(one):
    kind = "array<string>"
    twice = ['{"b":1,"a":{"d":1,"c":[2,1]}}', '{"a":{"c":[2,1],"d":1},"b":1}', '{"a":1}']
    got = one(geo.dedupe_conditions, twice, kind)
    assert got == ['{"a":{"c":[2,1],"d":1},"b":1}', '{"a":1}']
    assert one(geo.combine_conditions, [], kind) is None
    assert one(geo.combine_conditions, got[1:], kind) == '{"a":1}'
    assert json.loads(one(geo.combine_conditions, got, kind))["$or"][1] == {"a": 1}


@pytest.mark.parametrize("answer, inside", [
    ("IN_SCOPE", True), (" in_scope.", True), ("OUT_OF_SCOPE", False), (None, True), ("", False)])
def test_scope(one, answer, inside):
    assert one(geo.in_scope, answer) is inside


def test_where_predicate(spark):
    df = spark.createDataFrame([("TX", "A"), ("LA", "B"), ("MD", "A"), (None, "A")],
                               "State string, City string")

    def kept(tree):
        return sorted(f"{r.State}{r.City}" for r in df.filter(geo.where_predicate(tree)).collect())

    assert geo.where_predicate({}) is None and geo.where_predicate(None) is None
    assert kept({"State": {"$in": ["TX", "LA"]}}) == ["LAB", "TXA"]
    assert kept({"$and": [{"City": "A"}, {"State": "MD"}]}) == ["MDA"]
    assert kept({"$or": [{"City": "B"}, {"State": "MD"}]}) == ["LAB", "MDA"]
    with pytest.raises(ValueError):
        geo.where_predicate({"State": {"$ne": "TX"}})


@pytest.mark.parametrize("most", [100_000, 0])
def test_city_lookup(spark, monkeypatch, most):
    monkeypatch.setattr(gf, "MOST_CITIES", most)
    cities = spark.createDataFrame([("St. Louis", "MO"), ("Springfield", "IL"), ("Springfield", "MA"),
                                    ("New York", "NY"), ("York", "PA"), (None, "TX")],
                                   "City string, State string")
    asked = spark.createDataFrame([(1, "pie in st louis?"), (2, "Springfield"), (3, "springfield, IL"),
                                   (4, "new york city"), (5, "nothing"), (6, "")],
                                  "query_id long, text string")
    got = {(r.query_id, r.City, r.State) for r in gf.city_lookup(asked, cities).collect()}
    assert got == {(1, "St. Louis", "MO"), (2, "Springfield", "IL"), (2, "Springfield", "MA"),
                   (3, "Springfield", "IL"), (4, "New York", "NY"), (4, "York", "PA")}


def test_cities_are_found_by_walks_over_words():
    trie = gf.city_trie([(["new", "york"], "New York", ["NY"]), (["york"], "York", ["PA"]), (["new"], "New", ["TX"])])
    assert gf.cities_in("old new york new".split(), trie) == [("New", ["TX"]), ("New York", ["NY"]), ("York", ["PA"])]
    assert gf.cities_in(["newyork"], trie) == gf.cities_in([], trie) == []


@pytest.mark.parametrize("numbers", [2_000_000, 0])
def test_filtered_search_equals_filtering_by_hand(spark, numbers):
    rows = [(i, [float(i), 0.0], f"Town{i % 3}", ["TX", "LA", None][i % 3],
             ["Midwest", "Deep South"][i % 2]) for i in range(30)]
    docs = spark.createDataFrame(
        rows, "doc_id long, embedding array<float>, City string, State string, Region string")
    asked = spark.createDataFrame(
        [(1, "pie in texas", [3.2, 0.0]), (2, "anything", [9.1, 0.0]),
         (3, "deep south or Texas", [20.0, 0.0]), (4, "ohio", [1.0, 0.0])],
        "query_id long, text string, vector array<float>")
    got = {}
    for r in gf.filtered_search(asked, docs, 4, block_rows=4, broadcast_numbers=numbers).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)

    def nearest(x, keep):
        return [r[0] for r in sorted((r for r in rows if keep(r)),
                                     key=lambda r: ((r[1][0] - x) ** 2, r[0]))][:4]

    assert got[1] == nearest(3.2, lambda r: r[3] == "TX")
    assert got[2] == nearest(9.1, lambda r: True)
    assert got[3] == nearest(20.0, lambda r: r[3] == "TX" or r[4] == "Deep South")
    assert 4 not in got


def test_documents_are_not_copied_per_clause(spark):
    docs = spark.createDataFrame([(i, [float(i)], f"T{i % 3}", ["TX", None][i % 2], "Midwest") for i in range(20)],
                                 "doc_id long, embedding array<float>, City string, State string, Region string")
    asked = spark.createDataFrame([(1, "midwest or texas, t0", [1.0]), (2, "x", [2.0])], "query_id long, text string, vector array<float>")
    assert gf.clustered(docs).count() == 20
    assert "Generate" not in gf.clustered(docs)._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.query_id, r.cluster) for r in gf.clusters_asked(gf._asked(asked, docs), docs).collect())
    assert got == [(1, ""), (1, "TX")]
    odd = docs.withColumn("embedding", F.when(F.col("doc_id") != 1, F.col("embedding")))
    for numbers in (2_000_000, 0):
        found = gf.filtered_search(asked.unionByName(spark.createDataFrame([(3, "x", None), (4, None, [5.0])], asked.schema)), odd, 3, broadcast_numbers=numbers)
        assert sorted((r.query_id, r["rank"], r.doc_id) for r in found.collect()) == [
            (1, 1, 0), (1, 2, 2), (1, 3, 3), (2, 1, 2), (2, 2, 3), (2, 3, 0), (4, 1, 5), (4, 2, 4), (4, 3, 6)]


def test_queries_meet_places_and_not_filters(spark, monkeypatch):
    """Beside 32,000 documents nothing is moved, and a place is compared once for all queries that name it."""
    calls, plain = [], gf._nearest_in_parts
    monkeypatch.setattr(gf, "_nearest_in_parts", lambda q, m, rows, k: calls.append(len(q)) or plain(q, m, rows, k))
    docs = pd.DataFrame({"doc_id": range(40), "embedding": [np.float32([i, 0]) for i in range(40)],
                         "City": [f"T{i % 3}" for i in range(40)], "State": [["TX", "LA"][i % 2] for i in range(40)],
                         "Region": ["Midwest"] * 40})
    asked = pd.DataFrame({"query_id": range(30), "vector": [[float(i), 0.0] for i in range(30)]})
    filters = [((["TX"], ["LA", "TX"], ["TX", "OH"])[i % 3], ["Midwest"][:i % 2], [f"T{i % 5}|TX"]) for i in range(30)]
    found = pd.concat(gf._nearest_allowed(asked, filters, gf._by_size(docs), 3))
    assert len(calls) == 6 and sum(calls) > 30
    for i, (states, regions, cities) in enumerate(filters):
        keep = [d for d in range(40) if docs.State[d] in states or docs.Region[d] in regions or f"{docs.City[d]}|{docs.State[d]}" in cities]
        assert found[found.query_id == i].doc_id.tolist() == sorted(keep, key=lambda d: ((d - i) ** 2, d))[:3]
    big = spark.range(32_000).select(F.col("id").alias("doc_id"), F.array_repeat(F.col("id").cast("float"), 64).alias("embedding"),
                                     F.lit("T").alias("City"), F.lit("TX").alias("State"), F.lit("Midwest").alias("Region"))
    one = spark.createDataFrame([(1, "texas", [5.0] * 64)], "query_id long, text string, vector array<float>")
    assert "Exchange" not in gf.filtered_search(one, big, 2)._jdf.queryExecution().executedPlan().toString()


def test_common_beginnings_of_phrases_are_tried_once():
    assert geo._either(["new york", "new jersey", "new", "ohio"]) == "(?:new(?: (?:jersey|york))?|ohio)"
    for lexicon in map(list, (state_aliases(), REGION_ALIASES, BROAD_REGIONS)):
        plain = "|".join(re.escape(p) for p in sorted(lexicon, key=len, reverse=True))
        for phrase in lexicon:
            text = f"x {phrase}, {phrase}s or a{phrase} {lexicon[0]}-{phrase} {phrase} {lexicon[-1]}"
            assert re.findall(rf"(?=\b({geo._either(lexicon)})\b)", text) == re.findall(rf"(?=\b({plain})\b)", text)


def test_tasks_of_texts_grow_with_the_texts(spark, monkeypatch):
    cities = spark.createDataFrame([("T1", "TX")], "City string, State string")
    asked = spark.range(200).coalesce(1).select(F.col("id").alias("query_id"), F.lit("texas t1").alias("text"))
    monkeypatch.setattr(gf, "TASK_TEXTS", 5)
    found = gf.query_filters(asked, cities)
    assert found.rdd.getNumPartitions() == 40 and found.count() == 200
