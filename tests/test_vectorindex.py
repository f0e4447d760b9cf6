"""The stored inverted-file index: recall, what is read, stored once, odd vectors."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from placesearch.operators import vectorindex as ix, vectors as v


def frame(spark, rng, count, dims=8, centres=12):
    middle = rng.normal(size=(centres, dims)) * 6
    rows = middle[rng.integers(0, centres, count)] + rng.normal(size=(count, dims))
    return spark.createDataFrame([(i, x.tolist(), int(i % 3)) for i, x in enumerate(rows.astype(np.float32))],
                                 "doc_id long, embedding array<float>, label int")


def asked(docs, every):
    return docs.filter(F.col("doc_id") % every == 0).select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector"))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    docs = frame(spark, np.random.default_rng(3), 3000).cache()
    folder = str(tmp_path_factory.mktemp("index") / "a")
    ix.build(docs, folder)
    return docs, folder


def test_recall_and_every_row_in_a_cell(spark, stored):
    docs, folder = stored
    index = ix.load(spark, folder)
    assert sorted(r.doc_id for r in index.rows.select("doc_id").collect()) == list(range(3000))
    queries = asked(docs, 50)
    exact = v.knn_batch(docs, queries, 4)
    assert v.recall(exact, ix.search(index, queries, 4)).first().recall >= v.RECALL_FLOOR


def test_all_cells_are_the_exact_search(spark, stored):
    docs, folder = stored
    queries, cells = asked(docs, 300), ix.load(spark, folder).centres.count()
    rows = lambda df: sorted((r.query_id, r["rank"], r.doc_id) for r in df.collect())
    found = ix.search(ix.load(spark, folder), queries, 5, F.col("label") == 1, probes=cells)
    assert rows(found) == rows(v.knn_batch(docs, queries, 5, F.col("label") == 1))


def test_the_second_call_reads_the_stored_index(spark, stored):
    docs, folder = stored
    other = docs.limit(0)
    assert ix.knn_approx(other, asked(docs, 1000), folder, 2).count() == 6


def test_only_probed_cells_are_scanned_and_their_share_falls(spark, tmp_path):
    share = {}
    for count in (400, 6400):
        docs = frame(spark, np.random.default_rng(4), count, centres=int(np.sqrt(count)))
        ix.build(docs, f"{tmp_path}/{count}")
        index = ix.load(spark, f"{tmp_path}/{count}")
        centres = index.centres.orderBy("cell").collect()
        probing = ix._probing(asked(docs, count).withColumn("vector", F.col("vector").cast("array<double>")),
                              np.array([c.centre for c in centres]), np.array([c.cell for c in centres], np.int32), 2)
        read = ix.cells_read(index, probing, 8)
        share[count] = read.count() / count
        assert "PartitionFilters: [" in read._jdf.queryExecution().executedPlan().toString()
        assert "cell" in read._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert share[6400] < share[400] / 2


def test_an_unfinished_index_is_none(spark, stored, tmp_path):
    docs, folder = stored
    ix.build(docs.filter("doc_id < 100"), f"{tmp_path}/b")
    ix.load(spark, f"{tmp_path}/b").rows.write.parquet(f"{tmp_path}/c/rows/version=x/dims=8")     # no centres yet
    assert ix.load(spark, f"{tmp_path}/c") is None and ix.load(spark, f"{tmp_path}/none") is None


def test_odd_vectors_and_empty_tables(spark, stored, tmp_path):
    docs, _ = stored
    odd = [(9001, None, 0), (9002, [], 0), (9003, [1.0, None] + [0.0] * 6, 0), (9004, [float("nan")] * 8, 0), (9005, [1.0, 2.0], 0)]
    mixed = docs.filter("doc_id < 200").unionByName(spark.createDataFrame(odd, docs.schema))
    copies = docs.filter("doc_id = 7").withColumn("doc_id", F.explode(F.sequence(F.lit(5000), F.lit(5400))))
    ix.build(mixed.unionByName(copies), f"{tmp_path}/odd")
    index = ix.load(spark, f"{tmp_path}/odd")
    ids = {r.doc_id for r in index.rows.select("doc_id").collect()}
    assert ids == set(range(200)) | set(range(5000, 5401)) | {9005}
    queries = asked(docs, 3000).unionByName(spark.createDataFrame([(-1, None), (-2, [1.0, 2.0]), (-3, [0.0] * 3)],
                                                                  "query_id long, vector array<float>"))
    found = [(r.query_id, r.doc_id) for r in ix.search(index, queries, 1).collect()]
    assert sorted(found) == [(-2, 9005), (0, 0)]
    ix.build(docs.limit(0), f"{tmp_path}/none")
    assert ix.search(ix.load(spark, f"{tmp_path}/none"), queries).count() == 0


def test_a_query_goes_once_to_many_cells(spark, stored):
    docs, folder = stored
    index, queries = ix.load(spark, folder), asked(docs, 300)
    centres = index.centres.orderBy("cell").collect()
    probed = ix._probed(queries, np.array([c.centre for c in centres]), np.array([c.cell for c in centres], np.int32), len(centres))
    rows = lambda df: sorted((r.query_id, r["rank"], r.doc_id) for r in df.collect())
    cells = index.rows.select("doc_id", "embedding", "cell")
    for doc_rows in (100, 10_000):
        assert rows(ix._search_parts(cells, probed, len(centres), 5, 4, doc_rows)) == rows(v.knn_batch(docs, queries, 5))
    plan = ix._search_parts(cells, probed, len(centres), 5, 8192, 10_000)
    lefts = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" in lefts and probed.schema["vector"].dataType.elementType.simpleString() == "float"


def test_nearest_in_cells_are_those_of_a_plain_search():
    draw = np.random.default_rng(8)
    rows = draw.integers(0, 3, (900, 4)).astype(np.float32)
    docs = pd.DataFrame({"doc_id": draw.permutation(900), "embedding": list(rows), "cell": draw.integers(0, 30, 900)})
    asked = pd.DataFrame({"query_id": draw.permutation(200), "vector": list(rows[:200]),
                          "cells": [draw.choice(30, 6, replace=False) for _ in range(200)]})
    found = ix._nearest_in_cells(asked, docs, 4)
    ids, cells = docs["doc_id"].to_numpy(), docs["cell"].to_numpy()
    for query_id, vector, own in asked.itertuples(index=False, name=None):
        seen = np.flatnonzero(np.isin(cells, own))
        far = ((rows[seen].astype(float) - vector) ** 2).sum(axis=1)
        want = sorted(zip(far, ids[seen]))[:4]
        got = found[found["query_id"] == query_id]
        assert sorted(zip(got["distance"], got["doc_id"])) == want
    looked_at = []
    told = v._nearest_in_parts
    try:
        v._nearest_in_parts = lambda *a: looked_at.append(a[4]) or told(*a)
        ix._nearest_in_cells(asked, docs, 4)
    finally:
        v._nearest_in_parts = told
    assert np.isinf(looked_at[0]).all() and np.isfinite(looked_at[-1]).all()
