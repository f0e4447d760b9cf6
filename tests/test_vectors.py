"""Vector search against brute force, with copies and tiny blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from placesearch.operators import vectors as v


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    docs = rng.normal(size=(120, 6)).astype(np.float32)
    docs[::3] = docs[0]                                     # a third are copies
    queries = np.vstack([docs[:4], rng.normal(size=(16, 6)).astype(np.float32)])
    d = spark.createDataFrame([(i, x.tolist(), int(i % 4)) for i, x in enumerate(docs)],
                              "doc_id long, embedding array<float>, label int")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(queries)],
                              "query_id long, vector array<float>")
    return docs.astype(float), queries.astype(float), d, q


def brute(docs, queries, k, allowed=lambda q, i: True):
    found = set()
    for q, query in enumerate(queries):
        near = sorted((float(((x - query) ** 2).sum()), i) for i, x in enumerate(docs)
                      if allowed(q, i))[:k]
        found |= {(q, r + 1, i) for r, (_, i) in enumerate(near)}
    return found


def rows(df):
    return {(r.query_id, r.rank, r.doc_id) for r in df.collect()}


@pytest.mark.parametrize("options", [{}, {"broadcast_numbers": 0, "block_rows": 7},
                                     {"broadcast_numbers": 0}])
def test_batch(data, options):
    docs, queries, d, q = data
    assert rows(v.knn_batch(d, q, 5, **options)) == brute(docs, queries, 5)


def test_filter_equals_filtered_table(data):
    docs, queries, d, q = data
    got = rows(v.knn_batch(d, q, 3, F.col("label") == 2))
    assert got == brute(docs, queries, 3, lambda _, i: i % 4 == 2)
    assert got == rows(v.knn_batch(d.filter("label = 2"), q, 3))


def test_single_query_and_prefix(data):
    docs, queries, d, _ = data
    many = [(r.rank, r.doc_id) for r in v.knn(d, queries[7].tolist(), 6).collect()]
    assert {(0, *m) for m in many} == brute(docs, queries[7:8], 6)
    assert [(r.rank, r.doc_id) for r in v.knn(d, queries[7].tolist(), 5).collect()] == many[:5]


def test_empty_query_and_small_tables(data):
    _, _, d, q = data
    assert v.knn(d, None).count() == v.knn(d, []).count() == 0
    assert v.knn_batch(d.limit(0), q).count() == v.knn_batch(d, q.limit(0)).count() == 0
    assert v.knn_batch(d.filter("doc_id < 2"), q.filter("query_id = 1"), 5).count() == 2


def test_missing_vectors_are_near_to_nothing(data):
    docs, queries, d, q = data
    holed = d.withColumn("embedding", F.when(F.col("doc_id") % 5 != 0, F.col("embedding")))
    wanted = brute(docs, queries, 3, lambda q_, i: i % 5 != 0)
    assert rows(v.knn_batch(holed, q, 3)) == wanted == rows(v.knn_batch(
        holed, q, 3, broadcast_numbers=0, block_rows=9))
    assert all(r.doc_id % 5 for r in v.knn(holed, queries[0].tolist(), 9).collect())


@pytest.mark.parametrize("k", [0, 11])
def test_k_bounds(data, k):
    with pytest.raises(ValueError):
        v.knn(data[2], [0.0], k)


def test_keys(data, spark):
    docs, queries, d, q = data
    keyed = q.withColumn("key", F.explode(F.array((F.col("query_id") % 4).cast("int"), F.lit(1))))
    got = v.knn_keyed(d.withColumnRenamed("label", "key"), keyed.distinct(), ["key"], 4, block_rows=5)
    assert rows(got) == brute(docs, queries, 4, lambda q_, i: i % 4 in (q_ % 4, 1))


def test_plans(spark):
    path = "/root/testdata/sf0.001/embeddings.parquet"
    docs = spark.read.parquet(path).withColumnRenamed("vec_id", "doc_id")
    plan = v.knn(docs, [0.0] * 64, 4, F.col("label") == 3)._jdf.queryExecution().executedPlan()
    assert "EqualTo(label,3)]" in plan.toString()
    assert "TakeOrderedAndProject" in plan.toString() and "Python" not in plan.toString()
    q = docs.select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector"))
    batch = v.knn_batch(docs, q, 4)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in batch
    for text in (plan.toString(), batch):
        assert "Cartesian" not in text and "NestedLoop" not in text


BROKEN = [(900, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (901, [float("nan")] * 6, 0), (902, [0.0] * 5, 0), (903, None, 0),
          (904, [0.0] * 7, 0)]


@pytest.mark.parametrize("options", [{}, {"broadcast_numbers": 0, "block_rows": 7}])
def test_broken_vectors_are_near_to_nothing(spark, data, options):
    docs, queries, d, q = data
    bad = d.unionByName(spark.createDataFrame(BROKEN, "doc_id long, embedding array<float>, label int"))
    asked = q.unionByName(spark.createDataFrame([(90, [None] * 6), (91, None), (92, [])],
                                                "query_id long, vector array<float>"))
    assert rows(v.knn_batch(bad, asked, 5, **options)) == brute(docs, queries, 5)
    one = v.knn(bad, queries[7].tolist(), 5).collect()
    assert {(7, r["rank"], r.doc_id) for r in one} == {x for x in brute(docs, queries, 5) if x[0] == 7}


@pytest.mark.parametrize("options", [{}, {"broadcast_numbers": 0, "block_rows": 40}])
def test_close_vectors_far_from_the_origin(spark, options):
    rng = np.random.default_rng(8)
    docs = 1000 + rng.normal(size=(150, 64)) * 1e-3
    queries = 1000 + rng.normal(size=(20, 64)) * 1e-3
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(docs)], "doc_id long, embedding array<double>")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(queries)], "query_id long, vector array<double>")
    assert rows(v.knn_batch(d, q, 4, **options)) == brute(docs, queries, 4)


def _plain(queries, matrix, k):
    """Places of the nearest rows, one query after another."""
    found = []
    for q, vector in enumerate(queries):
        far = ((matrix - vector) ** 2).sum(axis=1)
        found += [(q, d, far[d]) for d in np.lexsort((np.arange(len(far)), far))[:k]]
    return found


@pytest.mark.parametrize("kind", ["plain", "ties", "offset", "tiny", "huge", "same", "few", "mixed"])
def test_rough_product_loses_no_row(kind):
    draw = np.random.default_rng(5)
    rows = {"plain": lambda: draw.normal(size=(9000, 8)), "ties": lambda: draw.integers(0, 2, (9000, 6)).astype(float),
            "offset": lambda: 1e6 + draw.normal(size=(9000, 8)), "tiny": lambda: 1e-30 * draw.normal(size=(9000, 8)),
            "huge": lambda: 1e30 * draw.normal(size=(9000, 8)), "same": lambda: np.ones((9000, 4)),
            "few": lambda: draw.normal(size=(3, 5)),
            "mixed": lambda: draw.normal(size=(9000, 8)) * 10.0 ** draw.integers(-20, 12, (9000, 1))}[kind]()
    found = v._nearest_in_parts(rows[:40], rows, np.arange(len(rows)), 5)
    assert list(found.itertuples(index=False, name=None)) == _plain(rows[:40], rows, 5)


def test_rows_beyond_a_known_distance_are_not_looked_at():
    draw = np.random.default_rng(6)
    rows = draw.normal(size=(500, 8))
    near = v._nearest_in_parts(rows[:30], rows, np.arange(500), 4)
    third = near["distance"].to_numpy().reshape(30, 4)[:, 2]
    some = v._nearest_in_parts(rows[:30], rows, np.arange(500), 4, third)
    assert list(some.groupby("query_id").size()) == [3] * 30
