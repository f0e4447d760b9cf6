import numpy as np
from pyspark.sql import functions as F

from placesearch.llm import quality as Q

SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    found = Q.op5_quality(spark, SMALL)
    told = found.filter("held_out").join(labels, "doc_id").toPandas()
    assert (told["predicted"] == told["quality"]).mean() > 0.95
    good, bad = told[told["quality"] == 1]["score"], told[told["quality"] == 0]["score"]
    assert np.mean([(good > b).mean() for b in bad]) > 0.98
    assert found.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_odd_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = Q.train(docs, labels.unionByName(spark.createDataFrame(
        [(None, 1, 0), (3, None, 0), (10**9, 1, 0)], labels.schema)))
    odd = spark.createDataFrame([(1, None, 1.0), (1, None, 1.0), (2, "", 2.0), (None, "a", 1.0),
                                 (4, "long text " * 300_000, 0.0)], "doc_id long, text string, score double")
    got = Q.score(odd, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert Q.score(odd.limit(0), model).count() == 0
    assert Q.score(odd, Q.train(docs, labels.limit(0))).first().score == 0.5


def test_prior_and_risk_find_the_mixture():
    draw = np.random.default_rng(2)
    good, bad = draw.normal(2, 1, (4000, 2)), draw.normal(-2, 1, (3000, 2))
    mixed = np.concatenate([draw.normal(2, 1, (7000, 2)), bad])
    w, b = Q.fit(good[:2000], mixed[::2], 0.5)
    prior = Q.class_prior(good[2000:] @ w + b, mixed[1::2] @ w + b)
    assert abs(prior - 0.7) < 0.06
    w, b = Q.fit(good, mixed, prior)
    assert ((good @ w + b) > 0).mean() > 0.97 and ((bad @ w + b) < 0).mean() > 0.97
