from pyspark.sql import functions as F

from placesearch.llm import language_id as L

SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = L.op1_language_id(spark, SMALL)
    told = found.filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").filter("lang IS NOT NULL")
    right = told.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    assert found.filter("score < 0 OR score > 1").count() == 0
    assert found.filter("rejected").count() == 0


def test_unknown_texts_and_extra_columns(spark):
    kinds = "doc_id long, text string, lang string, row string, score string"
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = L.train(L.learnable(docs))
    odd = spark.createDataFrame([(1, None, None, "r", "s"), (2, "", "en", "r", "s"), (3, "12 !! 34", "en", "r", "s"),
                                 (4, "漢字仮名交じり文の長い文章です" * 40, None, "r", "s"),
                                 (None, "the of and that this with " * 30, None, "r", "s"),
                                 (6, "the of and that this with " * 60_000, None, "r", "s")], kinds)
    got = {(r.doc_id): (r.lang_pred, r.rejected) for r in L.predict(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", True)
    assert got[4][1]
    assert got[None] == got[6] == ("en", False)
    kept = L.keep_identified(odd, docs)
    assert kept.columns == odd.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == ["6", "None"]


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert L.predict(df, L.train(L.learnable(df))).first().lang_pred == "und"
    assert L.predict(df.limit(0), L.train(L.learnable(df.limit(0)))).count() == 0


def test_a_language_keeps_several_centroids(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = L.train(L.learnable(docs))
    assert sorted(set(model.owner)) == list(range(len(model.languages)))
    assert len(model.owner) == L.CENTROIDS * len(model.languages)


def test_copies_do_not_crowd_out_a_language(spark):
    other = [(f"zwei drei {k} vier und {k * 7} nicht das haus", "de") for k in range(60)]
    rows = [("ein text der immer wieder kommt", "de")] * 6000 + other + [("the house is not that one", "en")] * 30
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string")
    chosen = L._sample(df.select("text", "lang"), 20)
    assert {r.lang: (r.n, r.kinds) for r in chosen.groupBy("lang").agg(
        F.count("*").alias("n"), F.countDistinct("text").alias("kinds")).collect()} == {"de": (20, 20), "en": (1, 1)}
    model = L.train(df, sample=20)
    assert model.languages == ["de", "en"]
    told = L.predict(df, model).join(df, "doc_id").groupBy("lang").agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.sum(F.col("rejected").cast("int"))).collect()
    assert sorted(tuple(r) for r in told) == [("de", 1.0, 0), ("en", 1.0, 0)]


def test_a_language_of_mostly_copies_is_learned(spark):
    """Drawn by row, none of these 31 different texts would be taken."""
    rows = [("ein text", "de")] * 30_000 + [(f"haus nummer {k}", "de") for k in range(30)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string")
    assert L.train(df, sample=10).languages == ["de"]
