import corpus_pipeline as P
from placesearch.llm.landing import land, table
from test_exact_dedup import brute as copies
from test_minhash import brute as near

SMALL = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = table(spark, SMALL, "documents")
    columns, kept = docs.columns, [docs.collect()]
    for name, stage in P.STAGES:
        docs = land(stage(spark, docs, SMALL), f"test-{name}")
        kept.append(docs.collect())
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    ids = [{r.doc_id for r in rows} for rows in kept]
    assert ids[1] == {r.doc_id for r in kept[0] if any(c.isalpha() for c in r.text or "")}
    assert ids[2] == {i for i, _, _, stays, _ in copies([(r.doc_id, r.text) for r in kept[1]]) if stays}
    assert ids[3] == {i for i, _, _, stays in near([(r.doc_id, r.text) for r in kept[2]], 5) if stays}
    items = [" ".join(r.text.split()).lower() for r in table(spark, SMALL, "benchmark").collect()]
    leaked = {r.doc_id for r in kept[3] if any(i in " ".join(r.text.split()).lower() for i in items)}
    assert leaked and not leaked & ids[4] and ids[4] <= ids[3] and len(ids[3] - ids[4] - leaked) <= 2
    assert ids[5] == ids[4]
    run = P.run(spark, SMALL).collect()
    assert sorted(map(str, run)) == sorted(map(str, kept[5]))


def test_entry_works_without_the_corpus_modules(monkeypatch):
    import sys

    import __spark_entry__ as entry
    whole = set(entry.queries())
    assert {"pipeline", *(f"op{n}_" for n in range(1, 11))} <= {k if k == "pipeline" else k.split("_")[0] + "_" for k in whole}

    real = entry.importlib.import_module

    def missing(name):
        if name in entry.OPTIONAL:
            raise ModuleNotFoundError(name=name)
        return real(name)
    monkeypatch.setattr(entry.importlib, "import_module", missing)
    assert set(entry.queries()) < whole and set(entry.oracle_sql()) <= set(entry.queries())
