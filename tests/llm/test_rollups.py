import random
from collections import Counter

import pytest

from placesearch.llm import rollups as R

SMALL = "/root/testdata/sf0.001"
KINDS = "source string, lang string, tokens long, before long, row int"


def plain(df):
    return {tuple(r)[:3]: tuple(r)[3:] for r in df.select("source", "lang", "version", "documents", "tokens").collect()}


def test_against_a_recount(spark, tmp_path):
    draw = random.Random(2)
    live, store = {}, f"file://{tmp_path}/s"
    for batch in range(4):
        new = [(f"s{draw.randrange(3)}", draw.choice(["en", "fr", None]), draw.randrange(50)) for _ in range(60)]
        put = {(batch, i): row for i, row in enumerate(new)}
        gone = draw.sample(sorted(live), len(live) // 3)
        rest = [k for k in live if k not in gone]
        again = {k: draw.randrange(50) for k in draw.sample(rest, len(rest) // 2)}
        frame = lambda rows: spark.createDataFrame(rows, KINDS)
        changes = (R.inserts(frame([(*r, None, 1) for r in put.values()]), "v")
                   .unionByName(R.deletes(frame([(*live[k], None, 1) for k in gone]), "v"))
                   .unionByName(R.revisions(frame([(*live[k][:2], n, live[k][2], 1) for k, n in again.items()]), "v")))
        for _ in range(1 + batch % 2):         # some batches are committed twice
            R.commit(changes, store, f"b{batch}")
        live = {k: v for k, v in live.items() if k not in gone}
        live |= {k: (*live[k][:2], n) for k, n in again.items()} | put
        docs, tokens = Counter(), Counter()
        for s, l, n in live.values():
            docs[s, l, "v"] += 1
            tokens[s, l, "v"] += n
        assert plain(R.totals(spark, store)) == {k: (docs[k], tokens[k]) for k in docs}
    R.fold_batches(spark, store, f"file://{tmp_path}/folded", ["b0", "b1"], "through-b1")
    R.fold_batches(spark, store, f"file://{tmp_path}/folded", ["b2", "b3"], "through-b3")
    assert plain(R.totals(spark, f"file://{tmp_path}/folded")) == plain(R.totals(spark, store))


def test_unfinished_batches_do_not_count(spark, tmp_path):
    store = f"file://{tmp_path}/s"
    assert R.totals(spark, store).count() == 0
    R.commit(R.inserts(spark.createDataFrame([("a", "b", 3, None, 0), ("a", "b", None, None, 0)], KINDS), "v"), store, "x")
    R.commit(R.inserts(spark.createDataFrame([("a", "b", 9, None, 0)], KINDS), "v"), store, "y")
    (tmp_path / "s" / "batch=y" / "_SUCCESS").unlink()
    assert plain(R.totals(spark, store)) == {("a", "b", "v"): (2, 3)}
    with pytest.raises(ValueError):
        R.commit(R.inserts(spark.createDataFrame([], KINDS), "v"), store, "../z")


def test_query_is_the_count_of_what_is_left(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    low = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect() if r.quality == 0}
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(R.tokenizer_path())
    want = Counter()
    for r in docs:
        if r.doc_id not in low:
            lines = list(dict.fromkeys((r.text or "").split("\n")))
            for version, n in ((R.BLANK_WORDS, len("\n".join(lines).encode().split())),
                               (R.SUBWORDS, len(tok.encode(r.text or "", add_special_tokens=False).ids))):
                want[r.source, r.lang, version, "d"] += 1
                want[r.source, r.lang, version, "t"] += n
    found = plain(R.op8_token_rollups(spark, SMALL))
    assert {(*k, x): n for k, v in found.items() for x, n in zip("dt", v)} == {k: n for k, n in want.items()}


def test_word_counts(spark):
    df = spark.createDataFrame([(None,), ("",), (" \t",), ("a",), (" a b\n",), ("a\x0bb\xa0c",)], "text string")
    assert [r.tokens for r in R.count_blank_words(df).collect()] == [0, 0, 0, 1, 2, 2]
