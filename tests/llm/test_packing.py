import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from placesearch.llm import packing as P

SMALL = "/root/testdata/sf0.001"


def check(rows, texts, window):
    """Every id in one piece, right checksums, gapless windows."""
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(P.tokenizer_path())
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts}
    docs, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    assert set(docs) == set(ids)
    for i, pieces in docs.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            part = np.array(ids[i][at:at + r.length], dtype="<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids[i]), zlib.crc32(part)) and r.length > 0
            at += r.length
        assert at == len(ids[i])
    for pieces in windows.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return sum(map(len, ids.values())), len(windows)


def test_all_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    tokens, windows = check(P.op6_packing(spark, SMALL).collect(),
                            [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert 1 - tokens / (2048 * windows) < 0.03


def test_odd_texts(spark):
    texts = [(1, None), (2, ""), (3, " \n"), (4, "x" * 5000), (5, "word " * 9000), (6, "don't <|endoftext|>b İΣς é 漢字😀"),
             (None, "no id")]
    df = spark.createDataFrame([(*t, "a", 7) for t in texts], "doc_id long, text string, start string, length int")
    rows = P.pack(df, P.tokenizer_path(), window=64, piece=16, group=3, ids=True).collect()
    check(rows, texts, 64)
    assert all(len(r.ids) == r.length and r.ids[-1:] != [] for r in rows)
    assert P.pack(df.limit(0), P.tokenizer_path()).count() == 0
    twice = P.pack(df.filter("doc_id = 1").union(df.filter("doc_id = 1")), P.tokenizer_path()).collect()
    assert len(twice) == 2


@pytest.mark.parametrize("seed", range(5))
def test_difference_evens_out(seed):
    draw = random.Random(seed)
    sizes = [draw.randint(1, 512) for _ in range(400)]
    place = P.difference(sizes, 60)
    loads = np.bincount(place, weights=sizes, minlength=60)
    assert loads.sum() == sum(sizes) and loads.max() - loads.min() <= 0.02 * loads.mean()


def test_difference_of_two_parts_is_karmarkar_karp():
    # 8 7 6 5 4 -> 1 6 5 4 -> 1 1 4 -> 3 1 -> 2
    place = P.difference([8, 7, 6, 5, 4], 2)
    loads = np.bincount(place, weights=[8, 7, 6, 5, 4])
    assert sorted(loads) == [14, 16]


def test_windows_rise_when_capacity_is_exceeded():
    place = P.divide([7, 7, 7], 10)       # 21 tokens would fill 2.1 windows, but no two fit together
    assert len(set(place)) == 3 and P.divide([3], 10).tolist() == [0]


def test_ids_of_odd_chunks_and_what_is_forgotten(monkeypatch):
    from placesearch.llm import tokens
    monkeypatch.setattr(tokens, "KEPT", 60)
    made = tokens.Encoder(P.tokenizer_path())
    draw = random.Random(4)
    texts = ["", "  ", "a.", "é. É,", "x" * 70 + "...", "a'. it's$$ 's.", "\x0b\x0c a\x1cb c_"] + [
        "the " + "".join(draw.choice("aB .,'$12éñ \n\t_-S漢") for _ in range(40)) for _ in range(300)]
    learned = []
    monkeypatch.setattr(made, "_learn", lambda new, learn=made._learn: (learned.extend(new), learn(new)))
    for at in range(0, len(texts), 10):
        for text, ids in zip(texts[at:at + 10], made.encode(texts[at:at + 10])):
            assert np.frombuffer(ids, "<u4").tolist() == made.tokenizer.encode(text, add_special_tokens=False).ids
    # a word of every text is encoded once, whatever else is forgotten
    assert learned.count(b"the") == 1 and len(made.older) < len(set(learned))


def plain_difference(sizes, windows):
    """Karmarkar-Karp with whole rows of sums and of the items behind them."""
    rows = [(size, -i, [(size, [i])] + [(0, [])] * (windows - 1)) for i, size in enumerate(sizes)]
    number = len(sizes)
    while len(rows) > 1:
        rows.sort(key=lambda r: (r[0], r[1]))
        first, other = rows.pop()[2], rows.pop()[2]
        row = sorted([(a + b, x + y) for (a, x), (b, y) in zip(first, other[::-1])], key=lambda c: -c[0])
        row = [(total - row[-1][0], items) for total, items in row]
        rows.append((row[0][0], -number, row))
        number += 1
    return {i: at for at, (_, items) in enumerate(rows[0][2]) for i in items}


@pytest.mark.parametrize("seed", range(20))
def test_difference_is_the_plain_one(seed):
    draw = random.Random(seed)
    sizes = [draw.randint(1, draw.choice([2, 30, 512])) for _ in range(draw.randint(1, 60))]
    windows = draw.randint(1, 20)
    plain = plain_difference(sizes, windows)
    assert P.difference(sizes, windows).tolist() == [plain[i] for i in range(len(sizes))]


def test_ids_of_texts_with_added_tokens():
    from placesearch.llm.tokens import Encoder
    made = Encoder(P.tokenizer_path())
    texts = ["<|endoftext|>", "a <|ENDOFTEXT|> b", "x<|endoftext|>.", "plain.",
             "É<|startoftext|>é <|endoftext|>, <|endoftext"]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in made.encode(texts)] == [
        made.tokenizer.encode(text, add_special_tokens=False).ids for text in texts]


def test_words_are_cut_off_signs_and_go_to_the_model(monkeypatch):
    from placesearch.llm import tokens
    made = tokens.Encoder(P.tokenizer_path())
    whole, given = made.tokenizer, []

    class Watched:
        model = whole.model

        def encode(self, text, **more):
            given.append(text)
            return whole.encode(text, **more)

    made.tokenizer = Watched()
    texts = ["Straße (naïve) well-known,", "", "Naïve. \"WELL\" 7 known?!", "it's"]
    expected = [whole.encode(text, add_special_tokens=False).ids for text in texts]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in made.encode(texts)] == expected
    # signs, digits and what has an apostrophe need the whole tokenizer, words do not
    assert [c for c in "".join(given) if c.isalpha()] == list("its")
    # no part is new any more; slabs of one text, sliced input
    given.clear()
    monkeypatch.setattr(tokens, "TOGETHER", 1)
    found = made.encode(pa.array(["x", *texts, "y"])[1:-1])
    assert [np.frombuffer(ids, "<u4").tolist() for ids in found] == expected and not given


def test_batches_put_together(monkeypatch):
    from placesearch.llm import tokens
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i], "text": ["x" * 100]}) for i in range(7)]
    monkeypatch.setattr(tokens, "TOGETHER", 250)
    found = list(tokens.together(iter(batches)))
    assert [b.column(0).to_pylist() for b in found] == [[0, 1, 2], [3, 4, 5], [6]]
    assert not list(tokens.together(iter([])))
