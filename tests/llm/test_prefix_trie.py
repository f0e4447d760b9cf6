import hashlib
import random
import zlib

import numpy as np
import pytest

from compare import compare, duck
from placesearch.llm import prefix_trie as T

SMALL = "/root/testdata/sf0.001"
TABLE = "conv_id long, turn long, role string, text string, n_convs int, turns string"


def test_sql(spark):
    ok, note = compare(duck(SMALL), T.op12_prefix_trie(spark, SMALL), T.SQL["op12_prefix_trie"])
    assert ok, note


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = (*own.get(c - c % 5, [])[:h], *turns[h:])
    nodes = {}
    for c, turns in sorted(built.items()):
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    found = []
    under = {}
    kids = {}
    for key in nodes:
        if key:
            kids[key[:-1]] = kids.get(key[:-1], 0) + 1
    for key, members in nodes.items():
        saved = (len(members) - 1) * len(key[-1][1].encode()) if key else 0
        for d in range(len(key) + 1):
            s = under.setdefault(key[:d], [0, 0])
            s[0] += key not in kids
            s[1] += saved
    for key, members in nodes.items():
        ends = ",".join(str(c) for c in members if len(built[c]) == len(key))
        found.append((members[0], len(key), nodes[key[:-1]][0] if key else None, len(members), kids.get(key, 0),
                      *under[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=str)


def rows(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens,
                    r.ends_sha256) for r in df.collect()), key=str)


def conversations():
    """A common first turn, a group of copies, repeats, nulls, empty texts and a long conversation."""
    draw = random.Random(9)
    text = lambda: draw.choice(["a", "b", "é", "", "long " * 20])
    found = []
    for c in range(240):
        if c % 11 == 0:
            continue                                            # its group may lack a first conversation
        turns = [("system", "hello")] if c % 3 else []
        turns += [(draw.choice(["user", "assistant"]), text()) for _ in range(draw.randint(0, 12))]
        if c % 4 == 1:
            turns = [("user", "copy"), ("assistant", "of"), ("user", "it")] * 4
        found += [(c, t, *x) for t, x in enumerate(turns)]
    found += [(2_000_000_007, t, "user", f"deep {t % 7}") for t in range(900)] + [(2_000_000_009, t, "user", f"deep {t % 7}") for t in range(901)]
    found += [(301, None, "user", "first"), (301, 1, None, None), (301, 1, None, None), (None, 1, "user", "x"), (303, 4, None, "x")]
    return found


@pytest.mark.parametrize("options", [{}, {"TURNS": 60}, {"TURNS": 40, "PATHS": 4, "CHUNK_BITS": 3, "KEYS": 0}])
def test_equals_brute_force(spark, monkeypatch, options):
    for name, value in options.items():
        monkeypatch.setattr(T, name, value)
    data = conversations()
    table = spark.createDataFrame([(*r, 1, "x") for r in data], TABLE)
    assert rows(T.conversation_trie(table)) == brute(data)


def test_empty_tables(spark):
    table = spark.createDataFrame([(None, 1, "u", "x", 1, "x")], TABLE)
    assert T.conversation_trie(table).count() == T.conversation_trie(table.limit(0)).count() == 0
    one = spark.createDataFrame([(3, 1, "u", "x", 1, "x")], TABLE)
    assert rows(T.conversation_trie(one)) == brute([(3, 1, "u", "x")])


def test_double_array_finds_every_prefix_and_nothing_else():
    draw = np.random.default_rng(3)
    found = sorted({tuple(draw.integers(0, 40, draw.integers(0, 7)).tolist()) for _ in range(3000)})
    lengths = np.array([len(s) for s in found])
    starts = np.cumsum(lengths) - lengths
    codes = np.array([c for s in found for c in s])
    trie = T.pack(codes, starts, lengths)
    cells = T.traverse(trie, codes, starts, lengths)
    by_prefix = {}
    for i, s in enumerate(found):
        for d in range(len(s) + 1):
            assert by_prefix.setdefault(s[:d], cells[starts[i] + i + d]) == cells[starts[i] + i + d]
    assert len(set(by_prefix.values())) == len(by_prefix)
    assert (trie.check >= 0).sum() == len(by_prefix) - 1            # no cell but those of nodes is taken
    for s in list(by_prefix)[:300]:
        step = trie.step(np.full(40, by_prefix[s]), np.arange(40))
        assert [by_prefix.get((*s, c), -1) for c in range(40)] == step.tolist()
    assert trie.top < 2 * len(by_prefix)
