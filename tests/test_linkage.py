"""Linkage on small frames, and the block comparison against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from placesearch.functions.names import common_length, extract_state, merge_key, most_alike, token_sort
from placesearch.operators import linkage as ln, similar
from placesearch.plans import linking

GUIDE = "row_id long, title string, State string"
SHEET = ("row_no long, ID long, Restaurant string, State string, City string, Address string, "
         "Region string, Crossout string, `Honor Roll` string, Recommend string, long double, "
         "lat double, geohash string, `10th Ed.` string")


def sheet(spark, rows):
    return spark.createDataFrame(
        [(i, ident, name, state, f"c{ident}", None, "R", None, None, None, 1.0, 2.0, "g", ed)
         for i, (ident, name, state, ed) in enumerate(rows)], SHEET)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


@pytest.mark.parametrize("address, state", [
    ("Cranston, RI", "RI"), ("Cranston, RI (rear)", "RI"), ("123 Main 02920", None),
    ("Main St. Town, TX 02920", "TX"), ("AB cd, NM x", "NM"), ("", None), (None, None),
    ("Town, RI\n", "RI")])
def test_extract_state(one, address, state):
    assert one(extract_state, address) == state


def test_keys(one):
    assert one(merge_key, "\u00a0 Joe's\t") == "joe's"
    assert one(token_sort, " b  a\tc ") == "a b c"


words = st.text(alphabet="abcdeé ", min_size=1, max_size=12)


def bags(names):
    return np.array([np.bincount([ord(c) % similar.BINS for c in n], minlength=similar.BINS) for n in names])


def closest(left, right, position, floor=-1.0):
    return most_alike(left, bags(left), np.full(len(left), floor), right, bags(right), position)


@settings(max_examples=150, deadline=None)
@given(st.lists(words, min_size=1, max_size=5), st.lists(words, min_size=1, max_size=90))
def test_closest_is_exact(left, right):
    position = np.array(random.Random(1).sample(range(1000), len(right)))
    best = closest(left, right, position)
    for name, got in zip(left, best.itertuples()):
        scores = [(-lcs(name, r) / (len(name) + len(r)), p) for r, p in zip(right, position)]
        wanted = scores.index(min(scores))
        assert (got.lcs, got.length) == (lcs(name, right[wanted]), len(name) + len(right[wanted]))
        assert got.position == position[wanted]
        assert common_length(name, right[wanted]) == got.lcs
    for got, low in ((best, 60.0),):
        kept = closest(left, right, position, low)
        assert set(kept["name"]) == {r.name_ for r in got.rename(columns={"name": "name_"}).itertuples()
                                     if 200 * r.lcs / r.length >= low}


def test_closest_with_long_names():
    rng = random.Random(3)
    long = ["".join(rng.choice("abcd") for _ in range(n)) for n in (64, 65, 130)]
    right = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 150))) for _ in range(40)]
    for name, got in zip(long, closest(long, right, np.arange(40)).itertuples()):
        assert got.lcs == lcs(name, right[got.position])
        assert got.lcs / got.length == max(lcs(name, r) / (len(name) + len(r)) for r in right)


def test_exact_pass_keeps_rows_and_matches_nulls(spark):
    guide = spark.createDataFrame([(1, " JOE ", "TX"), (2, "joe", None), (3, "ann", "TX"),
                                   (4, None, None)], GUIDE)
    right = sheet(spark, [(10, "Joe", "TX", "y"), (11, "joe ", "TX", "y"), (12, "Joe", None, "y")])
    got = sorted((r.row_id, r.ID) for r in ln.exact_link(guide, right).filter("ID > 0").collect())
    assert got == [(1, 10), (1, 11), (2, 12)]
    assert ln.exact_link(guide, right).count() == 5
    assert dict(ln.exact_link(guide, right).dtypes)["ID"] == "bigint"


def test_exact_pass_names_missing_columns(spark):
    with pytest.raises(ValueError, match="guide.State"):
        ln.exact_link(spark.createDataFrame([(1, "a")], "row_id long, title string"),
                      sheet(spark, [(1, "a", "TX", "y")]))


def test_last_candidate_wins_at_first_position(spark):
    right = sheet(spark, [(1, "Joe", "TX", "y"), (2, "Eoj", "TX", "y"), (3, "JOE", "TX", "y"),
                          (4, "x", None, "y")])
    got = {r.name: (r.position, r.candidate.ID) for r in ln.blocked_candidates(right).collect()}
    assert got == {"joe": (0, 3), "eoj": (1, 2)}


@pytest.mark.parametrize("pairs", [0, ln.PAIRS])
def test_best_match_in_tiny_blocks_equals_brute_force(spark, monkeypatch, pairs):
    """One state holds most rows and is cut into many blocks on both sides."""
    monkeypatch.setattr(ln, "PAIRS", pairs)
    rng = random.Random(7)

    def name():
        return " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 5)))
                        for _ in range(rng.randint(1, 3)))

    states = ["TX"] * 4 + ["LA", None, "MD"]
    lefts = [(i, name(), rng.choice(states)) for i in range(150)]
    rights = [(i, name(), rng.choice(states[:-1]), "y") for i in range(200)]
    best = ln.best_match(spark.createDataFrame(lefts, GUIDE), sheet(spark, rights), block_rows=16)
    got = {r.row_id: (round(r.score, 9), r.candidate.ID) for r in best.collect()}

    wanted = {}
    for row_id, title, state in lefts:
        block = {}
        for ident, right, place, _ in rights:
            if state and place == state:
                block[right] = ident
        if block:
            a = " ".join(sorted(title.split()))
            scored = []
            for at, (right, ident) in enumerate(block.items()):
                b = " ".join(sorted(right.split()))
                scored.append((-200 * lcs(a, b) / (len(a) + len(b)), at, ident))
            top = min(scored)
            wanted[row_id] = (round(-top[0], 9), top[2])
    assert got == wanted


def test_passes(spark):
    guide = spark.createDataFrame([
        (1, "Joe Diner", "TX"), (2, "Diner Joe", "TX"), (3, "Jo Diners", "TX"),
        (4, "qqqq", "TX"), (5, "Joe Diner", None), (6, "Joe Diner", "LA")], GUIDE)
    right = sheet(spark, [(10, "Joe Diner", "TX", "y"), (11, "Joe Diners", "TX", "y"),
                          (12, "Zed", "TX", "n"), (13, "Joe Diner", "TX", "n"),
                          (14, "Ann's", "MD", "y")])
    done = ln.link(guide, right)
    final = {(r.row_id, r.ID) for r in done.final.collect()}
    assert {(1, 10), (1, 13), (2, 11), (3, 11), (4, None), (5, None), (6, None)} == final
    assert sorted(r.row_id for r in done.high.collect()) == [2, 3]     # both may take one row
    assert done.low.count() == 0
    report = {r.row_id: (r.Best_Match, r.Excel_ID) for r in ln.unmatched_report(done).collect()}
    assert report[4] == ("Joe Diners", 11) and report[5] == (None, None) == report[6]
    assert {r.ID for r in ln.unused_report(right, done.final).collect()} == {14}
    summary = [(r["pass"], r.matches, r.remaining) for r in
               ln.pass_summary(guide, done).orderBy("pass_no").collect()]
    assert summary == [("exact", 2, 5), ("high", 2, 3), ("low", 0, 3)]


def test_patch_overwrites_with_null(spark):
    guide = spark.createDataFrame([(1, "a", "TX")], GUIDE)
    linked = ln.exact_link(guide, sheet(spark, [(9, "zz", "TX", "y")])).withColumn(
        "Region", F.lit("old"))
    best = ln.best_match(linked, sheet(spark, [(9, "a b", "TX", "y")]).withColumn(
        "Region", F.lit(None).cast("string")))
    row = ln.patch_linked(linked, best).first()
    assert (row.ID, row.Region, row.Restaurant) == (9, None, "a b")


def test_higher_threshold_never_adds(spark):
    rows = [(i, f"name {i} {'x' * (i % 7)}", "TX") for i in range(40)]
    best = ln.best_match(spark.createDataFrame(rows, GUIDE),
                         sheet(spark, [(i, f"nome {i}", "TX", "y") for i in range(15)]))
    counts = [ln.accept(best, t).count() for t in (0, 25, 50, 85, 100)]
    assert counts == sorted(counts, reverse=True)


def test_edition_filter_without_the_column(spark):
    right = sheet(spark, [(1, "a", "TX", "n")])
    assert ln.edition_filter(right).count() == 0
    assert ln.edition_filter(right.drop("10th Ed.")).count() == 1


def _names(spark, count, seed, letters="abcdefgh"):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 14))) for _ in range(count)]

    def worn(name):
        out = list(name)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(out) + 1)
            out[at:at + rng.randint(0, 1)] = rng.choice(["", "x", "a", "b"])
        return "".join(out) or "q"

    left = sorted({worn(n) for n in base} | {"a", "ab"})
    return left, sorted(set(base) | {"ab", "abc"})


@pytest.mark.parametrize("threshold", [85.0, 75.0])
def test_similarity_join_misses_no_pair_and_compares_few(spark, threshold):
    left, right = _names(spark, 150, 11)
    names = spark.createDataFrame([("TX", n) for n in left], "State string, left_key string")
    rights = spark.createDataFrame([("TX", n, i) for i, n in enumerate(right)], "State string, right_key string, position long")
    pairs = [(r.left_key, r.right_key) for r in similar.candidate_pairs(names, rights, threshold).collect()]
    assert len(pairs) == len(set(pairs)) and len(pairs) < len(left) * len(right) / (20 if threshold > 80 else 5)
    near = {(a, b) for a in left for b in right if 200 * lcs(a, b) / (len(a) + len(b)) >= threshold}
    joined = {a for a, _ in pairs}
    assert {p for p in near if p[0] in joined} <= set(pairs)
    if threshold == 85.0:
        assert {p for p in near if p[0] != p[1]} <= set(pairs)
    best = {r.left_key: (round(r.score, 9), r.position) for r in similar.near_pairs(names, rights, threshold).collect()}
    for name, got in best.items():
        scored = [(-200 * lcs(name, r) / (len(name) + len(r)), i) for i, r in enumerate(right)]
        assert got == (round(-min(scored)[0], 9), min(scored)[1])


def test_blocks_are_skipped_and_the_best_stays_exact(spark):
    left, right = _names(spark, 200, 5)
    names = spark.createDataFrame([("TX", n) for n in left], "State string, left_key string")
    rights = spark.createDataFrame([("TX", n, i) for i, n in enumerate(right)], "State string, right_key string, position long")
    got = {r.left_key: (round(r.score, 9), r.position) for r in similar.best_in_blocks(names, rights, 4).collect()}
    assert set(got) == set(left)
    for name, found in got.items():
        scored = [(-200 * lcs(name, r) / (len(name) + len(r)), i) for i, r in enumerate(right)]
        assert found == (round(-min(scored)[0], 9), min(scored)[1])
    blocks = similar.blocked(rights, 4)
    named = names.select("State", "left_key", F.length("left_key").alias("n"), similar.bag(F.col("left_key")).alias("bag"),
                         F.lit(0).alias("left_no"))
    bounds = similar.block_bounds(named, blocks).withColumn("_r", F.lit(2))
    first = spark.createDataFrame([("TX", n, s[0]) for n, s in got.items()], "State string, left_key string, score double")
    assert similar.open_blocks(bounds, first).count() < bounds.count() / 3


def test_parts_of_the_exact_pass_hold_its_rows(spark):
    guide = spark.createDataFrame([(1, " JOE ", "TX"), (2, "joe", None), (3, "ann", "TX"), (4, None, None), (4, "joe", "TX"),
                                   (5, "bo", "LA"), (6, "bo", "TX")], GUIDE)
    right = sheet(spark, [(10, "Joe", "TX", "y"), (10, "joe ", "TX", "y"), (12, "Joe", None, "y"), (None, "Joe", "TX", "y"),
                          (None, "Bo", "LA", "y"), (13, "zed", "TX", "y"), (14, None, None, "y")])
    rows = lambda df: sorted(map(str, df.collect()))
    whole, parts = ln.exact_link(guide, right), ln.exact_parts(guide, right)
    assert parts.linked.columns == whole.columns and rows(parts.linked) == rows(whole)
    assert rows(parts.open) == rows(ln.unmatched_rows(whole))
    assert sorted(r.ID for r in parts.used.collect()) == [10, 12]
    done = ln.link(guide, right)
    assert rows(ln.unused_directory(right, done.used)) == rows(ln.unused_directory(right, done.final))
    assert rows(ln.unmatched_rows(done.patched)) == rows(ln.unmatched_rows(done.final))


def test_pairs_of_one_split_are_made_by_all_tasks(spark, tmp_path):
    parts = spark.range(2000).selectExpr(
        "id AS p_partkey", "concat('red ', id % 3) AS p_name", "'Brand#11' AS p_brand", "'SMALL TIN' AS p_type",
        "cast(id % 50 AS int) AS p_size", "cast(id AS double) AS p_retailprice")
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    linked = linking.QUERIES["exact_link"](spark, str(tmp_path))
    rows = linked.groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) >= spark.sparkContext.defaultParallelism
    assert max(r["count"] for r in rows) < 2 * min(r["count"] for r in rows)
