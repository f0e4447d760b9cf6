"""Ranked lexical search by Block-Max MaxScore, in DataFrame functions only.

Documents are dealt into blocks of about ``BLOCK`` texts of like length.  The index has one list per
term and block: the block maximum of the term's impact, and the postings packed into integers.  For
every query documents that its rarest terms point to are scored first; the k-th best score found
there is a threshold that no result can be under.  Then

* global bounds split the query's lists: those that even together stay under the threshold are not
  essential, and a text that only they hold is never looked at;
* blocks whose maxima do not reach the threshold are left out;
* the essential lists of the other blocks give candidates with a part of their score, and block
  maxima of the lists that are not essential reject candidates before these lists are unpacked;
* what stays is scored in full, ranked in shards of blocks, and the shards' best rows are merged.

The score is computed in integers, so bounds hold exactly and no result is lost.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from placesearch.llm.landing import land, table, text_of

NO_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"     # fixed value: what separates terms
BLOCK = 128               # documents in a block, on average
RAREST = 12               # lists that point to the documents scored first
SEEDS = 60                # documents scored first for each query
SHARD = 1024              # blocks whose results are ranked together
VOCABULARY = 50_000       # query terms looked up in one pass over the documents
_BITS = 20                # of a packed posting: its impact, which is under 1,000,000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Index:
    """``lists``: term, block, top, postings; ``forward``: block, row, doc_id; ``documents`` is N."""
    lists: DataFrame
    forward: DataFrame
    documents: int


def _lowered(text: Column) -> Column:
    """A-Z lower-cased and no other letter."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def terms_of(text: Column) -> Column:
    return F.array_remove(F.split(_lowered(text), NO_TERM), "")


def _each(value: Column, function) -> Column:
    """``function`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def _counts(hashes: Column) -> Column:
    """Distinct values with the number of their occurrences, in one pass over the sorted values."""
    def runs(row: Column) -> Column:
        order, starts = row["order"], row["starts"]
        return F.transform(starts, lambda s, j: F.struct(
            F.get(order, s).alias("t"), (F.coalesce(F.get(starts, j + 1), F.size(order)) - s).alias("f")))

    def started(order: Column) -> Column:
        starts = F.filter(F.transform(order, lambda h, i: F.when((i == 0) | (h != F.get(order, i - 1)), i)),
                          lambda i: i.isNotNull())
        return F.struct(order.alias("order"), starts.alias("starts"))

    return _each(_each(F.sort_array(hashes), started), runs)


def _hashed(words: DataFrame) -> tuple[list[str], int]:
    """The words of a bounded table and a seed under which their hashes differ."""
    for seed in range(8):
        rows = words.select("term", F.xxhash64(F.lit(seed), "term").alias("h")).collect()
        if len({r.h for r in rows}) == len(rows):
            return [r.term for r in rows], seed
    raise RuntimeError("no seed tells the query terms apart")


def build_index(docs: DataFrame, words: list[str], seed: int) -> Index | None:
    """The lists of ``words``; None if no document has a term.

    Texts are read once; what is kept of them is the number of terms and the counts of ``words``.
    """
    parts = docs.select("doc_id", terms_of(text_of()).alias("terms"))
    known = F.filter("terms", lambda t: t.isin(words)) if words else F.array().cast("array<string>")
    counted = parts.filter(F.size("terms") > 0).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.size("terms").cast("long").alias("n"),
        _counts(F.transform(known, lambda t: F.xxhash64(F.lit(seed), t))).alias("hits"))
    # row ids are drawn once, here; everything after reads the written table
    rows = land(counted.withColumn("class", F.floor(2 * F.log2("n")).cast("int")), "terms")
    classes = rows.groupBy("class").agg(F.count("*").alias("docs"), F.sum("n").alias("n")).collect()
    if not classes:
        return None
    total, length = sum(c.docs for c in classes), sum(c.n for c in classes)
    blocks = F.create_map(*[F.lit(x) for c in classes for x in (c["class"], -(-c.docs // BLOCK))])
    block = (F.shiftleft(F.col("class").cast("long"), 40)
             + F.pmod(F.xxhash64("row"), F.element_at(blocks, F.col("class"))))
    forward = rows.withColumn("block", block)
    m = F.expr(f"100 - 75 + ((75 * n * {total}L) div {length}L)")
    impact = F.expr("(1000000000L * hit.f) div (1000L * hit.f + 8 * m)")
    hits = F.transform("hits", lambda h: F.struct(h["t"].alias("t"), h["f"].alias("f")))
    placed = forward.groupBy("block").agg(F.sort_array(F.collect_list(
        F.struct("row", m.alias("m"), hits.alias("hits")))).alias("docs"))
    postings = (placed.select("block", F.posexplode("docs").alias("slot", "doc"))
                .select("block", "slot", F.col("doc.m").alias("m"), F.explode("doc.hits").alias("hit"))
                .select("block", F.col("hit.t").alias("term"), impact.cast("int").alias("impact"), "slot"))
    packed = F.shiftleft("slot", _BITS).bitwiseOR(F.col("impact"))
    lists = postings.groupBy("block", "term").agg(F.max("impact").alias("top"),
                                                  F.sort_array(F.collect_list(packed)).alias("postings"))
    return Index(land(lists, "lists"), forward.select("block", "row", "doc_id"), total)


def _unpacked(lists: DataFrame) -> DataFrame:
    """Postings as rows: the score a term adds to the document in a slot."""
    opened = lists.select("q", "block", "weight", F.explode("postings").alias("_p"))
    return opened.select("q", "block", F.shiftright("_p", _BITS).alias("slot"),
                         (F.col("weight") * F.col("_p").bitwiseAND(F.lit((1 << _BITS) - 1))).alias("part"))


def _sums(parts: DataFrame) -> DataFrame:
    return parts.groupBy("q", "block", "slot").agg(F.sum("part").alias("part"))


def weighted_terms(index: Index, queries: DataFrame) -> DataFrame:
    """``q, term, times`` -> with ``weight`` and the list's global ``bound``; terms of no weight go."""
    per_term = index.lists.groupBy("term").agg(F.sum(F.size("postings")).alias("df"), F.max("top").alias("most"))
    odds = (2.0 * index.documents + 2.0) / (2.0 * F.col("df") + 1.0)
    weight = F.col("times") * F.floor(1000 * F.log(odds)).cast("long")
    return (queries.join(per_term, "term").withColumn("weight", weight).filter("weight > 0")
            .select("q", "term", "weight", (F.col("weight") * F.col("most")).alias("bound")))


def _kth(index: Index, scored: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """``q, need``: the k-th best score among the documents that score most in part, 1 if there are fewer.

    ``scored``: ``q, block, slot, part``, the part of the score that lists outside ``terms`` add.
    """
    first = Window.partitionBy("q").orderBy(F.desc("part"), "block", "slot")
    seeds = (scored.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= SEEDS)
             .select("q", "block", "slot", "part"))
    whole = seeds.unionByName(_looked_up(index, seeds, terms))
    best = Window.partitionBy("q").orderBy(F.desc("part"))
    kth = _sums(whole).withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k)
    return kth.groupBy("q").agg(F.max(F.when(F.col("_r") == k, F.col("part"))).alias("need")).select(
        "q", F.greatest(F.coalesce("need", F.lit(0)), F.lit(1)).cast("long").alias("need"))


def thresholds(index: Index, terms: DataFrame, k: int) -> DataFrame:
    """``q, need`` from the documents that the query's ``RAREST`` lists of highest weight point to.

    Lists are short where weights are high.
    """
    heavy = Window.partitionBy("q").orderBy(F.desc("weight"), "term")
    ranked = terms.withColumn("_r", F.row_number().over(heavy))
    rare = ranked.filter(F.col("_r") <= RAREST).select("q", "term", "weight")
    part = _sums(_unpacked(rare.join(index.lists, "term")))
    return _kth(index, part, ranked.filter(F.col("_r") > RAREST).select("q", "term", "weight"), k)


def _looked_up(index: Index, rows: DataFrame, terms: DataFrame) -> DataFrame:
    """What ``terms`` add to the documents ``q, block, slot``; postings of other slots stay packed."""
    slots = rows.groupBy("q", "block").agg(F.collect_list("slot").alias("slots"))
    lists = slots.join(terms, "q").join(index.lists.drop("top"), ["block", "term"])
    wanted = F.filter("postings", lambda p: F.array_contains("slots", F.shiftright(p, _BITS)))
    return _unpacked(lists.select("q", "block", "weight", wanted.alias("postings")))


def rank(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """``q, term, times`` -> ``q, rank, doc_id, score``: the k best documents of every query."""
    terms = land(weighted_terms(index, queries), "weights")
    need = land(thresholds(index, terms, k), "need")

    # lists from the lowest global bound up, as long as all of them together stay under the threshold
    rising = Window.partitionBy("q").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    split = land(terms.join(need, "q").withColumn("essential", F.sum("bound").over(rising) >= F.col("need"))
                 .select("q", "term", "weight", "essential"), "split")
    essential, other = split.filter("essential").drop("essential"), split.filter("NOT essential").drop("essential")

    # block maxima: of all lists for the blocks that can have a result, of the others for candidates
    top = F.col("weight") * F.col("top")
    bounds = (index.lists.select("block", "term", "top").join(split, "term").groupBy("q", "block")
              .agg(F.sum(top).alias("bound"), F.sum(F.when(~F.col("essential"), top)).alias("rest"),
                   F.max("essential").alias("reached")))
    live = land(bounds.filter("reached").join(need, "q").filter("bound >= need").select(
        "q", "block", "need", F.coalesce("rest", F.lit(0)).alias("rest")), "live")
    opened = live.select("q", "block").join(essential, "q").join(index.lists.drop("top"), ["block", "term"])
    candidates = land(_sums(_unpacked(opened)).join(live, ["q", "block"]).filter("part + rest >= need")
                      .select("q", "block", "slot", "part", "rest"), "candidates")

    # the best of the candidates raise the threshold before the other lists are unpacked
    need = land(_kth(index, candidates.drop("rest"), other, k), "need")
    candidates = land(candidates.join(need, "q").filter("part + rest >= need").select("q", "block", "slot", "part"),
                      "candidates")
    more = _looked_up(index, candidates, other)
    scored = (candidates.unionByName(more).groupBy("q", "block", "slot").agg(F.sum("part").alias("score"))
              .join(need, "q").filter("score >= need").select("q", "block", "slot", "score"))
    return _merged(named(index, land(scored, "scored")), k)


def named(index: Index, scored: DataFrame) -> DataFrame:
    """With the ids of the documents in the slots of the blocks that have results."""
    blocks = scored.select("block").distinct()
    slots = (index.forward.join(blocks, "block", "left_semi").groupBy("block")
             .agg(F.sort_array(F.collect_list(F.struct("row", "doc_id"))).alias("docs")))
    return scored.join(slots, "block").select(
        "q", "block", F.get(F.col("docs"), F.col("slot"))["row"].alias("row"),
        F.get(F.col("docs"), F.col("slot"))["doc_id"].alias("doc_id"), "score")


def _merged(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of each shard of blocks, then of all shards."""
    best = (F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row"))
    shards = F.lit(max(1, SHARD))
    shard = Window.partitionBy("q", F.pmod(F.xxhash64("block"), shards)).orderBy(*best)
    heads = scored.withColumn("_r", F.row_number().over(shard)).filter(F.col("_r") <= k)
    place = F.row_number().over(Window.partitionBy("q").orderBy(*best))
    return heads.withColumn("rank", place).filter(F.col("rank") <= k).select("q", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of every item, with a score above 0.

    A null or empty text, of a document or an item, has no term and is in no result.  Rows that
    repeat an item, id and text, count as one; an id with several texts is one item per text.  Rows
    that repeat a document are documents of their own.  Equal scores are ranked by ascending doc_id,
    null last.  Only ``doc_id, text`` and ``item_id, text`` are read; ids keep their types.

    Items are looked up in parts of about ``VOCABULARY`` terms, each in one more pass over the texts.
    """
    texts = land(items.select("item_id", text_of().alias("text")).distinct()
                 .withColumn("q", F.monotonically_increasing_id()), "texts")
    named_items = land(texts.select("q", "item_id", F.explode(terms_of(F.col("text"))).alias("term"))
                       .groupBy("q", "item_id", "term").agg(F.count("*").alias("times")), "items")
    distinct = named_items.select("term").distinct().count()
    parts = max(1, -(-distinct // VOCABULARY))
    found = None
    for part in range(parts):
        own = named_items.filter(F.pmod(F.xxhash64("q"), F.lit(parts)) == part) if parts > 1 else named_items
        words, seed = _hashed(own.select("term").distinct())
        index = build_index(docs, words, seed) if words else None
        if index is None:
            continue
        ranked = rank(index, own.select("q", F.xxhash64(F.lit(seed), "term").alias("term"), "times"), k)
        rows = ranked.join(own.select("q", "item_id").distinct(), "q").select("item_id", "rank", "doc_id", "score")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        ids = {name: df.schema[name].dataType.simpleString() for name, df in (("item_id", items), ("doc_id", docs))}
        return docs.sparkSession.createDataFrame(
            [], f"item_id {ids['item_id']}, rank int, doc_id {ids['doc_id']}, score long")
    return found


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op13_lexical_search": op13_lexical_search}


def _sql() -> str:
    pattern = NO_TERM.replace("[", "[^", 1)
    lowered = f"translate(t, '{_UPPER}', '{_LOWER}')"
    return rf"""
WITH d AS (SELECT doc_id, {lowered} AS term
           FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{pattern}')) AS t FROM documents)),
q AS (SELECT item_id, {lowered} AS term
      FROM (SELECT item_id, unnest(regexp_extract_all(coalesce(text, ''), '{pattern}')) AS t FROM benchmark)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM d GROUP BY 1),
a AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM n),
f AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM d GROUP BY 1, 2),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w
      FROM f, a GROUP BY term, docs),
m AS (SELECT doc_id, 100 - 75 + ((75 * n * docs) // total) AS m FROM n, a),
t AS (SELECT item_id, term, count(*)::BIGINT AS times FROM q GROUP BY 1, 2),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM t JOIN f USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""


SQL = {"op13_lexical_search": _sql()}
