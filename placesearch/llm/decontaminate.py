"""Benchmark decontamination by spaced seeds.

A seed is a window of tokens in which a fixed mask ignores some positions, so a substituted token
there does not hide the rest.  Windows of the benchmark and of the documents that agree on the
other positions are a hit; around it both token rows are compared in place, and the overlap counts
when enough of the stretch agrees, whatever tokens were substituted.  Where the near surroundings do
not agree, as around a short passage within longer texts, the best stretch of any length decides.

The document side is one narrow pass: tokens become numbers, windows are made and looked up
without any shuffle, and only confirmed overlaps leave the task.  Items of equal text are looked up
as one.  The benchmark is looked up in blocks of texts of bounded size; each block is one more pass,
and is over before the next begins, so that no task ever has more than one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from placesearch.llm.landing import drop, land, table, text_of, whole_rows

MASKS = ((0, 1, 2, 4, 5, 6), (0, 1, 3, 5, 6, 7), (0, 2, 3, 6, 7, 8))   # positions compared
REACH = 6             # tokens compared on either side of a hit
AGREE = 0.8           # share of the stretch that must agree
SHORTEST = 12         # tokens in the stretch, or in the item if that has fewer
MIN_ITEM = 8          # a shorter item identifies nothing
BLOCK_SEEDS = 500_000     # seeds broadcast at once: about 30 MB
_SPAN = max(m[-1] for m in MASKS) + 1


def token_ids(column: str = "text") -> Column:
    """Hashes of the lower-cased runs of letters and digits."""
    found = F.regexp_extract_all(F.lower(text_of(column)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(found, lambda t: F.xxhash64(t))


def _seeds() -> str:
    """SQL for the seeds at position ``_p`` of ``_t``; a mask that runs over the end gives null."""
    cells = []
    for number, mask in enumerate(MASKS):
        at = ", ".join(f"_t[_p + {offset}]" for offset in mask)
        cells.append(f"CASE WHEN _p + {mask[-1]} < size(_t) THEN xxhash64({number}, {at}) END")
    return f"array({', '.join(cells)})"


def _windows(rows: DataFrame) -> DataFrame:
    """Every window of ``_t``: ``_p`` and ``_seed``."""
    shortest = min(m[-1] for m in MASKS) + 1
    placed = rows.filter(F.size("_t") >= shortest).withColumn(
        "_p", F.explode(F.expr(f"sequence(0, size(_t) - {shortest})")))
    return placed.withColumn("_seed", F.explode(F.expr(_seeds()))).filter("_seed IS NOT NULL")


def _item_blocks(texts: DataFrame) -> int:
    windows = texts.agg(F.sum(F.size("_t"))).first()[0] or 0
    return -(-windows * len(MASKS) // BLOCK_SEEDS)


def _items(benchmark: DataFrame) -> DataFrame:
    """``item_id, _t`` once each, landed; an item without an id or of too few tokens is left out."""
    return land(benchmark.select("item_id", token_ids().alias("_t")).distinct()
                .filter(F.col("item_id").isNotNull() & (F.size("_t") >= MIN_ITEM)), "items")


def _item_texts(items: DataFrame) -> DataFrame:
    """The different texts of the items under a number: ``_k, _t``, landed."""
    return land(items.select("_t").distinct().withColumn("_k", F.monotonically_increasing_id()), "item-texts")


def _text_overlaps(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Confirmed overlaps with the texts ``_k, _t``, those with sure windows and the others apart."""
    blocks = _item_blocks(texts)
    tokens = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), token_ids().alias("_t"))
    if blocks <= 1:
        return _block_overlaps(tokens, texts)
    found = None
    for b in range(blocks):
        part = land(_block_overlaps(tokens, texts.filter(F.pmod(F.xxhash64("_t"), F.lit(blocks)) == b)), "overlaps")
        drop()       # the block goes from the memory of every task before the next one comes
        found = part if found is None else found.unionByName(part)
    return found


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Confirmed overlaps: ``doc_id, text_hash, item_id, hits, matched, first_token, last_token``.

    One row per document text and benchmark item.  ``hits`` are the confirmed windows, ``matched``
    the most agreeing tokens around one of them, and the tokens bound the document's windows.
    Null and empty texts overlap with nothing, and so do items without an id or of fewer than
    ``MIN_ITEM`` tokens.  Rows that repeat an item count as one; rows that repeat a document add
    their hits.  Only ``doc_id, text`` and ``item_id, text`` are read.
    """
    items = _items(benchmark)
    texts = _item_texts(items)
    out = _text_overlaps(docs, texts).join(items.join(texts, "_t").select("item_id", "_k"), "_k")
    # windows whose near surroundings agree count; only where there is none, those with a longer stretch
    told = {name: (how(F.when(F.col("sure"), F.col(name))), how(F.col(name))) for name, how in (
        ("hits", F.sum), ("matched", F.max), ("first_token", F.min), ("last_token", F.max))}
    return out.groupBy("doc_id", "text_hash", "item_id").agg(
        *[F.coalesce(sure, every).alias(name) for name, (sure, every) in told.items()])


def _longer() -> Column:
    """Agreeing tokens of the best stretch around a hit, null if none is long enough and agrees.

    A stretch has any number of tokens before and after the hit's start, and at least the shortest
    window.  Each agreeing token scores above zero and each other one below it, so that a stretch of
    no negative sum has the share ``AGREE``; the best one has the highest sum.
    """
    share, window = round(100 * AGREE), min(m[-1] for m in MASKS) + 1
    before, after = F.least("_p", "_q"), F.least(F.size("_t") - F.col("_p"), F.size("_u") - F.col("_q"))
    part = lambda c, at, n: F.slice(c, F.col(at) + 1, n)
    left = F.zip_with(F.reverse(F.slice("_t", F.col("_p") - before + 1, before)),
                      F.reverse(F.slice("_u", F.col("_q") - before + 1, before)), lambda a, b: (a == b).cast("int"))
    right = F.zip_with(part("_t", "_p", after), part("_u", "_q", after), lambda a, b: (a == b).cast("int"))
    cell = lambda s, m: F.struct(s.alias("s"), m.alias("m"))
    sums = lambda same: F.aggregate(
        same, F.array(cell(F.lit(0), F.lit(0))), lambda all_, x: F.concat(all_, F.array(cell(
            F.element_at(all_, -1)["s"] + 100 * x - share, F.element_at(all_, -1)["m"] + x))))
    need = F.least(F.lit(SHORTEST), F.size("_u"))
    behind = lambda c, n: F.array_max(F.slice(c, n + 1, F.size(c)))
    plus = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), cell(a["s"] + b["s"], a["m"] + b["m"]))

    def best(both: Column) -> Column:
        far = max(SHORTEST - window, 1)      # from here on any window is long enough
        tries = [plus(F.get(both["l"], F.lit(n)), behind(both["r"], F.greatest(need - n, F.lit(window))))
                 for n in range(far)]
        return F.greatest(*tries, plus(behind(both["l"], F.lit(far)), behind(both["r"], F.lit(window))))

    found = F.transform(F.array(F.struct(sums(left).alias("l"), sums(right).alias("r"))), best)
    return F.element_at(F.transform(found, lambda f: F.when(f["s"] >= 0, f["m"])), 1)


def _block_overlaps(tokens: DataFrame, texts: DataFrame) -> DataFrame:
    seeds = _windows(texts).select("_seed", "_k", F.col("_p").alias("_q"))
    # the block's size is bounded by BLOCK_SEEDS, so it may go to every task
    hits = _windows(tokens).join(F.broadcast(seeds), "_seed").join(
        F.broadcast(texts.select("_k", F.col("_t").alias("_u"))), "_k")
    before = F.least("_p", "_q", F.lit(REACH))
    after = F.least(F.size("_t") - F.col("_p"), F.size("_u") - F.col("_q"), F.lit(_SPAN + REACH))
    stretch = hits.withColumn("_n", before + after).withColumn("_same", F.zip_with(
        F.slice("_t", F.col("_p") - before + 1, F.col("_n")),
        F.slice("_u", F.col("_q") - before + 1, F.col("_n")), lambda a, b: (a == b).cast("int")))
    matched = F.aggregate("_same", F.lit(0), lambda total, x: total + x)
    sure = (F.col("_n") >= F.least(F.lit(SHORTEST), F.size("_u"))) & (F.col("matched") >= AGREE * F.col("_n"))
    checked = stretch.withColumn("matched", matched).withColumn("sure", sure).withColumn(
        "matched", F.when(F.col("sure"), F.col("matched")).otherwise(_longer())).filter("matched IS NOT NULL")
    return checked.groupBy("doc_id", "text_hash", "_k", "sure").agg(
        F.count("*").alias("hits"), F.max("matched").alias("matched"),
        F.min("_p").alias("first_token"), F.max(F.col("_p") + _SPAN - 1).alias("last_token"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without an overlap, with all their columns."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    found = _text_overlaps(docs, _item_texts(_items(benchmark)))
    bad = found.select(key.alias("key"), F.col("text_hash").alias("hash")).distinct()
    keyed = whole_rows(docs, key=key, hash=F.xxhash64(text_of()))
    return keyed.join(bad, ["key", "hash"], "left_anti").select("row.*")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


QUERIES = {"op3_decontamination": op3_decontamination}


def _sql() -> str:
    seed = " UNION ALL ".join(
        f"SELECT id, t, p, {n} AS m, concat_ws(' ', {', '.join(f't[p + {o + 1}]' for o in mask)}) AS s "
        f"FROM {{0}} WHERE p + {mask[-1]} < len(t)" for n, mask in enumerate(MASKS))
    return rf"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS t
           FROM documents),
i AS (SELECT DISTINCT item_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS t
      FROM benchmark),
dp AS (SELECT id, t, unnest(range(len(t))) AS p FROM d),
ip AS (SELECT id, t, unnest(range(len(t))) AS p FROM i WHERE len(t) >= {MIN_ITEM}),
ds AS ({seed.format('dp')}), s AS ({seed.format('ip')}),
h AS (SELECT ds.id AS doc_id, s.id AS item_id, ds.t AS t, s.t AS u, ds.p AS p, s.p AS q,
             least(ds.p, s.p, {REACH}) AS b,
             least(len(ds.t) - ds.p, len(s.t) - s.p, {_SPAN + REACH}) AS a
      FROM ds JOIN s ON ds.m = s.m AND ds.s = s.s),
v AS (SELECT doc_id, item_id, p, len(u) AS nu, a + b AS n,
             list_sum([(t[p + x + 1] = u[q + x + 1])::INT for x in range(-b, a)]) AS same FROM h)
SELECT doc_id, item_id, count(*) AS hits, max(same)::INT AS matched, min(p)::INT AS first_token,
       (max(p) + {_SPAN - 1})::INT AS last_token
FROM v WHERE n >= least({SHORTEST}, nu) AND same >= {AGREE} * n GROUP BY 1, 2"""


SQL = {"op3_decontamination": _sql()}
