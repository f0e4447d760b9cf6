"""Near duplicates by b-bit MinHash.

A document is the set of its word shingles.  Its minima under many hash functions are cut into
bands for finding candidates; of each minimum only the low bits are kept, packed into a signature.
The share of equal bit groups between two signatures, corrected for groups that agree by chance,
estimates the similarity, and pairs well below the threshold are dropped.  All other pairs are
confirmed on their full sets.

Groups of any size are joined without forming all their pairs: documents with equal sets become
one node at once; then every bucket compares its members with one of them, round after round, and
only until all its members are known to be connected.  What is still open is compared in blocks
whose tasks hand on confirmed links only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from placesearch.llm import words
from placesearch.llm.components import components
from placesearch.llm.landing import dealt_anew, land, map_texts, table, whole_rows

BANDS = 40           # with 5 rows each, a pair at 0.8 is missed once in 10 million
ROWS = 5
BITS = 4             # kept of each minimum
SLACK = 5.5          # standard errors an estimate may lie below the threshold
BLOCK = 512          # nodes of a family, and
BLOCK_ITEMS = 2_000_000   # items of their sets, on one side of a task
STALL = 0.7          # another round of single comparisons must leave fewer members than this share
_TOGETHER = 64       # nodes whose items are counted at once
_PER_LONG = 64 // BITS
_LOW = 0x1111111111111111
_U, _V = np.uint64, np.uint32
_SKETCH = "doc_id long, n_shingles long, s1 long, s2 long, keys array<long>, bits array<long>"


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(10)
    return (draw.integers(0, 1 << 32, count, dtype=np.uint64).astype(_V)[:, None],
            (draw.integers(0, 1 << 31, count, dtype=np.uint64) * 2 + 1).astype(_V)[:, None])


def _minima(shingles: np.ndarray, count: int, step: int = 2048) -> np.ndarray:
    shift, factor = _functions(count)
    found = np.full(count, 0xFFFFFFFF, dtype=_V)
    low = (shingles >> _U(32)).astype(_V)
    for at in range(0, len(low), step):
        x = (low[at:at + step] ^ shift) * factor
        x ^= x >> _V(15)
        x *= _V(2246822519)
        np.minimum(found, x.min(axis=1), out=found)
    return found


def _bands(minima: np.ndarray, bands: int) -> np.ndarray:
    cells = minima.reshape(bands, -1).astype(_U)
    key = np.arange(1, bands + 1, dtype=_U)
    for j in range(cells.shape[1]):
        key = words.mix(key * _U(0x9E3779B97F4A7C15) + cells[:, j])
    return key.view(np.int64)


def _packed(minima: np.ndarray) -> np.ndarray:
    low = words.mix(minima.astype(_U)) & _U((1 << BITS) - 1)
    size = -(-len(low) // _PER_LONG)
    low = np.concatenate([low, np.zeros(size * _PER_LONG - len(low), dtype=_U)])
    shift = (np.arange(_PER_LONG, dtype=_U) * _U(BITS))
    return (low.reshape(size, _PER_LONG) << shift).sum(axis=1, dtype=_U).view(np.int64)


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    for _, all_words, first in words.word_hashes(column):
        for i in range(len(first) - 1):
            yield np.unique(words.shingles(all_words[first[i]:first[i + 1]], size))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    values = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))


def sketch(docs: DataFrame, shingle: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per document: set size, a 128-bit name of the set, band keys and packed low bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, one, two, keys, bits = [], [], [], [], []
            for found in _sets(batch.column(1), shingle):
                size.append(len(found))
                one.append(int(words.mix(found).sum(dtype=_U)))
                two.append(int(words.mix(found ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=_U)))
                minima = _minima(found, bands * rows)
                keys.append(_bands(minima, bands) if len(found) else np.zeros(0, dtype=np.int64))
                bits.append(_packed(minima))
            signed = [pa.array(np.array(c, dtype=_U).view(np.int64)) for c in (one, two)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), *signed, _lists(keys), _lists(bits)],
                ["doc_id", "n_shingles", "s1", "s2", "keys", "bits"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, _SKETCH)


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """``node, n, items``: the full set of each document, sorted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.sort(found.view(np.int64)) for found in _sets(batch.column(1), shingle)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(r) for r in rows], pa.int64()), _lists(rows)],
                ["node", "n", "items"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("node"), "text"), run,
                     "node long, n long, items array<long>")


def estimate(a: Column, b: Column, count: int) -> Column:
    """Similarity from two packed signatures of ``count`` groups, corrected for chance."""
    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        folded = d
        for shift in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(d, shift))
        return F.bit_count(folded.bitwiseAND(F.lit(_LOW)))

    wrong = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda t, n: t + n)
    chance = 2.0 ** -BITS
    return ((1 - wrong / count) - chance) / (1 - chance)


def lowest_estimate(threshold: float, count: int) -> float:
    """An estimate that pairs at the threshold fall below almost never."""
    chance = 2.0 ** -BITS
    agree = chance + (1 - chance) * threshold
    return threshold - SLACK * (agree * (1 - agree) / count) ** 0.5 / (1 - chance)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets share ``percent`` of their union; the first of a pair may be busy."""
    second = pairs.join(sets.select(F.col("node").alias("b"), F.col("n").alias("nb"),
                                    F.col("items").alias("ib")), "b")
    both = second.join(sets.select(F.col("node").alias("a"), F.col("n").alias("na"),
                                   F.col("items").alias("ia")), "a")
    # a smaller set than this cannot reach the share
    both = both.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    shared = F.size(F.array_intersect("ia", "ib"))
    return (both.withColumn("_shared", shared)
            .filter(100 * F.col("_shared") >= percent * (F.col("na") + F.col("nb") - F.col("_shared")))
            .select("a", "b").distinct())


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``node, label`` after joining what ``links`` connect."""
    of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
    between = (links.join(of("a"), "a").join(of("b"), "b").filter("la <> lb")
               .select(F.col("la").alias("a"), F.col("lb").alias("b")))
    merged = components(between)
    return land(labels.join(merged.withColumnRenamed("node", "label"), "label", "left")
                .select("node", F.coalesce("component", "label").alias("label")), "labels")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that still hold several components."""
    marked = members.drop("label").join(labels, "node")
    several = dealt_anew(marked.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
                         .filter("lo < hi").select("key"))
    return marked.join(several, "key")


def _families(members: DataFrame) -> DataFrame:
    """``node, family``: open nodes that share buckets, directly or through others."""
    least = dealt_anew(members.groupBy("key").agg(F.min("node").alias("b")))
    return components(members.join(least, "key").select(F.col("node").alias("a"), "b")).select(
        "node", F.col("component").alias("family"))


def _links_in_blocks(members: DataFrame, sets: DataFrame, low: float, count: int, percent: int,
                     block: int) -> DataFrame:
    """All links between different components of open nodes that share buckets.

    Each family is cut into blocks of bounded numbers of nodes and set items.  Every two blocks meet
    in one task, which drops pairs by their signatures, confirms the others on their full sets and
    hands on confirmed links only, one for each node and component.
    """
    nodes = members.select("node", "label", "bits").dropDuplicates(["node"])
    known = land(nodes.join(_families(members), "node").join(sets.dropDuplicates(["node"]), "node"), "open")
    sizes = dealt_anew(known.groupBy("family").agg(F.ceil(F.greatest(
        F.count("*") / block, F.sum("n") / BLOCK_ITEMS)).cast("int").alias("blocks")))
    cut = known.join(sizes, "family").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "node", "label", "bits", "items", "block", "family",
        F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    chance = 2.0 ** -BITS
    most_wrong = count * (1 - (low * (1 - chance) + chance))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        bits = np.array(frame["bits"].tolist(), dtype=np.int64).view(_U)
        node, label = frame["node"].to_numpy(), frame["label"].to_numpy()
        items = list(frame["items"])
        size = np.array([len(x) for x in items])
        # items by number, so that those of a node are marked once and counted in all that may link
        number = np.unique(np.concatenate(items), return_inverse=True)[1]
        items = np.split(number, np.cumsum(size)[:-1])
        marked = np.zeros(number.max() + 1, dtype=bool)
        mine, theirs = np.flatnonzero(frame["block"] == i), np.flatnonzero(frame["block"] == j)
        links = []
        for x in mine:
            d = bits[x] ^ bits[theirs]
            folded = d.copy()
            for shift in range(1, BITS):
                folded |= d >> _U(shift)
            wrong = np.bitwise_count(folded & _U(_LOW)).sum(axis=1)
            near = np.minimum(size[x], size[theirs]) * 100 >= percent * np.maximum(size[x], size[theirs])
            fit = near & (wrong <= most_wrong) & (label[theirs] != label[x])
            if i == j:
                fit &= node[theirs] > node[x]
            joined = set()
            # the likeliest first: one link joins all of a component
            likely = theirs[fit][np.argsort(wrong[fit], kind="stable")]
            marked[items[x]] = True
            for at in range(0, len(likely), _TOGETHER):
                some = [y for y in likely[at:at + _TOGETHER] if label[y] not in joined]
                if not some:
                    continue
                begin = np.cumsum([0, *size[some[:-1]]])
                shared = np.add.reduceat(marked[np.concatenate([items[y] for y in some])], begin, dtype=np.int64)
                for y in np.array(some)[100 * shared >= percent * (size[x] + size[some] - shared)]:
                    if label[y] not in joined:
                        joined.add(label[y])
                        links.append((node[x], node[y]))
            marked[items[x]] = False
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return met.groupBy("family", "i", "j").applyInPandas(run, "a long, b long")


def _node_labels(nodes: DataFrame, docs: DataFrame, shingle: int, percent: int, bands: int,
                 rows: int, block: int) -> DataFrame:
    """``node, label`` of the nodes that share a bucket with another one."""
    buckets = nodes.select("node", F.explode("keys").alias("key"))
    shared = dealt_anew(buckets.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
                        .filter("lo < hi").select("key"))
    members = land(buckets.join(shared, "key").select("key", "node").distinct(), "members")
    met = members.select("node").distinct()
    bits = nodes.join(met, "node", "left_semi").select("node", "bits").dropDuplicates(["node"])
    members = land(members.join(bits, "node"), "members")
    sets = land(shingle_sets(docs.join(met.select(F.col("node").alias("doc_id")), "doc_id",
                                       "left_semi"), shingle), "sets")
    count, threshold = bands * rows, percent / 100
    low = lowest_estimate(threshold, count)
    labels = land(met.withColumn("label", F.col("node")), "labels")
    waiting = members.withColumn("label", F.col("node")).withColumn("used", F.array().cast("array<long>"))
    left = None
    while True:
        # one member of each bucket meets the rest: first any, later one that is already connected
        fresh = ~F.array_contains("used", F.col("node"))
        known = F.array_contains("known", F.col("label")) if "known" in waiting.columns else F.lit(False)
        centre = dealt_anew(waiting.filter(fresh).groupBy("key").agg(F.min(F.struct(
            (~known).alias("_new"), "node")).alias("_c")))
        chosen = (waiting.join(centre, "key")
                  .withColumn("centre", F.col("_c.node")).drop("_c"))
        own = dealt_anew(chosen.filter("node = centre")).select(
            "key", F.col("bits").alias("cbits"), F.col("label").alias("clabel"))
        pairs = (chosen.join(own, "key").filter("label <> clabel")
                 .filter(estimate(F.col("bits"), F.col("cbits"), count) >= low)
                 .select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct())
        labels = _relabelled(labels, land(_confirmed(pairs, sets, percent), "links"))
        named = chosen.select("key", "node", "bits", F.array_union("used", F.array("centre")).alias("used"),
                              "centre")
        now = _open(named, labels)
        # components that hold a former centre of the bucket
        centres = (now.filter("array_contains(used, node)").groupBy("key")
                   .agg(F.collect_set("label").alias("known")))
        waiting = land(now.drop("centre").join(centres, "key", "left"), "waiting")
        open_now = waiting.count()
        if open_now == 0:
            return labels
        if left is not None and open_now > STALL * left:
            break
        left = open_now
    return _relabelled(labels, land(_links_in_blocks(waiting, sets, low, count, percent, block), "links"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS,
                    rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents whose shingle sets share ``percent`` of their union are linked; ``component_id`` is
    the smallest id that links reach.  Texts without words, or null, have no shingles and no links;
    fewer words than ``shingle`` are one shingle.  Rows that repeat a ``doc_id`` get a row each and
    count as linked.  A row without ``doc_id`` is linked with nothing, its component is null and it
    is kept.  Only ``doc_id`` and ``text`` are read.
    """
    sketches = land(sketch(docs, shingle, bands, rows), "sketches")
    real = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # equal sets are one node, named by their smallest id
    classes = dealt_anew(real.groupBy("s1", "s2").agg(F.min("doc_id").alias("node")))
    placed = land(real.select("doc_id", "s1", "s2").join(classes, ["s1", "s2"])
                  .select("doc_id", "node").distinct(), "nodes")
    nodes = sketches.join(placed.filter("doc_id = node").select("doc_id"), "doc_id", "left_semi") \
        .filter("n_shingles > 0").select(F.col("doc_id").alias("node"), "keys", "bits")
    labels = _node_labels(nodes, docs.select("doc_id", "text"), shingle, percent, bands, rows, block)
    joined = placed.join(labels, "node", "left").select(
        "doc_id", F.coalesce("label", "node").alias("label"))
    repeated = placed.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    if not repeated.isEmpty():
        # an id with several texts connects their components
        extra = joined.join(repeated, "doc_id").groupBy("doc_id").agg(F.min("label").alias("b"))
        more = components(joined.join(extra, "doc_id").select(F.col("label").alias("a"), "b"))
        joined = joined.join(more.withColumnRenamed("node", "label"), "label", "left").select(
            "doc_id", F.coalesce("component", "label").alias("label")).distinct()
    found = sketches.select("doc_id", "n_shingles").join(joined, "doc_id", "left")
    component = F.coalesce("label", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, with all their columns: one of each component."""
    gone = near_duplicates(docs, shingle, percent).filter(~F.col("kept")).select("doc_id").distinct()
    return whole_rows(docs, key=F.col("doc_id")).join(
        gone.withColumnRenamed("doc_id", "key"), "key", "left_anti").select("row.*")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


QUERIES = {"op10_minhash_near_dedup": op10_minhash_near_dedup}

SQL = {"op10_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id,
         [x for x in regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+')
          if x <> ''] AS ws
  FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[]
        WHEN len(ws) = 1 THEN ws
        ELSE list_distinct([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) END AS sh
      FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS both_n, any_value(a.n) AS na,
             any_value(b.n) AS nb
      FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
           AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY 1, 2),
l AS (SELECT i, j FROM p WHERE 100 * both_n >= 80 * (na + nb - both_n)),
c AS (SELECT doc_id AS i, doc_id AS j FROM documents
      UNION SELECT c.i, l.j FROM c JOIN l ON l.i = c.j),
m AS (SELECT i AS doc_id, min(j) AS component_id FROM c GROUP BY 1)
SELECT s.doc_id, len(s.sh) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM s JOIN m USING (doc_id)"""}
