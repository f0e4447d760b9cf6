"""Language-model scores by a probabilistic suffix tree over words.

The symbols are the words of the training texts, one for all other words, and the end of a text;
contexts are the last one or two symbols.  A context that is frequent enough is kept when what
follows it differs from what follows its shorter suffix: their weighted Kullback-Leibler divergence
must pay for the parameters that the context adds.  Distributions are smoothed towards those of the
suffix, and at the root the words seen once tell how much is left for unknown ones.  A symbol is
scored in the state of the longest suffix that was kept.

Words are told apart by 64-bit hashes.  Counts of all words and contexts are summed in the tasks and
then by key.  The tree is a table of weights by gram that grows with the training texts: a text's
score is the sum of the weights of its words, pairs and triples.  The hottest weights are known to
every task, so the busiest keys never meet in a join; the others are joined by key.  Tables that the
next step does not read are dropped as soon as it is written.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from placesearch.llm import words
from placesearch.llm.landing import drop, fold, held_out, land, map_texts, share, table

FOLDS = 10
SEEN = 32                 # occurrences from which a context is considered
WEIGHT = 8.0              # symbols that the suffix's distribution counts for
HOT = 1 << 21             # weights known in every task, the most frequent ones: 48 MB
UNSEEN = 0.1              # fixed value: added count of the unigram model
_HELD = 1 << 20           # counted keys a task keeps before it sends them on
_ROWS = 1 << 16           # of a batch that leaves a task's Python worker
_TURNS = (17, 29)         # bits that the suffix of a gram of two and three symbols is turned by
_CELLS = 1 << 22          # of 64 marks each, at most: 32 MB
_BLOCK = 1 << 14          # cells in one row of bytes
_KEYS_IN_CELL = 6         # keys that a cell is made for
_PLACES = (34, 41, 48, 55)      # where a key has the numbers of its marks
_U = np.uint64
END = _U(0xD1B54A32D192ED03)    # stands for the end among the words' hashes
_END = int(END.view(np.int64))


@dataclass
class Totals:
    """Of the training texts, ends included."""
    tokens: int
    distinct: int
    discount: float       # taken off each count at the root

    @property
    def unknown(self) -> float:
        """Chance at the root of all words that training did not see."""
        return max(self.discount * self.distinct / self.tokens, 1e-300) if self.tokens else 0.5


# --- counting --------------------------------------------------------------------------------

class _Counter:
    """Counts of 64-bit keys, summed in the task."""

    def __init__(self):
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(n)
        self.held += len(keys)

    def take(self) -> pa.RecordBatch:
        keys = np.concatenate([np.zeros(0, np.int64), *self.keys])
        n = np.concatenate([np.zeros(0, np.int64), *self.counts])
        self.__init__()
        if len(keys):
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            keys, n = keys[cut], np.add.reduceat(n, cut)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])


def _parts(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, rows.num_rows, _ROWS):
        yield rows.slice(at, _ROWS)


def _texts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per run of texts: place of each text's first word, the different words' hashes, the number of
    each word among them, and how often they occur.
    """
    for _, hashed, first in words.word_hashes(column):
        yield first, *np.unique(hashed, return_inverse=True, return_counts=True)


def count_words(texts: DataFrame) -> DataFrame:
    """``key, n`` of all words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()
        for batch in batches:
            for _, different, _, times in _texts(batch.column(0)):
                counter.add(different.view(np.int64), times)
                if counter.held > _HELD:
                    yield from _parts(counter.take())
        yield from _parts(counter.take())

    return map_texts(texts.select("text"), run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _cut(counts: DataFrame, most: int) -> int:
    """The lowest count such that at most ``most`` rows reach it."""
    taken, cut = 0, None
    sizes = counts.groupBy("n").agg(F.count("*").alias("rows"))
    for row in sizes.orderBy(F.desc("n")).limit(most + 1).collect():
        taken += row.rows
        if taken > most:
            break
        cut = row.n
    return cut if cut is not None else (1 << 62)


def totals(counts: DataFrame) -> Totals:
    """``counts``: ``key, n`` of all words and the end."""
    tokens, distinct, once = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"),
                                        F.count_if((F.col("n") == 1) & (F.col("key") != _END))).first()
    # as much is left for unknown words as words seen once make up
    return Totals(int(tokens), int(distinct), float(min(0.9, max(once, 1) / max(distinct, 1))))


# --- the tree as a table ---------------------------------------------------------------------

def _mixed(context: np.ndarray, suffix: np.ndarray, turn: int) -> np.ndarray:
    """Key of a context and the symbol, or the shorter gram, that ends with the next symbol."""
    return context ^ (suffix << _U(turn) | suffix >> _U(64 - turn))


def _key(turn: int) -> Column:
    """The same of the columns ``context`` and ``suffix``."""
    return F.col("context").bitwiseXOR(F.shiftleft("suffix", turn).bitwiseOR(
        F.shiftrightunsigned("suffix", 64 - turn)))


def _grams(first: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, ...]:
    """Symbols of all texts in a row, which of them begin a text, the symbol before each, and the
    key of the two symbols that end with each.  Before a text stands an end.
    """
    row = np.insert(hashed, first[1:], END)
    begin = np.zeros(len(row), dtype=bool)
    begin[first[:-1] + np.arange(len(first) - 1)] = True
    before = np.concatenate([np.array([END]), row[:-1]])
    return row, begin, before, _mixed(before, row, _TURNS[0])


def _marks(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of all ``key`` in cells of 64 marks: a key that is not marked is not in the table.

    Each key has up to four marks in one cell.  The cells grow with the keys, up to 32 MB; with more
    than about 25 million keys, more keys are looked up in vain, which changes no result.
    """
    size, rows = 1 << 10, keys.count()
    while size < min(rows / _KEYS_IN_CELL, _CELLS):
        size <<= 1
    key = F.col("key")
    marks = [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {at}) & 63 as int))") for at in _PLACES]
    bits = marks[0]
    for mark in marks[1:_marks_of(rows, size)]:
        bits = bits.bitwiseOR(mark)
    cells = keys.select(key.bitwiseAND(F.lit(size - 1)).alias("cell"), bits.alias("bits")).groupBy("cell").agg(
        F.bit_or("bits").alias("bits"))
    block = min(size, _BLOCK)

    def pack(rows: pa.Table) -> pa.Table:
        cell = rows["cell"].to_numpy()
        found = np.zeros(block, dtype=np.int64)
        found[cell % block] = rows["bits"].to_numpy()
        return pa.table({"at": [int(cell[0]) // block * block], "bits": [found.tobytes()]})

    # the cells reach the driver as a few rows of bytes
    packed = cells.groupBy(F.shiftright("cell", block.bit_length() - 1)).applyInArrow(pack, "at long, bits binary")
    found = np.zeros(size + 1, dtype=_U)
    for row in packed.toLocalIterator():
        found[row.at:row.at + block] = np.frombuffer(row.bits, dtype=_U)
    found[size] = _marks_of(rows, size)
    return found


def _marks_of(keys: int, cells: int) -> int:
    """Marks of each key: fewer where cells are full."""
    return max(1, min(len(_PLACES), round(44 * cells / max(keys, 1))))


def _marked(marks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    cells = marks[keys & _U(len(marks) - 2)]
    found = np.ones(len(keys), dtype=bool)
    for at in _PLACES[:int(marks[-1])]:
        found &= (cells >> (keys >> _U(at) & _U(63)) & _U(1)).astype(bool)
    return found


def count_grams(texts: DataFrame, marks: np.ndarray, depth: int) -> DataFrame:
    """``context, suffix, n`` of grams seen at least twice, for contexts of ``depth`` symbols.

    ``suffix`` is the next symbol at depth 1; at depth 2 it is the key of the last symbol of the
    context and the next one.  Contexts without a mark are left out.
    """
    shared = share(texts.sparkSession, marks)

    def take(held: list) -> pa.RecordBatch:
        context, suffix, n = (np.concatenate(c) for c in zip(*held)) if held else [np.zeros(0, np.int64)] * 3
        key = _mixed(context.view(_U), suffix.view(_U), _TURNS[depth - 1])
        order = np.argsort(key)
        cut = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(key) else order
        n = np.add.reduceat(n[order], cut) if len(cut) else n
        return pa.RecordBatch.from_arrays([pa.array(context[order[cut]].view(np.int64)),
                                           pa.array(suffix[order[cut]].view(np.int64)), pa.array(n)],
                                          ["context", "suffix", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = pickle.loads(shared.value)
        held, size = [], 0
        for batch in batches:
            for _, hashed, first in words.word_hashes(batch.column(0)):
                row, begin, context, two = _grams(first, hashed)
                suffix, real = row, True
                if depth == 2:
                    context, suffix, real = np.concatenate([two[:1], two[:-1]]), two, ~begin
                at = np.flatnonzero(_marked(marks, context) & real)
                _, one, n = np.unique(_mixed(context[at], suffix[at], _TURNS[depth - 1]),
                                      return_index=True, return_counts=True)
                held.append((context[at[one]], suffix[at[one]], n))
                size += len(one)
                if size > _HELD:
                    yield from _parts(take(held))
                    held, size = [], 0
        yield from _parts(take(held))

    return (map_texts(texts.select("text"), run, "context long, suffix long, n long")
            .groupBy("context", "suffix").agg(F.sum("n").alias("n")).filter("n >= 2"))


def _kept(rows: DataFrame) -> DataFrame:
    """``context, total, pooled`` of the contexts whose divergence pays.

    ``rows``: ``context, symbol, n, total, q, own``, with the suffix's chance ``q`` of the symbol and
    the one that the tree gives, ``own``; what is not listed counts as one symbol.  ``pooled`` is the
    log10 factor on the suffix's chance for a symbol that is not listed.
    """
    summed = rows.groupBy("context").agg(
        F.first("total").alias("total"), F.count("*").alias("kinds"), F.sum("n").alias("listed"),
        F.sum("q").alias("mass"), F.sum("own").alias("own"),
        F.sum(F.col("n") * F.log(F.col("n") / F.col("q"))).alias("part"))
    pool = F.col("total") - F.col("listed")
    rest = F.when(pool > 0, pool * F.log(pool / F.greatest(1 - F.col("mass"), F.lit(1e-9)))).otherwise(0.0)
    gain = F.col("part") + rest - F.col("total") * F.log("total")
    left = F.greatest(pool, F.lit(0)) / F.greatest(1 - F.col("own"), F.lit(1e-9))
    return summed.filter(gain > 0.5 * F.col("kinds") * F.log("total")).select(
        "context", "total", F.log10((left + WEIGHT) / (F.col("total") + WEIGHT)).alias("pooled"))


def gram_weights(texts: DataFrame, counts: DataFrame, known: Totals, seen: int) -> DataFrame:
    """``key, w, base, n``: what each occurrence of a symbol or gram adds to the scores.

    A symbol's score is the root's, plus for each kept context before it the factor for what is not
    listed, plus for a listed symbol the difference to its own chance.  All three hang on the symbol
    or gram alone, so a text's score is the sum of the weights of its grams.  ``base`` is null but
    for single symbols.  A key that is a gram and a context has two rows, with the same ``n``.  Every
    context seen ``seen`` times that pays is kept, and all of it stays a table.
    """
    root = _root(known)
    often = counts.filter(F.col("n") >= seen)
    q = counts.select(F.col("key").alias("suffix"), F.pow(F.lit(10.0), root).alias("q"))
    listed = land(count_grams(texts, _marks(often), 1)
                  .join(often.select(F.col("key").alias("context"), F.col("n").alias("total")), "context")
                  .join(q, "suffix"), "pairs")
    smooth = (F.col("n") + WEIGHT * F.col("own")) / (F.col("total") + WEIGHT)
    first = land(_kept(listed.withColumn("own", F.col("q"))), "states")
    # the columns that the others are made of repeat and take little room
    pairs = land(listed.join(first.select("context", "pooled"), "context", "left"), "pairs")
    drop(listed)
    pairs = pairs.withColumn("own", F.col("q")).select(
        _key(_TURNS[0]).alias("key"), "suffix", "n", "q", "pooled", smooth.alias("smooth"))
    often = pairs.filter((F.col("n") >= seen) & (F.col("suffix") != _END))
    above = pairs.select(F.col("key").alias("suffix"), F.col("smooth").alias("q"),
                         F.when(F.col("pooled").isNull(), F.col("q")).otherwise(F.col("smooth")).alias("own"))
    triples = land(count_grams(texts, _marks(often), 2)
                   .join(often.select(F.col("key").alias("context"), F.col("n").alias("total")), "context")
                   .join(above, "suffix"), "triples")
    second = land(_kept(triples), "states")
    more = F.lit(None).cast("double").alias("base")
    parts = [
        counts.select("key", (root - float(np.log10(known.unknown))).alias("w"),
                      F.log10((F.col("n") + UNSEEN) / UNSEEN).alias("base"), "n"),
        first.select(F.col("context").alias("key"), F.col("pooled").alias("w"), more, F.col("total").alias("n")),
        pairs.filter("pooled IS NOT NULL").select(
            "key", (F.log10(F.col("smooth") / F.col("q")) - F.col("pooled")).alias("w"), more, "n"),
        second.select(F.col("context").alias("key"), F.col("pooled").alias("w"), more, F.col("total").alias("n")),
        triples.join(second.select("context", "pooled"), "context").select(
            _key(_TURNS[1]).alias("key"), (F.log10(smooth / F.col("own")) - F.col("pooled")).alias("w"), more, "n")]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    weights = land(rows, "weights")
    drop(first, pairs, triples, second)
    return weights


# --- scoring ---------------------------------------------------------------------------------

_COLUMNS = ["doc_id", "hash", "key", "times", "own"]
_OWN = "struct<tokens:long,known:long,base:double,score:double>"


def _starts(keys: np.ndarray) -> np.ndarray:
    """Of the sorted ``keys``, the first one from each value of their upper bits on: one key each on average."""
    bits = max(1, (len(keys) - 1).bit_length())
    upper = keys >> _U(64 - bits)
    return np.searchsorted(upper, np.arange(1 << bits, dtype=_U)).astype(np.int32)


def _find(known: np.ndarray, starts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each key among the sorted ``known``, and whether it is there."""
    if not len(known):
        return np.zeros(len(keys), dtype=np.int32), np.zeros(len(keys), dtype=bool)
    at = starts[keys >> _U(64 - (len(starts) - 1).bit_length())]
    last = len(known) - 1
    np.minimum(at, last, out=at)
    left = np.flatnonzero(known[at] < keys)
    while len(left):
        left = left[at[left] < last]
        at[left] += 1
        left = left[known[at[left]] < keys[left]]
    return at, known[at] == keys


def _lookups(docs: DataFrame, weights: DataFrame, hot: int) -> DataFrame:
    """``doc_id, hash, key, times, own`` of the grams of each text that are to be looked up.

    Besides them each document has one row with what its hottest grams add up to, ``own``; its key is
    the document's hash, so that these rows are dealt out like the others.
    """
    top = weights.filter(F.col("n") >= _cut(weights, hot)).groupBy("key").agg(
        F.sum("w").alias("w"), F.coalesce(F.max("base"), F.lit(float("nan"))).alias("base")).toArrow()
    keys, w, base = top["key"].to_numpy().view(_U), top["w"].to_numpy(), top["base"].to_numpy()
    del top
    order = np.argsort(keys)
    keys, w, base = keys[order], w[order], base[order]
    # the same few bases occur again and again; the last one, not a number, is that of what is no word
    bases, of_base = np.unique(np.append(base, np.nan), return_inverse=True)
    # plain arrays: a task has them once, and not their bytes as well
    shared = docs.sparkSession.sparkContext.broadcast(
        (_marks(weights.select("key")), keys, _starts(keys), w, bases, of_base[:-1].astype(np.int32)))
    del keys, w, base, order, of_base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, known, starts, w, bases, of_base = shared.value
        word = ~np.isnan(bases)
        bases = np.where(word, bases, 0.0)
        for batch in batches:
            for at_row, hashed, first in words.word_hashes(batch.column(2)):
                row, begin, _, two = _grams(first, hashed)
                n = len(first) - 1
                of = np.repeat(np.arange(n), np.diff(first) + 1)
                three = np.flatnonzero(~begin)
                own, keys, owner = np.zeros((3, n)), [], []
                for gram, text in ((row, of), (two, of), (_mixed(two[three - 1], two[three], _TURNS[1]), of[three])):
                    told = _marked(marks, gram)
                    gram, text = gram[told], text[told]
                    at, hit = _find(known, starts, gram)
                    at, of_hit = at[hit], text[hit]
                    own[0] += np.bincount(of_hit, weights=w[at], minlength=n)
                    at = of_base[at]
                    for k, value in ((1, bases), (2, word)):
                        own[k] += np.bincount(of_hit, weights=value[at], minlength=n)
                    keys.append(gram[~hit])
                    owner.append(text[~hit])
                owner, keys = np.concatenate(owner), np.concatenate(keys)
                order = np.lexsort((keys, owner))
                owner, keys = owner[order], keys[order]
                new = np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])) if len(keys) else order
                cut = np.flatnonzero(new)
                times = np.diff(np.append(cut, len(keys)))
                here = batch.slice(at_row, n)
                sums = pa.StructArray.from_arrays(
                    [pa.array((np.diff(first) + 1).astype(np.int64)), pa.array(own[2].astype(np.int64)),
                     pa.array(own[1]), pa.array(own[0])], ["tokens", "known", "base", "score"])
                yield pa.RecordBatch.from_arrays(
                    [here.column(0), here.column(1), here.column(1), pa.array(np.ones(n, np.int32)), sums], _COLUMNS)
                for low in range(0, len(cut), _ROWS):
                    part = cut[low:low + _ROWS]
                    of_row = pa.array(owner[part])
                    yield pa.RecordBatch.from_arrays(
                        [here.column(0).take(of_row), here.column(1).take(of_row), pa.array(keys[part].view(np.int64)),
                         pa.array(times[low:low + _ROWS].astype(np.int32)), pa.nulls(len(part), sums.type)], _COLUMNS)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("hash"), "text"), run,
                     f"doc_id {kind}, hash long, key long, times int, own {_OWN}")


def _root(known: Totals) -> Column:
    """log10 chance at the root of a symbol with the count ``n``."""
    return F.log10(F.greatest(F.col("n") - known.discount, F.lit(0.05)) / max(known.tokens, 1))


def score_texts(docs: DataFrame, learn_from: DataFrame, frequent: int = HOT, seen: int = SEEN) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, n_known, train_tokens, base_score, score``.

    Tokens are lower-cased words and one end per text.  ``base_score`` is the unigram log10
    probability, ``score`` that of the tree; for both, all words that training did not see are one
    symbol.  A null text counts as empty: it is its end alone.  Rows that repeat are scored each,
    and learned from each.  Without training texts nothing is known and a token's chance is a half.
    The ``frequent`` hottest weights are known to every task, the others are joined; this changes
    no score.  ``doc_id`` may have any type that can be grouped by and keeps it.  Only ``doc_id``
    and ``text`` are read.
    """
    texts = learn_from.select("text")
    ends = texts.count()
    counts = land(count_words(texts), "words")
    end = docs.sparkSession.createDataFrame([(_END, ends)] if ends else [], "key long, n long")
    every = counts.unionByName(end)
    known = totals(every)
    weights = gram_weights(texts, every, known, seen)
    drop(counts)
    told = _lookups(docs, weights, frequent).join(weights.drop("n"), "key", "left")
    own = F.col("own").isNotNull()
    add = lambda name, c: F.sum(F.when(own, F.col(f"own.{name}")).otherwise(F.col("times") * c))
    # rows with one id and one text have the same sums
    sums = told.filter(own | F.col("w").isNotNull()).withColumn(
        # a word may also be a context, and has two rows then: its base counts once
        "_word", F.col("base").isNotNull().cast("long")).groupBy("doc_id", "hash").agg(
        F.count_if(own).alias("copies"), F.sum("own.tokens").alias("n_tokens"),
        add("known", F.col("_word")).alias("n_known"), add("base", F.col("base")).alias("base"),
        add("score", F.col("w")).alias("score"))
    each = lambda name: F.col(name) / F.col("copies")
    none = float(np.log10(UNSEEN / (known.tokens + UNSEEN * (known.distinct + 1))))
    tokens = each("n_tokens").cast("long")
    found = sums.select(
        "doc_id", "copies", tokens.alias("n_tokens"), each("n_known").cast("long").alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (tokens * none + each("base")).alias("base_score"),
        (tokens * float(np.log10(known.unknown)) + each("score")).alias("score"))
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "_copy")


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score_texts(docs, docs.filter(fold(FOLDS) != 0))
    return found.select("doc_id", held_out(FOLDS).alias("held_out"), "n_tokens", "n_known",
                        "train_tokens", "base_score", "score")


QUERIES = {"op4_suffix_tree": op4_suffix_tree}
SQL: dict[str, str] = {}
