"""Records of quoted CSV files with line breaks in their cells, read by many tasks per file.

Whether a line begins inside quotes depends on all quotes before it.  The files are therefore read
twice as plain lines, which can be split: first the quotes of each split are counted, and running sums
over the splits of a file, a short table, tell how each split begins.  Then every split cuts its own
lines into records.  Only pieces of records that cross a split are brought together.

As the format's rules say, a quote stands only in a quoted cell, where it is doubled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

MOST_BROADCAST = 50_000     # splits: how each begins is broadcast while that takes under 10 MB
_PIECES = "file string, block long, kind string, text string"
_HEADER, _HEAD, _TAIL = "header", "0 head", "1 tail"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.option("lineSep", "\n").text(path)
    return read.select("value", F.col("_metadata.file_path").alias("file"),
                       F.col("_metadata.file_block_start").alias("block"))


def _beginnings(lines: DataFrame) -> DataFrame:
    """``file, block, inside``: whether a split of a file begins inside quotes."""
    quotes = F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    counted = lines.groupBy("file", "block").agg(quotes.alias("quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select("file", "block", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).alias("inside"))


class _Split:
    """The lines of one split on their way into records."""

    def __init__(self, file: str, block: int, inside: int):
        self.file, self.block, self.inside = file, block, inside
        self.open: list[str] = []           # lines of a record that has not ended
        self.kind = _HEAD if inside else None
        self.first = block == 0

    def add(self, values: pa.Array) -> Iterator[tuple[str | None, str]]:
        """Whole records and pieces, each with its kind."""
        texts = values.to_pylist()
        ends = (self.inside + np.cumsum(pc.count_substring(values, '"').to_numpy(zero_copy_only=False))) % 2 == 0
        done = 0
        for at in np.flatnonzero(ends).tolist():
            text = texts[at] if at == done and not self.open else "\n".join([*self.open, *texts[done:at + 1]])
            yield (_HEADER if self.first else self.kind), text.removesuffix("\r")
            self.open, self.kind, self.first, done = [], None, False, at + 1
        self.open += texts[done:]
        self.inside = 0 if len(ends) and ends[-1] else (self.inside if not len(ends) else 1)

    def rest(self) -> Iterator[tuple[str, str]]:
        """What goes on in the next split: all of it, if the split begins and ends inside one record."""
        if self.open:
            yield (self.kind or _TAIL), "\n".join(self.open)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split = None

    def rows(split: _Split, found: Iterator[tuple[str | None, str]]) -> pa.RecordBatch:
        kinds, texts = zip(*found) if (found := list(found)) else ((), ())
        return pa.RecordBatch.from_arrays(
            [pa.array([split.file] * len(kinds), pa.string()), pa.array([split.block] * len(kinds), pa.int64()),
             pa.array(kinds, pa.string()), pa.array(texts, pa.string())], ["file", "block", "kind", "text"])

    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_numpy()
        inside = batch.column("inside").to_numpy()
        changes = [0, *(i for i in range(1, len(files)) if files[i] != files[i - 1] or blocks[i] != blocks[i - 1]),
                   len(files)]
        for low, high in zip(changes[:-1], changes[1:]):
            if split is None or (split.file, split.block) != (files[low], int(blocks[low])):
                if split is not None:
                    yield rows(split, split.rest())
                split = _Split(files[low], int(blocks[low]), int(inside[low]))
            yield rows(split, split.add(batch.column("value").slice(low, high - low)))
    if split is not None:
        yield rows(split, split.rest())


def records(spark: SparkSession, path: str) -> DataFrame:
    """``text``: every record of the files but their first ones, the headers.  Empty lines are none."""
    lines = _lines(spark, path)
    beginnings = _beginnings(lines)
    if lines.rdd.getNumPartitions() <= MOST_BROADCAST:
        begun = lines.join(F.broadcast(beginnings), ["file", "block"])
    else:       # the lines of a split come together again, in their order
        begun = (lines.withColumn("id", F.monotonically_increasing_id()).join(beginnings, ["file", "block"])
                 .repartition("file", "block").sortWithinPartitions("file", "block", "id"))
    pieces = begun.select("file", "block", "inside", "value").mapInArrow(_cut, _PIECES)
    whole = pieces.filter("kind IS NULL AND text <> ''").select("text")
    crossing = pieces.filter(F.col("kind").isin(_HEAD, _TAIL))
    order = Window.partitionBy("file").orderBy("block", "kind")
    chained = crossing.withColumn("chain", F.sum((F.col("kind") == _TAIL).cast("long")).over(order))
    joined = chained.groupBy("file", "chain").agg(
        F.sort_array(F.collect_list(F.struct("block", "kind", "text"))).alias("parts"))
    return whole.unionByName(joined.select(F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text")))

