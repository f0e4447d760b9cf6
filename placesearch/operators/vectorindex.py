"""A stored inverted-file index over vectors: cells of near vectors, read cell by cell.

Centres are trained on a bounded sample, every row is put into the cell of its nearest centre, and
the table is stored partitioned by cell.  A search reads only the cells whose centres are nearest to
its queries.  The number of cells grows with the square root of the rows, so the share of rows that a
query reads falls as the table grows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from placesearch.operators import vectors
from placesearch.operators.blocks import BLOCK_ROWS, compare_in_blocks

SAMPLE_NUMBERS = 8_000_000    # of the sample that centres are trained on: 64 MB of doubles
SAMPLE_PER_CELL = 64          # sampled vectors a cell, where the table has that many
LEAST_PER_CELL = 16           # with fewer a centre means nothing; bounds the number of cells
FILE_ROWS = 500_000           # a cell with more rows is written by several tasks
ROUNDS = 12                   # of training
TRIED = 256                   # sampled vectors that are searched for to choose the number of cells read
TARGET = 0.97                 # share of their neighbours that must lie in the cells read
_ROWS_AT_ONCE = 1024
_CENTRES = "version string, dims int, cell int, centre array<double>, probes int"


@dataclass
class VectorIndex:
    """``rows``: doc_id, embedding and metadata by ``dims`` and ``cell``; ``centres``: one row per cell."""
    rows: DataFrame
    centres: DataFrame


def _nearest_cells(vectors_: np.ndarray, centres: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` nearest centres of each vector, nearest first, ties to the lower number."""
    found = np.empty((len(vectors_), count), dtype=np.int32)
    own = (centres ** 2).sum(axis=1)
    for at in range(0, len(vectors_), _ROWS_AT_ONCE):
        part = vectors_[at:at + _ROWS_AT_ONCE]
        far = own - 2 * part @ centres.T
        if count == 1:
            found[at:at + len(part), 0] = far.argmin(axis=1)
            continue
        found[at:at + len(part)] = np.argsort(far, axis=1, kind="stable")[:, :count]
    return found


def train_centres(sample: np.ndarray, cells: int, seed: int = 42) -> np.ndarray:
    """Lloyd's rounds from distinct sampled vectors; a cell that loses all its vectors takes a far one."""
    draw = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    cells = min(cells, len(distinct))
    centres = distinct[np.sort(draw.choice(len(distinct), cells, replace=False))]
    for _ in range(ROUNDS):
        near = _nearest_cells(sample, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        count = np.bincount(near, minlength=cells)
        moved = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        empty = np.flatnonzero(count == 0)
        if len(empty):
            far = ((sample - moved[near]) ** 2).sum(axis=1)
            moved[empty] = sample[np.argsort(-far, kind="stable")[:len(empty)]]
        if np.allclose(moved, centres, rtol=0, atol=1e-9):
            break
        centres = moved
    return centres


def choose_probes(sample: np.ndarray, centres: np.ndarray, k: int, seed: int = 42) -> int:
    """The fewest cells a search must read so that ``TARGET`` of sampled neighbours lie in them."""
    draw = np.random.default_rng(seed)
    tried = sample[draw.choice(len(sample), min(TRIED, len(sample)), replace=False)]
    cell = _nearest_cells(sample, centres, 1)[:, 0]
    order = np.argsort(_nearest_cells(tried, centres, len(centres)), axis=1)      # place of each cell
    far = (sample ** 2).sum(axis=1) - 2 * tried @ sample.T
    near = np.argsort(far, axis=1, kind="stable")[:, :min(k + 1, len(sample))]
    places = np.sort(np.take_along_axis(order, cell[near], axis=1).ravel())
    return int(places[min(len(places) - 1, int(np.ceil(TARGET * len(places))) - 1)]) + 1


def _sampled(rows: DataFrame, count: int, most: int, seed: int) -> np.ndarray:
    """About ``most`` vectors, drawn by a hash of the id and the vector."""
    part = rows
    if count > most:
        keep = int(most / count * (1 << 31))
        part = rows.filter(F.pmod(F.xxhash64(F.lit(seed), "doc_id", "embedding"), F.lit(1 << 31)) < keep)
    return vectors._matrix(part.select("embedding").limit(2 * most).toPandas()["embedding"])


def _put(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Each row with its cell; the centres are bounded by ``SAMPLE_NUMBERS``."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("int")
    def cell(vectors_: pd.Series) -> pd.Series:
        return pd.Series(_nearest_cells(vectors._matrix(vectors_), shared.value, 1)[:, 0] if len(vectors_) else [],
                         dtype="int32")

    return rows.withColumn("cell", cell("embedding"))


def build(docs: DataFrame, folder: str, cells: int | None = None, k: int = vectors.MAX_K, seed: int = 42) -> None:
    """Store the index of ``doc_id, embedding`` and any other columns under ``folder``.

    Vectors of each length have cells of their own; one that cannot be compared (null, empty, with a
    null or NaN) is in no cell.  Rows are written first and the centres last, under one new version:
    a reader sees no index or a whole one.
    """
    spark, version = docs.sparkSession, uuid.uuid4().hex
    lengths = docs.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows")).filter("n > 0").collect()
    told = []
    for dims in sorted(r.n for r in lengths):
        rows = vectors._usable(docs, dims)
        count = rows.count()
        if not count:
            continue
        most = max(1, SAMPLE_NUMBERS // dims)
        wanted = cells or int(np.ceil(np.sqrt(count)))
        wanted = max(1, min(wanted, count // LEAST_PER_CELL, most // LEAST_PER_CELL))
        sample = _sampled(rows, count, min(most, SAMPLE_PER_CELL * wanted), seed)
        centres = train_centres(sample, wanted, seed)
        probes = choose_probes(sample, centres, k, seed)
        # a busy cell is written by as many tasks as its rows need
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(-(-count // FILE_ROWS)))
        (_put(rows, centres).repartition("cell", salt).write.partitionBy("cell")
         .parquet(f"{folder}/rows/version={version}/dims={dims}"))
        told += [(version, dims, i, centre.tolist(), probes) for i, centre in enumerate(centres)]
    if not told:       # an index without rows still has its columns
        docs.limit(0).withColumns({"dims": F.lit(0), "cell": F.lit(0)}).coalesce(1).write.parquet(
            f"{folder}/rows/version={version}")
        told = [(version, 0, 0, [], 1)]
    spark.createDataFrame(told, _CENTRES).coalesce(1).write.parquet(f"{folder}/centres")


def load(spark: SparkSession, folder: str) -> VectorIndex | None:
    """The stored index, or None if no whole one is there."""
    try:
        centres = spark.read.schema(_CENTRES).parquet(f"{folder}/centres")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    if (first := centres.first()) is None:
        return None
    return VectorIndex(spark.read.option("basePath", f"{folder}/rows/version={first.version}").parquet(
        f"{folder}/rows/version={first.version}"), centres)


def open_index(docs: DataFrame, folder: str) -> VectorIndex:
    """The stored index of ``docs``, built if there is none yet."""
    if (index := load(docs.sparkSession, folder)) is None:
        build(docs, folder)
        index = load(docs.sparkSession, folder)
    return index


def _probed(queries: DataFrame, centres: np.ndarray, numbers: np.ndarray, probes: int) -> DataFrame:
    """Queries with the cells they read: ``query_id, vector, cells``."""
    shared = queries.sparkSession.sparkContext.broadcast((centres, numbers))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, numbers = shared.value
        for batch in batches:
            if len(batch):
                near = _nearest_cells(vectors._matrix(batch["vector"]), centres, min(probes, len(centres)))
                batch["cells"] = list(numbers[near])
                yield batch

    kinds = [queries.schema[c].dataType.simpleString() for c in ("query_id", "vector")]
    return queries.select("query_id", "vector").mapInPandas(
        run, f"query_id {kinds[0]}, vector {kinds[1]}, cells array<int>")


def _probing(queries: DataFrame, centres: np.ndarray, numbers: np.ndarray, probes: int) -> DataFrame:
    """``query_id, vector, cell``: a row for every cell a query reads."""
    return _probed(queries, centres, numbers, probes).select("query_id", "vector", F.explode("cells").alias("cell"))


def _nearest_in_cells(queries: pd.DataFrame, docs: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` nearest of a block of documents to each query, among those in the cells it reads."""
    if queries.empty or docs.empty:
        return pd.DataFrame({"query_id": [], "doc_id": [], "distance": []})
    docs = docs.sort_values("doc_id", kind="stable")
    asked, matrix = vectors._matrix(queries["vector"]), np.stack(docs["embedding"].to_numpy())
    cells = queries["cells"].to_numpy()
    asking = pd.Series(np.repeat(np.arange(len(cells)), [len(c) for c in cells])).groupby(np.concatenate(cells)).indices
    reading = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    # of each query the nearest so far: a cell need only give what is nearer
    far, place = np.full((len(asked), k), np.inf), np.full((len(asked), k), len(docs))
    for cell, rows in docs.groupby("cell").indices.items():
        if cell in asking:
            at = reading[asking[cell]]
            near = vectors._nearest_in_parts(asked[at], matrix, rows, k, far[at, -1])
            who, first, count = np.unique(near["query_id"].to_numpy(), return_index=True, return_counts=True)
            cells_ = np.repeat(np.arange(len(who)), count), np.arange(len(near)) - np.repeat(first, count)
            new_far, new_place = np.full((len(who), k), np.inf), np.full((len(who), k), len(docs))
            new_far[cells_], new_place[cells_] = near["distance"].to_numpy(), near["doc_id"].to_numpy()
            both = [np.concatenate(x, axis=1) for x in ((far[at[who]], new_far), (place[at[who]], new_place))]
            best = np.lexsort(both[::-1], axis=-1)[:, :k]
            far[at[who]], place[at[who]] = (np.take_along_axis(x, best, 1) for x in both)
    there = place < len(docs)
    return vectors._named(pd.DataFrame({"query_id": np.nonzero(there)[0], "doc_id": place[there],
                                        "distance": far[there]}), queries, docs)


def _search_parts(rows: DataFrame, probed: DataFrame, cells: int, k: int, block_rows: int, doc_rows: int) -> DataFrame:
    """Cells are put together to parts of about ``doc_rows`` rows; a query goes once to a part, whatever it reads there."""
    count = max(1, -(-rows.count() // doc_rows))
    part = lambda cell: F.floor(cell * F.lit(min(count, cells)) / F.lit(cells)).cast("int")
    asked = probed.withColumn("part", F.explode(F.array_distinct(F.transform("cells", part)))).withColumn(
        "cells", F.filter("cells", lambda c: part(c) == F.col("part")))
    found = compare_in_blocks(asked, rows.withColumn("part", part(F.col("cell"))), ["part"], "query_id", "doc_id",
                              lambda left, right: _nearest_in_cells(left, right, k), vectors._FOUND, block_rows, doc_rows)
    return vectors._best_once(found, k)


def cells_read(index: VectorIndex, probing: DataFrame, dims: int) -> DataFrame:
    """The rows of the cells that any query reads; the others are pruned at the scan."""
    cells = [r.cell for r in probing.select("cell").distinct().collect()]      # at most one per centre
    return index.rows.filter((F.col("dims") == dims) & F.col("cell").isin(cells))


def search(index: VectorIndex, queries: DataFrame, k: int = vectors.DEFAULT_K, where: Column | None = None,
           probes: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` nearest rows of each query among the cells it reads: ``query_id, rank, doc_id, distance``."""
    vectors.check_k(k)
    by_dims: dict[int, list] = {}
    for row in index.centres.orderBy("dims", "cell").collect():                # bounded by SAMPLE_NUMBERS
        by_dims.setdefault(row.dims, []).append(row)
    parts = []
    for dims, asked in vectors._by_length(queries.select("query_id", "vector")):
        if dims not in by_dims:
            continue
        own = by_dims[dims]
        probed = _probed(asked, np.array([r.centre for r in own]), np.array([r.cell for r in own], dtype=np.int32),
                         probes or own[0].probes)
        rows = cells_read(index, probed.select(F.explode("cells").alias("cell")), dims)
        rows = rows if where is None else rows.filter(where)
        parts.append(_search_parts(rows.select("doc_id", "embedding", "cell"), probed, len(own), k,
                                   vectors._rows_of(dims, block_rows), vectors._doc_rows(dims, block_rows)))
    return vectors._together(parts, index.rows)


def knn_approx(docs: DataFrame, queries: DataFrame, folder: str, k: int = vectors.DEFAULT_K) -> DataFrame:
    """Approximate ``knn_batch`` from the index stored under ``folder``; the first call builds it."""
    return search(open_index(docs, folder), queries, k)
